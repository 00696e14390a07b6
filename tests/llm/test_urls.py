from pyspark.sql import functions as F

from yardstats.llm import urls

SCHEMA = "page_id long, url string, host string"


def _judge(spark, rows, addresses, rules=urls.RULES):
    pages = rows([(i, u, "other") for i, u in enumerate(addresses)], SCHEMA)
    return [r[1:] for r in sorted(map(tuple, urls.judge_urls(pages, urls.rule_table(spark, rules)).collect()))]


def test_rules(spark, rows):
    found = _judge(spark, rows, [
        "http://a.NET/x?y", "https://b.example.net/en/1#t", "http://example.net/english", "http://notexample.com/de/",
        "http://x.example.com/de/", "http://org/fr/", "http://a.org/fr", "http://net", None, "", "no scheme", "http://",
        "a://b://c.net/", "http://É.net/é/", "http://example.com?/de/",
    ])
    assert found == [
        ("a.net", "/x", "net/", "block"), ("b.example.net", "/en/1", "example.net/en/", "allow"),
        ("example.net", "/english", "net/", "block"), ("notexample.com", "/de/", None, "allow"),
        ("x.example.com", "/de/", "example.com/de/", "block"), ("org", "/fr/", "org/fr/", "allow"),
        ("a.org", "/fr", None, "allow"), ("net", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("b:", "//c.net/", None, "allow"),
        ("É.net", "/é/", "net/", "block"), ("example.com", "", None, "allow"),
    ]


def test_rule_that_ends_inside_a_folder_and_ties(spark, rows):
    rules = [("a.b", "/x/y", "block"), ("b", "/x/yz", "allow"), ("b", "/x/yz", "block"), ("b", "", "allow"), (None, "/", "block")]
    found = _judge(spark, rows, ["h://a.b/x/yz", "h://c.b/x/yz", "h://c.b", "h://a.b/x/", "h://" + "a." * 300 + "b/" + "x/" * 300], rules)
    assert [f[2:] for f in found] == [
        ("a.b/x/y", "block"), ("b/x/yz", "block"), ("b", "allow"), ("b", "allow"), ("b", "allow")
    ]


def test_every_row_is_judged(spark, rows):
    pages = rows([(1, "h://a.net/", "")] * 3 + [(None, "h://a.net/", ""), (None, None, "")], SCHEMA)
    assert urls.judge_urls(pages, urls.rule_table(spark)).count() == 5
    assert urls.judge_urls(pages.limit(0), urls.rule_table(spark)).count() == 0
    assert urls.judge_urls(pages, urls.rule_table(spark).limit(0)).filter(F.col("verdict") == "allow").count() == 5


def test_main_path_is_native(spark, rows):
    plan = urls.judge_urls(rows([(1, "h://a/", "")], SCHEMA), urls.rule_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
