import json

import pytest

from yardstats.operators import prefs
from yardstats.schemas import PREFS
from yardstats.sources.prefs import read_json_store


def orders(spark, *texts):
    df = prefs.normalise_orders(spark.createDataFrame([(t,) for t in texts], "raw string"))
    return {r.username: r["items"] for r in df.collect()}


def test_order_stores(spark):
    assert orders(spark, '["b", 1, null, "a"]') == {"__default__": ["b", "1", "None", "a"]}
    store = {"ann": ["x", 2], "bob": "text", "cid": {"a": 1}, "dan": [], "eve": 5, "__default__": ["d"]}
    assert orders(spark, json.dumps(store)) == {"ann": ["x", "2"], "dan": [], "__default__": ["d"]}
    for broken in ("", "5", '"text"', '{"a": [', "nonsense", "null"):
        assert orders(spark, broken) == {}


def test_loading_an_order(spark):
    df = prefs.normalise_orders(spark.createDataFrame([('{"ann": ["x"], "dan": [], "__default__": ["d"]}',)], "raw string"))

    def load(user):
        return [r["items"] for r in prefs.load_order(df, user).collect()]

    assert load("ann") == [["x"]]
    assert load("dan") == [[]]  # a saved empty list wins over the default
    assert load("zoe") == load(None) == load("") == [["d"]]
    assert prefs.load_order(df.filter("username <> '__default__'"), "zoe").count() == 0


def test_exclusion_stores(spark):
    store = {"ann": {"department": ["A", 1]}, "bob": ["A"], "cid": {"user": ["u"], "department": []}, "dan": {}}
    df = prefs.normalise_exclusions(spark.createDataFrame([(json.dumps(store),)], "raw string"))
    got = {(r.username, r.dimension): r["items"] for r in df.collect()}
    assert got == {
        ("ann", "department"): ["A", "1"], ("ann", "user"): [],
        ("cid", "department"): [], ("cid", "user"): ["u"],
        ("dan", "department"): [], ("dan", "user"): [],
    }
    assert [r.entity for r in prefs.load_exclusions(df, "ann", "department").collect()] == ["A", "1"]
    # No default for a named user.
    assert prefs.load_exclusions(df, "zoe", "department").count() == 0
    assert prefs.normalise_exclusions(spark.createDataFrame([("[1]",), ("{",)], "raw string")).count() == 0


def test_upsert(spark):
    store = spark.createDataFrame([("ann", "order", ["x"], 99), ("bob", "order", ["y"], 1), ("__default__", "order", ["d"], 1)], PREFS)
    changes = spark.createDataFrame(
        [("ann", "order", ["new"], 5), ("ann", "order", ["newer"], 6), ("", "order", ["e"], 7), (None, "user", [], 8), ("ann", "user", ["u"], 9)],
        PREFS,
    )
    got = {(r.username, r.dimension): r["items"] for r in prefs.upsert_prefs(store, changes).collect()}
    assert got == {
        ("ann", "order"): ["newer"], ("bob", "order"): ["y"], ("__default__", "order"): ["e"],
        ("__default__", "user"): [], ("ann", "user"): ["u"],
    }


@pytest.mark.parametrize("per_line", [False, True])
def test_reading_a_store(spark, tmp_path, per_line):
    (tmp_path / "order.json").write_text('{"ann": ["x"]}')
    raw = read_json_store(spark, str(tmp_path / "order.json"), per_line)
    assert [r["items"] for r in prefs.normalise_orders(raw).collect()] == [["x"]]
    assert read_json_store(spark, str(tmp_path / "missing.json"), per_line).count() == 0


def test_last_entry_of_a_repeated_name_counts(spark):
    stores = spark.createDataFrame([('{"ann": ["a"], "bob": ["b"], "ann": ["c"]}',), ('{"ann": ["d"]}',)], "raw string")
    got = sorted((r.username, r["items"]) for r in prefs.normalise_orders(stores).collect())
    assert got == [("ann", ["c"]), ("ann", ["d"]), ("bob", ["b"])]
    raw = '{"ann": {"user": ["x"]}, "ann": {"department": ["p"], "user": ["q"], "user": ["r"]}}'
    rows = prefs.normalise_exclusions(spark.createDataFrame([(raw,)], "raw string")).collect()
    assert sorted((r.dimension, r["items"]) for r in rows) == [("department", ["p"]), ("user", ["r"])]


def test_saving(spark, tmp_path):
    path = str(tmp_path / "prefs")
    empty = spark.createDataFrame([], "username string, dimension string, items array<string>, saved_at long")
    empty.write.parquet(path)
    assert prefs.save_prefs(spark, path, "ann", prefs.ORDER, [" B ", "", 3, "A"], 1) == ["B", "3", "A"]
    assert prefs.save_prefs(spark, path, None, prefs.ORDER, ["x"], 1) == ["x"]
    assert prefs.save_prefs(spark, path, "ann", "user", ["u"], 2) == ["u"]
    assert prefs.save_prefs(spark, path, "ann", prefs.ORDER, [], 3) == []
    for bad in ("text", None, {"a": 1}):
        with pytest.raises(ValueError):
            prefs.save_prefs(spark, path, "ann", prefs.ORDER, bad, 4)
    with pytest.raises(ValueError):
        prefs.save_prefs(spark, path, "ann", "colour", ["a"], 4)
    stored = prefs.read_prefs(spark, path)
    assert prefs.load_order(stored, "ann").first()["items"] == []
    assert prefs.load_order(stored, "bob").first()["items"] == ["x"]
    assert [r.entity for r in prefs.load_exclusions(stored, "ann", "user").collect()] == ["u"]
