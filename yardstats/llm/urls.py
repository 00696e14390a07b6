"""URL filters by host-suffix and path-prefix expressions.

Each URL is expanded into the expressions a rule could have: every host suffix with
every leading folder of its path. These are joined with the rules on four bytes of
their digest; the full digest and the rule's path confirm a hit, and the longest rule
wins. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yardstats.llm.shared import ascii_lower

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT = "allow"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path. Null, or without ``://``: both empty."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.when(known, ascii_lower(host)).otherwise(""), F.when(known, path).otherwise("")


def suffixes(host: Column, most: Column | int) -> Column:
    """The host and its parents, up to ``most`` labels: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    count = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most)))
    return F.transform(count, lambda n: F.call_function("substring_index", host, F.lit("."), -n))


def folders(path: Column, most: Column | int) -> Column:
    """Leading folders of a path, up to ``most`` slashes: /, /a/, /a/b/. The empty one is always there."""
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/")))
    count = F.sequence(F.lit(0), F.least(slashes, F.lit(most)).cast("int"))
    return F.transform(count, lambda n: F.when(n == 0, "").otherwise(F.concat(F.call_function("substring_index", path, F.lit("/"), n), F.lit("/"))))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, action string")


def _digest(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), folder), 256)


def match_rules(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """The winning rule of each distinct (host, path) that any rule fits: host, path, rule, action.

    The longest rule (host and path) wins, of equal ones that with the longer host,
    then block before allow, then code point order. Rules with a null are ignored.
    No expression deeper than the deepest rule is made; that loses nothing.
    """
    rules = rules.select(
        ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("action")
    ).dropna()
    rules = rules.withColumn("rule_folder", F.regexp_extract("rule_path", r"\A(.*/)?", 0))
    deepest = rules.agg(
        F.max(F.size(F.split("rule_host", r"\."))).alias("labels"),
        F.max(F.length("rule_folder") - F.length(F.replace("rule_folder", F.lit("/")))).alias("slashes"),
    ).first()
    labels, slashes = deepest["labels"] or 0, deepest["slashes"] or 0
    if not labels:
        return pairs.limit(0).select("host", "path", F.lit("").alias("rule"), F.lit("").alias("action"))
    rules = rules.withColumn("full", _digest(F.col("rule_host"), F.col("rule_folder")))
    rules = rules.withColumn("short", F.substring("full", 1, 8))

    asked = pairs.select("host", "path", F.explode(suffixes(F.col("host"), labels)).alias("suffix"))
    asked = asked.withColumn("folder", F.explode(folders(F.col("path"), slashes)))
    asked = asked.withColumn("asked", _digest(F.col("suffix"), F.col("folder")))
    asked = asked.withColumn("short", F.substring("asked", 1, 8))

    hits = asked.join(rules, "short").filter(
        (F.col("asked") == F.col("full")) & F.startswith(F.col("path"), F.col("rule_path"))
    )
    rule = F.concat("rule_host", "rule_path")
    rank = F.struct(
        F.length(rule).alias("length"), F.length("rule_host").alias("host_length"),
        (F.col("action") == "block").alias("blocks"), rule.alias("rule"), F.col("action").alias("action"),
    )
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return best.select("host", "path", "best.rule", "best.action")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    Each distinct (host, path) is judged once, so that one host or URL with a third
    of all rows is expanded no more often than others. The judged pairs are joined
    back; a hot pair is on the big side only, which adaptive joins split. No rule:
    null, and ``default`` as the verdict. Repeated rows give repeated rows.
    """
    host, path = split_url(F.col("_url"))
    pages = pages.select("page_id", F.col("url").alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
    judged = match_rules(pages.select("host", "path").distinct(), rules)
    return pages.join(judged, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict")
    )


URLS_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
split AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
judged AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM split)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""
