import math

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from yardstats.operators import opportunity as op
from yardstats.plans.reports import part_search
from yardstats.plans.sample import Sample
from yardstats.schemas import CATALOGUE_NAMES, REQUESTS, SEARCH_COLUMNS
from yardstats.sinks.export import export_search, write_csv
from yardstats.sources.tables import read_catalogue

SCHEMA = (
    "row_id long, model string, part string, ic_start_year int, ic_end_year int, ic_description string, "
    "b_price double, parts_in_stock long, backorders long, parts_sold_all long, not_found_180 long"
)


def part(row_id, model="Golf", part="DOOR", start=2000, end=2005, description="x", price=10.0, stock=0, back=1, sold=1, missed=0):
    return (row_id, model, part, start, end, description, price, stock, back, sold, missed)


@pytest.fixture
def catalogue(spark):
    def make(*parts):
        return spark.createDataFrame(list(parts), SCHEMA)

    return make


def found(df):
    return [r.row_id for r in df.collect()]


def test_model_and_year(catalogue):
    c = catalogue(
        part(1), part(2, model="GOLF"), part(3, model="Golf "), part(4, model=None),
        part(5, start=None), part(6, start=2005, end=2009), part(7, start=2006),
    )
    kept = c.filter(op.model_is("gOLF") & op.covers_year(2005)).orderBy("row_id")
    assert found(kept) == [1, 2, 6]


def test_engine_code(catalogue):
    c = catalogue(
        part(1, description="ENGINE CODE BKD"), part(2, description="engine code xyz"),
        part(3, description="no code"), part(4, description=None),
    )
    assert sorted(found(c.filter(op.fits_engine_code(F.lit("bkd"))))) == [1, 3, 4]


def test_keywords(catalogue):
    names = ["ENGINE", "engine mount", "ENGINE_X", "MYENGINE", "éENGINE", "oil_pan/sump", None, "STARTER-MOTOR", "DOOR"]
    c = catalogue(*[part(i, part=n) for i, n in enumerate(names)])
    assert sorted(found(c.filter(op.has_no_keyword()))) == [2, 3, 4, 6, 8]


def test_scores_and_odd_stock(catalogue):
    c = catalogue(
        part(1, price=2.0, stock=1, back=2, sold=3, missed=1),
        part(2, stock=-1, sold=5),
        part(3, stock=-1, sold=-5),
        part(4, stock=-1, sold=0),
        part(5, stock=-1, sold=5, back=0),
        part(6, price=None),
        part(7, back=None),
    )
    got = {r.row_id: (r.potential_profit, r.sales_speed, r.opportunity_score) for r in op.with_scores(c).collect()}
    assert got[1] == (6.0, 1.5, 9.0)
    assert got[2][1:] == (math.inf, math.inf)
    assert got[3][1:] == (-math.inf, -math.inf)
    assert got[4][1:] == (None, None)
    assert got[5] == (0.0, math.inf, None)
    assert got[6][0] is None and got[6][2] is None
    assert got[7][0] is None


def test_search_order_limit_and_minimums(catalogue):
    c = catalogue(
        part(1, back=1, sold=1), part(2, back=5, sold=1), part(3, back=5, sold=9), part(4, back=5, sold=1),
        part(5, back=None), part(6, back=5, price=None), part(7, back=9, stock=-1, sold=0), part(8, back=0, sold=0),
    )
    marked = c.withColumn("part", F.col("row_id").cast("string"))
    names = [r.part for r in op.search_parts(marked, "golf", 2003).collect()]
    assert names == ["7", "3", "2", "4", "6", "1", "8", "5"]
    top = op.search_parts(marked, "golf", 2003, limit=3).collect()
    assert [(r.position, r.part) for r in top] == [(1, "7"), (2, "3"), (3, "2")]
    # "0" is a threshold: it drops the missing price and the missing score.
    assert [r.part for r in op.search_parts(marked, "golf", 2003, min_price="0").collect()] == ["7", "3", "2", "4", "1", "8", "5"]
    assert [r.part for r in op.search_parts(marked, "golf", 2003, min_opportunity="0").collect()] == ["3", "2", "4", "1", "8"]
    assert op.search_parts(marked, "golf", 2003, min_price="", min_opportunity=None).count() == 8
    assert op.search_parts(marked, "golf", 2003).columns == ["position", *SEARCH_COLUMNS]
    assert op.search_parts(marked, "polo", 2003).count() == 0


def test_search_report(catalogue, spark):
    c = catalogue(part(1, part="ENGINE"), part(2))
    assert part_search(c, "golf", 2003, " ").parts.count() == 2
    assert [r.part for r in part_search(c, "golf", 2003, excluding=True).parts.collect()] == ["DOOR"]
    grid = spark.createDataFrame([(0, ["h"], None), (1, ["BKD"], None)], "row_idx int, cells array<string>, fills array<struct<red:double,green:double,blue:double>>")
    assert part_search(c, "golf", 2003, "bkd", grid=grid, header=["h"]).sheet_rows.count() == 1
    assert part_search(c, "golf", 2003, "", grid=grid, header=["h"]).sheet_rows is None


REQUEST_ROWS = [
    (1, "BRAND#7", 1998, " small ", None, None, False),
    (2, "brand#7", 1998, "SMALL", None, None, False),
    (3, "Brand#7", 1998, None, 905.0, None, None),
    (4, "Brand#3", 1995, "", None, 5000.0, True),
    (5, "nothing", 1995, "", None, None, False),
    (6, None, 1995, "", None, None, False),
    (7, "Brand#7", None, "", None, None, False),
    (8, "Brand#9", 2001, "zzz", 0.0, 0.0, False),
    (9, "Brand#9", 2001, "zzz", 1e9, None, False),
]


@pytest.mark.parametrize("shortlist", [50, 3, 1000])
@pytest.mark.parametrize("limit", [50, 3])
def test_batch_equals_single_searches(spark, shortlist, limit):
    # A shortlist below the limit sends searches through the full pass as well.
    catalogue = Sample(spark, "/root/testdata/sf0.01").catalogue()
    requests = spark.createDataFrame(REQUEST_ROWS, REQUESTS)
    batch = op.search_parts_batch(catalogue, requests, limit, shortlist)
    got = {}
    for r in batch.orderBy("request_id", "position").collect():
        got.setdefault(r.request_id, []).append(tuple(r)[1:])
    for request_id, model, year, code, price, score, exclude in REQUEST_ROWS:
        want = []
        if model and year:
            single = op.search_parts(
                catalogue, model, year, code or "", price, score, op.EXCLUDED_PARTS if exclude else None, limit
            )
            want = [tuple(r) for r in single.collect()]
        assert got.get(request_id, []) == want, request_id


def test_cutting_in_hands_changes_nothing(spark):
    scored = op.with_scores(Sample(spark, "/root/testdata/sf0.01").catalogue())
    for limit in (1, 7):
        place = F.row_number().over(W.partitionBy("model").orderBy(*op.best_first()))
        plain = scored.withColumn("n", place).filter(F.col("n") <= limit).select("model", "n", "row_id")
        hands = op._best_of(scored, ["model"], limit, "n").select("model", "n", "row_id")
        assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, hands.collect()))


def test_keywords_are_literal(catalogue):
    c = catalogue(part(1, part="A.C PUMP"), part(2, part="ABC PUMP"), part(3, part="old_PUMP"), part(4, part=None))
    assert sorted(found(c.filter(op.has_no_keyword(["a.c"])))) == [2, 3, 4]
    assert sorted(found(c.filter(op.has_no_keyword(["pump"])))) == [3, 4]
    assert c.filter(op.has_no_keyword([])).count() == 4


def test_batch_with_wide_and_corrupt_year_ranges(catalogue, spark):
    c = catalogue(
        part(1, start=1, end=2**31 - 1), part(2, start=1990, end=2030), part(3, start=1990, end=2031),
        part(4, start=2010, end=2000), part(5, start=2003, end=2003), part(6, start=-5, end=-1), part(7, start=None),
    ).withColumn("part", F.col("row_id").cast("string"))
    requests = spark.createDataFrame([(1, "golf", 2003, "", None, None, False), (2, "golf", -3, "", None, None, False)], REQUESTS)
    got = op.search_parts_batch(c, requests).collect()
    assert sorted((r.request_id, r.part) for r in got) == [(1, "1"), (1, "2"), (1, "3"), (1, "5"), (2, "6")]


def test_spans_of_years(spark):
    edges = [-(2**31), -1000, -7, -1, 0, 1, 1990, 1999, 2003, 2048, 2990, 2**31 - 1]
    ranges = [(a, b) for a in edges for b in edges]
    rows = spark.createDataFrame(ranges, "a int, b int").select("a", "b", op._spans_of_range(F.col("a"), F.col("b")).alias("spans"))
    years = spark.createDataFrame([(y,) for y in edges], "y int").select("y", op._spans_of_year(F.col("y")).alias("spans")).collect()
    year_spans = {r.y: {tuple(s) for s in r.spans} for r in years}
    for r in rows.collect():
        spans = [tuple(s) for s in r.spans]
        parts = sorted((index << level, (index + 1) << level) for level, index in spans)
        if r.a > r.b:
            assert not parts
            continue
        # They make up the range without a gap or an overlap, in few pieces.
        assert parts[0][0] == r.a and parts[-1][1] == r.b + 1 and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
        assert len(spans) <= 2 * max(1, (r.b - r.a + 1).bit_length())
        for y in edges:
            assert len(year_spans[y] & set(spans)) == (r.a <= y <= r.b)


def test_batch_with_one_search_asked_by_nearly_all(spark):
    catalogue = Sample(spark, "/root/testdata/sf0.001").catalogue()
    model = catalogue.first().model
    many = spark.range(3000).select(
        F.col("id").alias("request_id"), F.lit(model).alias("model"), F.lit(1998).alias("year"),
        F.when(F.col("id") % 100 == 0, "small").otherwise("").alias("engine_code"),
        F.lit(None).cast("double").alias("min_price"), F.lit(None).cast("double").alias("min_opportunity"),
        F.lit(False).alias("exclude"),
    )
    got = op.search_parts_batch(catalogue, many).groupBy("request_id").count()
    single = op.search_parts(catalogue, model, 1998).count()
    assert {r["count"] for r in got.filter("request_id % 100 <> 0").collect()} == ({single} if single else set())


def test_autocomplete(catalogue):
    c = catalogue(part(3, model="Golf"), part(1, model="golf"), part(2, model="Polo"), part(4, model="Golf"), part(5, model=None), part(6, model="a.b"))
    assert [r.model for r in op.autocomplete(c, "OL").collect()] == ["golf", "Polo", "Golf"]
    assert [r.model for r in op.autocomplete(c, ".").collect()] == ["a.b"]
    assert op.autocomplete(c, "").count() == 0


def test_column_searches(catalogue):
    c = catalogue(part(1, part="FRONT DOOR", price=12.5), part(2, part="DOOR FRONT"), part(3, part="DOOR"), part(4, part=None))
    assert sorted(found(op.contains_filters(c, {"part": "front door"}))) == [1, 2]
    assert found(op.contains_filters(c, {"part": '"front door"'})) == [1]
    assert found(op.contains_filters(c, {"part": "door", "b_price": "2.5"})) == [1]
    assert op.contains_filters(c, {"part": " "}).count() == 4


def test_result_pages(catalogue):
    c = op.with_scores(catalogue(*[part(i, back=100 - i) for i in range(60)]))
    assert found(op.result_page(c, op.best_first(), 0)) == list(range(25))
    assert found(op.result_page(c, op.best_first(), 2)) == list(range(50, 60))
    assert [r.position for r in op.result_page(c, op.best_first(), 2).collect()] == list(range(51, 61))
    assert op.result_page(c, op.best_first(), 3).count() == 0


def test_search_box_and_chosen_order(catalogue):
    c = catalogue(part(1, part="FRONT DOOR", model="Golf", price=3.0), part(2, part="DOOR", model="Front", price=None), part(3, part="DOOR", price=5.0))
    assert sorted(found(op.search_box(c, "door front", ["part", "model"]))) == [1, 2]
    assert sorted(found(op.search_box(c, '"front door"'))) == [1]
    assert op.search_box(c, " ").count() == 3
    assert found(op.result_page(c, op.sorted_by("b_price", descending=True), 0)) == [3, 1, 2]
    assert found(op.result_page(c, op.sorted_by("part"), 0)) == [2, 3, 1]


def test_display(catalogue):
    row = op.display_rows(op.with_scores(catalogue(part(1, price=1.239, back=1), ))).first()
    assert row["B Price"] == 1.24 and row["Highlight"] is True
    assert op.display_rows(op.with_scores(catalogue(part(1, back=None)))).first()["Highlight"] is False


def test_export(catalogue, spark, tmp_path):
    found_parts = op.search_parts(catalogue(part(1, part="a,b"), part(2, back=7, part='q"x')), "golf", 2003)
    export_search(found_parts, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert back.columns[:2] == ["Part", "IC Start Year"] and back.columns[-1] == "Opportunity_Score"
    assert len(back.columns) == 12
    assert sorted(r.Part for r in back.collect()) == ["a,b", 'q"x']


def test_catalogue_file_keeps_row_order(spark, tmp_path):
    lines = [",".join(CATALOGUE_NAMES)] + [f"M{i % 7},P{i},2000,2005,,1.5,1,2,3,4" for i in range(5000)]
    (tmp_path / "c.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        c = read_catalogue(spark, str(tmp_path))
        assert c.rdd.getNumPartitions() > 3
        assert [r.part for r in c.orderBy("row_id").collect()] == [f"P{i}" for i in range(5000)]
        assert [r.model for r in op.autocomplete(c, "m").collect()] == [f"M{i}" for i in range(7)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    row = c.filter("part = 'P3'").first()
    assert row.ic_description is None and row.b_price == 1.5 and row.backorders == 2


def test_csv_round_trip_of_quotes(spark, catalogue, tmp_path):
    c = catalogue(part(1, part='2" pipe, "big"', description="a\\b"))
    write_csv(c.select(*[F.col(v).alias(k) for k, v in CATALOGUE_NAMES.items()]), str(tmp_path / "c"))
    back = read_catalogue(spark, str(tmp_path / "c")).first()
    assert back.part == '2" pipe, "big"' and back.ic_description == "a\\b"
