import math
import random
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from yardstats.operators import listings, sheets
from yardstats.plans.reports import listing_report
from yardstats.plans.sample import Sample
from yardstats.schemas import PAGES, SHEET_GRID
from yardstats.sources import pages as reader
from yardstats.sources.pages import Selectors, complete_listings, extract_listings, listing_reader
from yardstats.sources.sheets import read_sheet_grid


def item(price, title="T", extra=""):
    return f'<li class="s-item"><span class="s-item__title">{title}</span><b class="s-item__price">{price}</b><a class="s-item__link" href="u">{extra}</a></li>'


def read(html, **selectors):
    return [
        {k: "".join(v[2][v[0] : v[1]]) if isinstance(v, list) else v for k, v in found.items()}
        for found in listing_reader(Selectors(**selectors))(html)
    ]


FULL = {"title": "T", "price_text": "£5", "link": "u"}


@pytest.mark.parametrize(
    "html, want",
    [
        (item("£5"), [FULL]),
        (item("£5") * 2, [FULL, FULL]),
        (item("£5", "<b> A </b>\n<i>B</i> C"), [FULL | {"title": "ABC"}]),
        (item("£5", "a &amp; b &lt;c&gt;"), [FULL | {"title": "a & b <c>"}]),
        (item("£5", "A<!-- no --> B"), [FULL | {"title": "AB"}]),
        (item("£5", "A<script>x</script>"), [FULL | {"title": "A"}]),
        (item("£5", "1 < 2"), [FULL | {"title": "1 < 2"}]),
        (item("£5", "A<br>B<br/>C"), [FULL | {"title": "ABC"}]),
        (item("£5", ""), [FULL | {"title": ""}]),
        (item("<s>£5</s> <s>to £9</s>"), [FULL | {"price_text": "£5to £9"}]),
        ("<!-- " + item("£5") + " -->", []),
        ("<script>" + item("£5") + "</script>", []),
        ('<div class="not-s-item s-items">x</div>', []),
        ("<div CLASS='big S-ITEM s-item'><p class=s-item__title>T</p></div>", [{"title": "T"}]),
        # Fields outside the item, or on the item itself, are not its fields.
        ('<div class="s-item s-item__title">x</div><p class="s-item__title">y</p>', [{}]),
        # Only the first title counts; a link without an address is still a link.
        ('<li class="s-item"><i class="s-item__title">1</i><i class="s-item__title">2</i><a class="s-item__link">', [{"title": "1", "link": None}]),
        # An unclosed child is closed with its parent, and so is the item.
        ('<ul><li class="s-item"><p class="s-item__title">1<b>2</li>3</ul>4', [{"title": "12"}]),
        ('<ul><li class="s-item"><p class="s-item__title">1</ul>2<i class="s-item__price">3</i>', [{"title": "1"}]),
        # An end tag nobody opened is ignored.
        ('<li class="s-item"></div><p class="s-item__title">1</p></li>', [{"title": "1"}]),
        # Nested items each have their own fields.
        ('<li class="s-item"><ul><li class="s-item"><p class="s-item__title">in</p></li></ul></li>', [{"title": "in"}, {"title": "in"}]),
        ('<a class="s-item" title="x > y"><p data-a=\'<b class="s-item__title">\'>n</p></a>', [{}]),
        ('<p class="s-item" title="broken><i class="s-item__title">t</i>', [{"title": "t"}]),
        ("", []),
    ],
)
def test_markup(html, want):
    assert read(html) == want


def test_unbalanced_quotes_stay_linear():
    assert read('<p class="' * 3000) == []


def test_element_selectors():
    html = '<ul><li><a href="/x">X</a></li><li>no link</li></ul>'
    assert read(html, item="li", title="a", price=None, link="a") == [{"title": "X", "link": "/x"}, {}]


def test_report(spark):
    prices = ["£50", "£50.01", "£500", "£500.5", "£1,000", "", "£10 to £20", "free", "£5000", "£9000", "£inf", "nan"]
    pages = [(i, "u", "<ul>" + item(p, f"t{i}") + '<li class="s-item"><b class="s-item__price">£1</b></li></ul>') for i, p in enumerate(prices)]
    pages.append((99, "u", "<p>nothing here</p>"))
    df = spark.createDataFrame(pages, PAGES)
    every = extract_listings(df)
    assert every.count() == 2 * len(prices)
    assert complete_listings(every).count() == len(prices)
    got = [(r.band, r.price) for r in listing_report(df).collect()]
    assert got == [
        ("large", math.inf), ("large", 9000.0), ("large", 5000.0), ("large", 500.5), ("large", 500.0),
        ("medium", 500.0), ("medium", 50.01), ("small", 50.0), ("small", 10.0),
    ]


def test_reader_needs_no_package_on_the_executors(tmp_path):
    """What a task gets can be loaded where this package cannot be imported."""
    job = tmp_path / "job.bin"
    job.write_bytes(cloudpickle.dumps(listing_reader(Selectors())))
    code = (
        "import pickle, sys; sys.path = [p for p in sys.path if p]; "
        f"read = pickle.load(open({str(job)!r}, 'rb')); "
        f"print(read({item('£5')!r})[0]['link'], 'yardstats' in sys.modules)"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.split() == ["u", "False"], out.stderr


def test_equal_prices_stay_in_page_order(spark):
    pages = [(2, "u", item("£5", "c")), (1, "u", item("£5", "a") + item("£5", "b") + item("£6", "z"))]
    got = [r.title for r in listing_report(spark.createDataFrame(pages, PAGES)).collect()]
    assert got == ["z", "a", "b", "c"]


def test_each_page_is_read_once(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "read")
    plain = reader.listing_reader

    def noted(selectors):
        of = plain(selectors)

        def read(html):
            with open(log, "a") as f:
                f.write("x\n")
            return of(html)

        return read

    monkeypatch.setattr(reader, "listing_reader", noted)
    pages = spark.createDataFrame([(i, "u", item(f"£{i}")) for i in range(40)], PAGES)
    got = [r.price for r in listing_report(pages).collect()]
    assert got == [float(i) for i in range(40)][::-1]
    with open(log) as f:
        assert len(f.readlines()) == 40


def test_markup_is_made_behind_the_shuffle(spark):
    """Only the lines of a page are sent to it."""
    plan = Sample(spark, "/root/testdata/sf0.001").market_pages()._jdf.queryExecution().sparkPlan()
    sent = ""
    while plan.children().size():
        if "Aggregate" in plan.nodeName():  # the last one is that before the shuffle
            sent = plan.aggregateExpressions().mkString()
        plan = plan.children().head()
    assert "price_text" in sent and "s-item" not in sent


def test_prices_and_markup_are_made_once(spark):
    """A filter on what was made does not make it again."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    texts = spark.range(3).select(F.concat(F.lit("£"), F.col("id").cast("string")).alias("price_text"))
    assert plan(listings.priced(texts)).count("regexp_extract(") == 1
    pages = Sample(spark, "/root/testdata/sf0.001").market_pages().filter(F.contains("html", F.lit("s-item")))
    assert plan(pages).count("transform(") == 1


PARTS = """< > / " ' ! ? -- --> <!-- <!--x--> <!x> <?y> <script> </script> <SCRIPT_a='>'> </Script_> <style </style> <scripty> </ſtyle>
_ &amp; a T = é <b> </b> <B_> <br> <br/> <p <p_ </p> </ul> <ul> </li> <li_class=s-item> <li_class="s-item"> </div> </i> </a> <a"b </ </_x> <1 <é>
<div_class='x_s-item_s-item__title'> <i_class="s-item__title"> <b_class='s-item__price'> <a_class="s-item__link"_href="u&amp;v">
<a_class=s-item__link> _class="s-item__title <img_src='i>j'_class=s-item__title_/> <a_title="x_>_y" _class= href='q' <![CDATA[x]]>""".split()


@pytest.mark.parametrize("seed", range(4))
def test_tags_by_one_pattern(seed, monkeypatch):
    """The pattern for whole pages finds what the scan tag by tag does, broken markup or not."""
    draw, short = random.Random(seed), reader._WHOLE
    closed = [part for part in PARTS if part[0] + part[-1] == "<>" or part.isalnum()]
    ways = set()
    for i in range(1500):
        html = "".join(draw.choice(PARTS if i % 3 == 0 else closed) for _ in range(draw.choice((2, 8, 30)))).replace("_class", " class").replace("_", " ")
        found = reader.texts_and_tags(html)
        ways.add(type(found))
        assert [(x[1], x[2].lower(), x[3]) for x in found] == [x[2:] for x in reader.tags(html)], html
        got = [read(html), read(html, item="li", title="b", price=None, link="a")]
        monkeypatch.setattr(reader, "_WHOLE", -1)
        assert got == [read(html), read(html, item="li", title="b", price=None, link="a")], html
        monkeypatch.setattr(reader, "_WHOLE", short)
    assert len(ways) == 2


def test_own_bands(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (float("nan"),)], "price double")
    bands = [listings.Band("low", high=1.0), listings.Band("all")]
    assert sorted((r.band, r.price) for r in listings.price_bands(df, bands).collect()) == [("all", 1.0), ("all", 2.0), ("low", 1.0)]


# Sheets

HEADER = [f"h{i}" for i in range(20)]
HEADER[4] = "h2"


def grid(spark, *rows):
    data = [(0, HEADER, None)] + [(i, cells, fills) for i, (cells, fills) in enumerate(rows, start=1)]
    return spark.createDataFrame(data, SHEET_GRID)


def test_sheet_rows(spark):
    full = [f"v{i}" for i in range(20)]
    hidden_hit = full[:17] + ["has BKD inside"] + full[18:]
    g = grid(
        spark,
        (["a", "bkd", "c"], [(1.0, 0.0, 0.0), (None, 0.5, 1.0)]),
        (hidden_hit, None),
        (full, None),
        (["x", None, "BKD", "d", None], []),
        ([], None),
        ([f"v{i}" for i in range(20)] + ["BKD beyond"], None),
    )
    assert sheets.sheet_header(g) == HEADER
    got = {r.row_idx: r.cells for r in sheets.sheet_matches(g, HEADER, "Bkd").collect()}
    assert sorted(got) == [1, 2, 4, 6]
    assert got[1] == {"h0": ("a", "#FF0000"), "h1": ("bkd", "#FF7FFF"), "h2": ("c", "#FFFFFF")}
    assert len(got[2]) == 17 and "h17" not in got[2] and "h18" not in got[2]
    assert got[2]["h2"].value == "v4" and got[2]["h19"].value == "v19"
    named = sheets.sheet_matches(g, HEADER, "Bkd").filter("row_idx = 2")
    assert named.select(F.map_keys("cells")).first()[0][:5] == ["h0", "h1", "h2", "h3", "h5"]
    # The last column of a repeated name counts when it is there, even empty.
    assert got[4]["h2"].value is None and got[4]["h1"].value is None
    assert "beyond" not in str(got[6])
    assert sheets.sheet_matches(g, HEADER, "").count() == 0
    assert sheets.sheet_matches(g, HEADER, "zz").count() == 0


def test_sheet_file(spark, tmp_path):
    g = grid(spark, (["a"], [(0.0, 0.0, 0.0)]))
    g.write.json(str(tmp_path / "g"))
    back = read_sheet_grid(spark, str(tmp_path / "g"))
    assert sheets.sheet_matches(back, HEADER, "A").first().cells == {"h0": ("a", "#000000")}
