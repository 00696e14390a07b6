"""The business tables, derived from the star-schema test tables.

Each derivation puts in the irregularities the operators have to cope with:
missing names and taxes, rows without an invoice, unknown users and item types,
names that show alike, relative and absolute addresses, odd price texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yardstats.operators.calendar import Facts
from yardstats.schemas import MONEY


class Sample:
    """Lazy business tables over one folder of test tables.

    Tables named in ``streamed`` are read as a stream of files.
    """

    def __init__(self, spark: SparkSession, base: str, streamed: tuple[str, ...] = ()):
        self.spark, self.base, self.streamed = spark, base, streamed

    def raw(self, name: str) -> DataFrame:
        stored = self.spark.read.parquet(f"{self.base}/{name}.parquet")
        if name not in self.streamed:
            return stored
        files = self.spark.readStream.schema(stored.schema).option("pathGlobFilter", f"{name}.parquet")
        return files.parquet(self.base)

    def facts(self) -> Facts:
        return Facts(self.invoice(), self.sold(), self.users(), self.itemtype())

    def catalogue(self) -> DataFrame:
        key = F.col("p_partkey")
        sales = self.raw("lineitem").groupBy("l_partkey").agg(
            F.count(F.lit(1)).alias("sold_all"),
            F.count_if((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N")).alias("wanted"),
            F.count_if(F.col("l_returnflag") == "R").alias("missed"),
        )
        description = (
            F.when(key % 3 == 0, F.concat(F.lit("Engine Code "), F.col("p_type")))
            .when(key % 17 == 0, F.lit(None))
            .otherwise(F.col("p_type"))
        )
        start = (1990 + key % 15).cast("int")
        return (
            self.raw("part")
            .join(sales, F.col("l_partkey") == key, "left")
            .select(
                key.alias("row_id"),
                F.col("p_brand").alias("model"),
                F.upper("p_name").alias("part"),
                start.alias("ic_start_year"),
                F.when(key % 97 == 5, start + 1000).when(key % 89 == 3, start - 3).otherwise(start + F.col("p_size") % 10)
                .cast("int")
                .alias("ic_end_year"),
                description.alias("ic_description"),
                F.col("p_retailprice").alias("b_price"),
                (F.col("p_size") - 1).cast("long").alias("parts_in_stock"),
                F.coalesce("wanted", F.lit(0)).alias("backorders"),
                F.coalesce("sold_all", F.lit(0)).alias("parts_sold_all"),
                F.coalesce("missed", F.lit(0)).alias("not_found_180"),
            )
        )

    def invoice(self) -> DataFrame:
        total = F.col("o_totalprice").cast(MONEY)
        segment = F.col("c_mktsegment")
        return (
            self.raw("orders")
            .join(self.raw("customer"), F.col("c_custkey") == F.col("o_custkey"))
            .select(
                F.col("o_orderkey").alias("invoice_id"),
                F.when(segment != "FURNITURE", segment).alias("departmentname"),
                F.col("c_nationkey").cast("long").alias("whocreated_id"),
                F.col("o_orderdate").alias("datecreated"),
                total.alias("total"),
                F.when(F.col("o_orderstatus") != "P", total * F.lit(0.2).cast("decimal(1,1)"))
                .cast("decimal(18,3)")
                .alias("totaltax1"),
            )
        )

    def users(self) -> DataFrame:
        return self.raw("nation").filter("n_nationkey < 20").select(
            F.col("n_nationkey").cast("long").alias("user_id"), F.col("n_name").alias("shortname")
        )

    def sold(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.when(F.col("l_linenumber") != 7, F.col("l_orderkey")).alias("invoice_id"),
            F.when(F.col("l_quantity") != 50, F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("invnumber"),
            F.col("l_partkey").alias("itemtype_id"),
            F.col("l_shipdate").alias("solddate"),
            F.when(F.col("l_returnflag") == "R", F.lit(False))
            .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), F.lit(None))
            .otherwise(F.lit(True))
            .alias("issold"),
        )

    def itemtype(self) -> DataFrame:
        stored = F.concat(F.lit("["), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("]"))
        return self.raw("part").filter("p_partkey % 10 <> 0").select(
            F.col("p_partkey").alias("itemtype_id"),
            F.when(F.col("p_partkey") % 2 == 0, stored).otherwise(F.col("p_name")).alias("itemname"),
        )

    def vehicle(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("stocknumber_id"),
            F.col("c_name").alias("regnumber"),
            F.col("c_nationkey").cast("long").alias("location_id"),
        )

    def stocknumber(self) -> DataFrame:
        return self.raw("customer").filter("c_custkey % 11 <> 0").select(
            F.col("c_custkey").alias("stocknumber_id"),
            F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("vstockno"),
        )

    def location(self) -> DataFrame:
        return self.raw("nation").filter("n_nationkey < 20").select(
            F.col("n_nationkey").cast("long").alias("location_id"), F.col("n_name").alias("bin")
        )

    def audit_log(self) -> DataFrame:
        kind = F.col("event_type")
        return self.raw("events").select(
            F.col("ts").alias("event_time"),
            F.col("event_id").alias("log_id"),
            F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("username"),
            F.upper(kind).alias("action"),
            F.when(kind != "purchase", F.concat(F.lit("REG"), F.col("user_id").cast("string"))).alias("regnumber"),
            F.when(kind == "error", "NOT FOUND").otherwise("FOUND").alias("status"),
        )

    def image(self) -> DataFrame:
        key = F.col("page_id")
        return self.raw("pages").select(
            F.concat(F.lit("T"), (key % 40).cast("string")).alias("barcode"),
            F.when(key % 3 == 0, F.col("url"))
            .otherwise(F.regexp_replace("url", "^https?://[^/]+", ""))
            .alias("relativeurl"),
            F.when(key % 5 != 0, key % 4).cast("int").alias("displayorder"),
            F.when(key % 7 == 0, F.lit(True)).when(key % 7 == 1, F.lit(None)).otherwise(F.lit(False)).alias("thumbnail"),
        )

    def listing(self) -> DataFrame:
        line = F.col("l_linenumber")
        hundreds = F.floor(F.col("l_extendedprice") / 100).cast("string")
        price = (
            F.when(line == 1, F.concat(F.lit("£"), hundreds, F.lit(" to £99")))
            .when(line == 2, F.concat(F.lit("£1,"), hundreds))
            .when(line == 3, F.lit("£500"))
            .when(line == 4, F.lit(None))
            .otherwise(F.concat(F.lit("£"), hundreds))
        )
        return self.raw("lineitem").select(
            (F.col("l_orderkey") * 10 + line).alias("listing_id"),
            F.concat(F.lit("Item "), F.col("l_partkey").cast("string")).alias("title"),
            price.alias("price_text"),
        )

    def market_pages(self) -> DataFrame:
        """A stored result page per order: the listings of its lines, among other markup.

        Every third page nests the title, every fifth price is split over two
        nodes, a missing price leaves the listing incomplete.
        """
        def item(line: Column) -> Column:
            key, title, price = line["key"], line["title"], line["price_text"]
            title = F.when(key % 3 == 0, F.concat(F.lit("<b>New</b> <i> "), title, F.lit(" </i>"))).otherwise(title)
            price = F.when(
                key % 5 == 0,
                F.concat(F.lit('<span class="big s-item__price"><em>'), price, F.lit("</em> <em>each</em></span>")),
            ).otherwise(F.concat(F.lit('<span class="s-item__price">\n '), price, F.lit(" </span>")))
            return F.concat(
                F.lit('<!-- s-item --><li class="wide s-item"><a href="/x"><img src="i.png"></a><div class="s-item__title">'),
                title,
                F.lit("</div>"),
                F.coalesce(price, F.lit("")),
                F.lit('<p><a class="s-item__link" href="/i?a=1&amp;n='),
                key.cast("string"),
                F.lit('">see</a></li>'),
            )

        # Lines go to their page as they are, and become markup there.
        key = F.col("listing_id")
        lines = self.listing().groupBy(F.floor(key / 10).alias("page_id")).agg(
            F.sort_array(F.collect_list(F.struct(key.alias("key"), "title", "price_text"))).alias("lines")
        )
        head = F.lit('<html><head><style>.s-item{color:red}</style></head><body><ul><li class="other">menu<br></li>')
        html = F.concat(head, F.array_join(F.transform("lines", item), "\n"), F.lit("</ul></body></html>"))
        # In a step of its own, so that a filter on the markup does not make it again.
        return lines.select("page_id", F.lit("").alias("url"), F.explode(F.array(html)).alias("html"))
