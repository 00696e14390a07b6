"""Column names and types of the business tables.

Money is ``decimal(18,2)`` while it is being summed, so a total does not depend
on the order in which partitions arrive; it becomes double only in results.
"""

from __future__ import annotations

from pyspark.sql import types as T

CATALOGUE = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("part", T.StringType()),
        T.StructField("ic_start_year", T.IntegerType()),
        T.StructField("ic_end_year", T.IntegerType()),
        T.StructField("ic_description", T.StringType()),
        T.StructField("b_price", T.DoubleType()),
        T.StructField("parts_in_stock", T.LongType()),
        T.StructField("backorders", T.LongType()),
        T.StructField("parts_sold_all", T.LongType()),
        T.StructField("not_found_180", T.LongType()),
    ]
)

# Names in the delimited file and in exports, and ours.
CATALOGUE_NAMES = {
    "Model": "model",
    "Part": "part",
    "IC Start Year": "ic_start_year",
    "IC End Year": "ic_end_year",
    "IC Description": "ic_description",
    "B Price": "b_price",
    "Parts in Stock": "parts_in_stock",
    "Backorders": "backorders",
    "Parts Sold All": "parts_sold_all",
    "Not Found 180 days": "not_found_180",
}

SCORE_NAMES = {
    "Potential_Profit": "potential_profit",
    "Sales_Speed": "sales_speed",
    "Opportunity_Score": "opportunity_score",
}
SEARCH_COLUMNS = [
    "part", "ic_start_year", "ic_end_year", "ic_description", "b_price",
    "parts_in_stock", "backorders", "parts_sold_all", "not_found_180",
    "potential_profit", "sales_speed", "opportunity_score",
]

MONEY = T.DecimalType(18, 2)

INVOICE = T.StructType(
    [
        T.StructField("invoice_id", T.LongType()),
        T.StructField("departmentname", T.StringType()),
        T.StructField("whocreated_id", T.LongType()),
        T.StructField("datecreated", T.TimestampNTZType()),
        T.StructField("total", MONEY),
        T.StructField("totaltax1", T.DecimalType(18, 3)),
    ]
)
SOLD = T.StructType(
    [
        T.StructField("invoice_id", T.LongType()),
        T.StructField("itemtype_id", T.LongType()),
        T.StructField("invnumber", T.LongType()),
        T.StructField("issold", T.BooleanType()),
        T.StructField("solddate", T.TimestampNTZType()),
    ]
)
USERS = T.StructType(
    [T.StructField("user_id", T.LongType()), T.StructField("shortname", T.StringType())]
)
ITEMTYPE = T.StructType(
    [T.StructField("itemtype_id", T.LongType()), T.StructField("itemname", T.StringType())]
)
VEHICLE = T.StructType(
    [
        T.StructField("stocknumber_id", T.LongType()),
        T.StructField("regnumber", T.StringType()),
        T.StructField("location_id", T.LongType()),
    ]
)
STOCKNUMBER = T.StructType(
    [T.StructField("stocknumber_id", T.LongType()), T.StructField("vstockno", T.StringType())]
)
LOCATION = T.StructType(
    [T.StructField("location_id", T.LongType()), T.StructField("bin", T.StringType())]
)
IMAGE = T.StructType(
    [
        T.StructField("barcode", T.StringType()),
        T.StructField("relativeurl", T.StringType()),
        T.StructField("displayorder", T.IntegerType()),
        T.StructField("thumbnail", T.BooleanType()),
    ]
)
AUDIT = T.StructType(
    [
        T.StructField("event_time", T.TimestampNTZType()),
        T.StructField("log_id", T.LongType()),
        T.StructField("username", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("regnumber", T.StringType()),
        T.StructField("stocknumber", T.StringType()),
        T.StructField("vstockno", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)
PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
FILL = T.StructType([T.StructField(c, T.DoubleType()) for c in ("red", "green", "blue")])
SHEET_GRID = T.StructType(
    [
        T.StructField("row_idx", T.IntegerType()),
        T.StructField("cells", T.ArrayType(T.StringType())),
        T.StructField("fills", T.ArrayType(FILL)),
    ]
)
PREFS = T.StructType(
    [
        T.StructField("username", T.StringType()),
        T.StructField("dimension", T.StringType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("saved_at", T.LongType()),
    ]
)
REQUESTS = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("model", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("engine_code", T.StringType()),
        T.StructField("min_price", T.DoubleType()),
        T.StructField("min_opportunity", T.DoubleType()),
        T.StructField("exclude", T.BooleanType()),
    ]
)

TABLES = {
    "invoice": INVOICE,
    "sold": SOLD,
    "users": USERS,
    "itemtype": ITEMTYPE,
    "vehicle": VEHICLE,
    "stocknumber": STOCKNUMBER,
    "location": LOCATION,
    "image": IMAGE,
    "audit_log": AUDIT,
    "pages": PAGES,
}
