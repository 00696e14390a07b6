"""The sample tables of ``sample.py`` once more, as SQL for the oracle engine."""

from __future__ import annotations

VIEWS = {
    "v_parts": """
SELECT p.p_partkey AS row_id, p.p_brand AS model, upper(p.p_name) AS part,
 CAST(1990 + p.p_partkey % 15 AS INTEGER) AS ic_start_year,
 CAST(1990 + p.p_partkey % 15 + CASE WHEN p.p_partkey % 97 = 5 THEN 1000 WHEN p.p_partkey % 89 = 3 THEN -3 ELSE p.p_size % 10 END AS INTEGER) AS ic_end_year,
 CASE WHEN p.p_partkey % 3 = 0 THEN concat('Engine Code ', p.p_type) WHEN p.p_partkey % 17 = 0 THEN NULL ELSE p.p_type END AS ic_description,
 p.p_retailprice AS b_price, CAST(p.p_size - 1 AS BIGINT) AS parts_in_stock,
 coalesce(l.sold_all, 0) AS parts_sold_all, coalesce(l.backorders, 0) AS backorders, coalesce(l.not_found, 0) AS not_found_180
FROM part p LEFT JOIN (SELECT l_partkey, count(*) AS sold_all,
   count(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 1 END) AS backorders,
   count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS not_found FROM lineitem GROUP BY l_partkey) l ON l.l_partkey = p.p_partkey""",
    "v_scored": """
SELECT *, potential_profit * sales_speed AS opportunity_score FROM (
 SELECT *, (backorders + not_found_180) * b_price AS potential_profit,
  CAST(parts_sold_all AS DOUBLE) / (parts_in_stock + 1) AS sales_speed FROM v_parts)""",
    "v_invoice": """
SELECT o.o_orderkey AS invoice_id,
 CASE WHEN c.c_mktsegment = 'FURNITURE' THEN NULL ELSE c.c_mktsegment END AS departmentname,
 c.c_nationkey AS whocreated_id, o.o_orderdate AS datecreated, CAST(o.o_totalprice AS DECIMAL(18,2)) AS total,
 CASE WHEN o.o_orderstatus = 'P' THEN NULL ELSE CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) * 0.2 AS DECIMAL(18,3)) END AS totaltax1
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey""",
    "v_users": "SELECT n_nationkey AS user_id, n_name AS shortname FROM nation WHERE n_nationkey < 20",
    "v_sold": """
SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey END AS invoice_id,
 CASE WHEN l_quantity = 50 THEN NULL ELSE l_orderkey * 10 + l_linenumber END AS invnumber,
 l_partkey AS itemtype_id, l_shipdate AS solddate,
 CASE WHEN l_returnflag = 'R' THEN false WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN NULL ELSE true END AS issold FROM lineitem""",
    "v_owned": """
SELECT s.*, i.departmentname, u.shortname FROM v_sold s
 LEFT JOIN v_invoice i ON i.invoice_id = s.invoice_id LEFT JOIN v_users u ON u.user_id = i.whocreated_id""",
    "v_itemtype": """
SELECT p_partkey AS itemtype_id,
 CASE WHEN p_partkey % 2 = 0 THEN concat('[', replace(p_name, ' ', '_'), ']') ELSE p_name END AS itemname FROM part WHERE p_partkey % 10 <> 0""",
    "v_vehicle": "SELECT c_custkey AS stocknumber_id, c_name AS regnumber, CAST(c_nationkey AS BIGINT) AS location_id FROM customer",
    "v_stocknumber": "SELECT c_custkey AS stocknumber_id, concat('S', CAST(c_custkey AS VARCHAR)) AS vstockno FROM customer WHERE c_custkey % 11 <> 0",
    "v_location": "SELECT n_nationkey AS location_id, n_name AS bin FROM nation WHERE n_nationkey < 20",
    "v_stocked": """
SELECT v.stocknumber_id, v.regnumber, s.vstockno, l.bin FROM v_vehicle v
 JOIN v_stocknumber s ON s.stocknumber_id = v.stocknumber_id LEFT JOIN v_location l ON l.location_id = v.location_id""",
    "v_log": """
SELECT ts AS event_time, event_id AS log_id, concat('user', CAST(user_id AS VARCHAR)) AS username, upper(event_type) AS action,
 CASE WHEN event_type = 'purchase' THEN NULL ELSE concat('REG', CAST(user_id AS VARCHAR)) END AS regnumber,
 CASE WHEN event_type = 'error' THEN 'NOT FOUND' ELSE 'FOUND' END AS status FROM events""",
    "v_shown_log": """
SELECT event_time, log_id, strftime(event_time, '%d.%m.%Y %H:%M:%S') AS timestamp, username, action, regnumber,
 CAST(NULL AS VARCHAR) AS stocknumber, CAST(NULL AS VARCHAR) AS vstockno, CAST(NULL AS VARCHAR) AS location, status FROM v_log""",
    "v_image": """
SELECT concat('T', CAST(page_id % 40 AS VARCHAR)) AS barcode,
 CASE WHEN page_id % 3 = 0 THEN url ELSE regexp_replace(url, '^https?://[^/]+', '') END AS relativeurl,
 CASE WHEN page_id % 5 = 0 THEN NULL ELSE CAST(page_id % 4 AS INTEGER) END AS displayorder,
 CASE WHEN page_id % 7 = 0 THEN true WHEN page_id % 7 = 1 THEN NULL ELSE false END AS thumbnail FROM pages""",
    "v_listing": """
SELECT l_orderkey * 10 + l_linenumber AS listing_id, concat('Item ', CAST(l_partkey AS VARCHAR)) AS title,
 CASE WHEN l_linenumber = 1 THEN concat('£', CAST(CAST(floor(l_extendedprice / 100) AS BIGINT) AS VARCHAR), ' to £99')
      WHEN l_linenumber = 2 THEN concat('£1,', CAST(CAST(floor(l_extendedprice / 100) AS BIGINT) AS VARCHAR))
      WHEN l_linenumber = 3 THEN '£500' WHEN l_linenumber = 4 THEN NULL
      ELSE concat('£', CAST(CAST(floor(l_extendedprice / 100) AS BIGINT) AS VARCHAR)) END AS price_text FROM lineitem""",
    "v_priced": """
SELECT * FROM (SELECT *, TRY_CAST(split_part(replace(price_text, '£', ''), ' ', 1) AS DOUBLE) AS price FROM v_listing) WHERE price IS NOT NULL""",
    "v_banded": """
SELECT *, 'small' AS band FROM v_priced WHERE price <= 50
UNION ALL SELECT *, 'medium' FROM v_priced WHERE price > 50 AND price <= 500
UNION ALL SELECT *, 'large' FROM v_priced WHERE price >= 500""",
    "v_requests": """
SELECT c_custkey AS request_id, concat('BRAND#', CAST(c_custkey % 25 + 1 AS VARCHAR)) AS model, CAST(1990 + c_custkey % 20 AS INTEGER) AS year,
 CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'small' WHEN 2 THEN 'economy' ELSE NULL END AS engine_code,
 CASE WHEN c_custkey % 5 = 0 THEN 900.0 + c_custkey % 100 END AS min_price,
 CASE WHEN c_custkey % 7 = 0 THEN 5000.0 END AS min_opportunity FROM customer""",
    "v_asked": """
SELECT o_orderkey AS request_id,
 CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('Customer#', lpad(CAST(o_custkey AS VARCHAR), 9, '0')) END AS registration,
 concat('S', CAST(o_custkey + 1 AS VARCHAR)) AS stock_number FROM orders""",
}

# Views that read other views.
_NEEDS = {
    "v_scored": ["v_parts"],
    "v_owned": ["v_sold", "v_invoice", "v_users"],
    "v_stocked": ["v_vehicle", "v_stocknumber", "v_location"],
    "v_shown_log": ["v_log"],
    "v_priced": ["v_listing"],
    "v_banded": ["v_priced"],
}


def over(views: str, body: str) -> str:
    """``body`` with the named views, and those they need, as common table expressions."""
    wanted: dict[str, None] = {}

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        wanted[name] = None

    for name in views.split():
        add(name)
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in wanted)
    return f"WITH {ctes}\n{body.strip()}"
