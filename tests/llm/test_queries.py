"""Every registered corpus query, against its SQL where SQL can state it."""

import pytest

from check_oracle import compare, connect, oracle_rows, spark_rows
from yardstats.llm.queries import ORACLE_SQL, QUERIES

BASE = "/root/testdata/sf0.001"
#: Those without SQL are compared with brute force in the operator's own tests.
COLUMNS = {
    "op3_embedding_dedup": {"vec_id", "n_links", "component_id", "kept"},
    "op4_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op6_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op8_quality": {"doc_id", "held_out", "score", "predicted"},
    "op9_minhash": {"doc_id", "n_shingles", "component_id", "kept"},
}
TABLE = {"op3": "embeddings", "op6": "pages"}


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_same_as_sql(spark, name):
    got = spark_rows(QUERIES[name](spark, BASE))
    assert compare(got, oracle_rows(connect(BASE), ORACLE_SQL[name]), False) == ""


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_rows(spark, name):
    found = QUERIES[name](spark, BASE)
    assert COLUMNS[name] <= set(found.columns)
    table = TABLE.get(name[:3], "documents")
    assert found.count() == spark.read.parquet(f"{BASE}/{table}.parquet").count()
