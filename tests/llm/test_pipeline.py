import re

import corpus_pipeline
from tests.llm.brute import near_duplicates
from yardstats.llm import mix
from yardstats.llm.shared import write_through

BASE = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    seen = {"": docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = write_through(stage(spark, docs, BASE), f"test-{name}")
        seen[name] = docs.collect()
        if name != "mixing":
            assert docs.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{BASE}/labels.parquet").collect()}
    left = {r.doc_id for r in seen["quality"]}
    assert all((doc in left) == (label == 1) for doc, label in labels.items() if doc in {r.doc_id for r in seen[""]})

    groups = near_duplicates([(r.doc_id, r.text) for r in seen["quality"]], 80)
    assert {r.doc_id for r in seen["near_duplicates"]} == {doc for doc, size, least in groups if doc == least or not size}

    plain = lambda text: " " + " ".join(re.findall(r"\w+", (text or "").lower())) + " "
    items = [plain(r.text) for r in spark.read.parquet(f"{BASE}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in seen["near_duplicates"] if not any(i in plain(r.text) for i in items)}
    assert {r.doc_id for r in seen["decontamination"]} == clean == {r.doc_id for r in seen["personal_data"]}

    before = {r.doc_id: r for r in seen["decontamination"]}
    for r in seen["personal_data"]:
        assert "@mail" not in r.text
        assert r.text == before[r.doc_id].text or "[" in r.text
        assert r.n_chars == len(r.text)

    plan = {r.doc_id: r.copies for r in mix.plan_mix(spark.createDataFrame(seen["personal_data"])).collect()}
    copies = {}
    for r in seen["mixing"]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {doc: n for doc, n in plan.items() if n}
