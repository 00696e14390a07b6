import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from yardstats.llm import quality

BASE = "/root/testdata/sf0.01"


def test_chunks_cover_the_text():
    sizes = np.array([0, 1, 255, 256, 257, 480, 481, 5000])
    text, start = quality.chunk_starts(sizes)
    for number, size in enumerate(sizes):
        seen = np.zeros(max(size, 1), bool)
        for low in start[text == number]:
            assert low >= 0 and (low + quality.CHUNK <= size or size < quality.CHUNK)
            seen[low : low + quality.CHUNK] = True
        assert seen.all()


def test_held_out_rows_are_those_of_crc32(rows):
    found = rows([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", quality.held_out(F.col("doc_id")).alias("h"))
    for r in found.collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_accuracy_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{BASE}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.rate_documents(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = [r.predicted == r.quality for r in found]
    assert len(right) > 80 and sum(right) / len(right) >= 0.97


def test_the_end_of_a_long_text_counts():
    good, bad = b"the quick brown fox jumps over it. " * 40, b"### $$$ %%% &&& " * 80
    texts = pa.array([(good[k:]).decode() for k in range(30)] + [(bad[k:]).decode() for k in range(30)])
    model = quality.fit(texts, np.array([1] * 30 + [0] * 30), steps=150)
    clean, spoilt = (good * 40).decode(), (good * 40 + bad * 40).decode()
    scores = quality.score_texts(model, pa.array([clean, spoilt, None, ""]))
    assert scores[0] > 0.9 > scores[1] and np.isclose(scores[2], scores[3]) and ((scores >= 0) & (scores <= 1)).all()


def test_without_labels_all_is_kept(rows):
    docs = rows([(1, "x", "a"), (None, None, "b"), (1, "x", "a")], "doc_id long, text string, score string")
    for data in ([], [(1, 1)], [(1, None)]):
        labels = rows(data, "doc_id long, quality int")
        assert {(r.score, r.predicted) for r in quality.rate_documents(docs, labels).collect()} == {(0.5, 1)}
        assert quality.keep_good(docs, labels).count() == 3
    assert quality.rate_documents(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("texts", [["a"] * 3, ["", None, "b" * 1000]])
def test_scores_do_not_depend_on_neighbours(texts):
    model = quality.fit(pa.array(["good text here", "### bad"] * 5), np.array([1, 0] * 5), steps=20)
    whole = quality.score_texts(model, pa.array(texts))
    alone = [quality.score_texts(model, pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(whole, alone)
