"""Token ids against the tokenizer's own library, and exact round trips."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from yardstats.llm import bpe
from yardstats.llm.queries import op11_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
RANKS = bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})

TEXTS = [
    None, "", " ", "a", "the cat's 12 mats, isn't it?  \n\n\t end ", "the the the thethethe thethe", "\x00\x1f <|endoftext|>",
    "naïve Ünïcödé ñandú 北京大学 🤷🏽‍♀️ x　y z\u0085w", "\U00031350\U0001e030 ࡰᲊ 9\U00010d40",  # newer letters and numbers
    "ab" * 600, "=" * 300 + "a" * 333, "word " * 5000, "I've we'll they'd 'S 's", "é ﻿ ​",
]


@pytest.fixture(scope="module")
def encoded(spark):
    rows = [(i, text, "kept", "gone") for i, text in enumerate([*TEXTS, TEXTS[4]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, ids string")
    found = bpe.encode(docs, RANKS, PATTERN)
    assert found.columns == ["doc_id", "text", "word", "ids"]
    return found.withColumn("back", bpe.decode(F.col("ids"), RANKS)).orderBy("doc_id").collect()


def test_ids_are_those_of_the_library(encoded):
    assert len(encoded) == len(TEXTS) + 1
    for row in encoded:
        assert row.ids == LIBRARY.encode_ordinary(row.text or ""), row.text
        assert row.word == "kept"


def test_decoding_gives_the_bytes_back(encoded):
    assert all(bytes(row.back) == (row.text or "").encode() for row in encoded)


@pytest.mark.parametrize("most", [0, 3])
def test_words_that_travel_change_nothing(spark, most):
    docs = spark.createDataFrame([(t,) for t in TEXTS[:8]], "text string")
    got = bpe.encode(docs, RANKS, PATTERN, frequent=most).collect()
    assert [r.ids for r in got] == [LIBRARY.encode_ordinary(r.text or "") for r in got]


def test_frequent_words_stay_within_the_bound(spark):
    docs = spark.createDataFrame([("a " * 50 + "b b b b c c c d d e",)], "text string")
    pattern = bpe.java_pattern(spark, PATTERN)
    assert {r.word for r in bpe.frequent_words(docs, pattern, 2).collect()} <= {" a", " b"}
    assert bpe.frequent_words(docs, pattern, 0).count() == 0


def test_lower_rank_made_by_a_merge_goes_first(spark):
    """Merging a and b makes a pair below ranks that stood already."""
    ranks = {bytes([i]): i + 10 for i in range(256)} | {b"ab": 1, b"abc": 2, b"bc": 5, b"cd": 3, b"aa": 4}
    library = tiktoken.Encoding("small", pat_str=r"\p{L}+", mergeable_ranks=ranks, special_tokens={})
    texts = ["abcd", "aaab", "abcdabcd", "aaaaa", "bcbcdcd"]
    got = bpe.encode(spark.createDataFrame([(t,) for t in texts], "text string"), ranks, r"\p{L}+").collect()
    assert [r.ids for r in got] == [library.encode_ordinary(t) for t in texts]


def test_empty_table_and_unknown_id(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, RANKS, PATTERN).collect() == []
    one = spark.createDataFrame([([1, 10**6],)], "ids array<int>").select(bpe.decode(F.col("ids"), RANKS).alias("b"))
    assert one.first().b is None


def test_query_over_its_table(spark):
    base = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text").collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        digests = (",".join(map(str, ids)).encode(), (r.text or "").encode())
        want[r.doc_id] = (len(ids), *(hashlib.sha256(x).hexdigest() for x in digests))
    got = op11_bpe(spark, base).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)


def test_fold_merges_as_the_library_does(spark):
    pick = random.Random(5)
    words = ["".join(pick.choice(letters) for _ in range(pick.choice([1, 3, 9, 40, 300]))) for letters in ("abe ", "the aniro", "=-", "éü北京aſ") for _ in range(200)]
    ids = [LIBRARY._encode_single_piece(w) for w in words]
    assert [list(bpe.fold(RANKS, w.encode())) for w in words] == ids


def test_looking_up_words_takes_no_interpreted_step(spark):
    """A lambda over a text's words, and a map scanned for each, took most of the query's time."""
    docs = spark.createDataFrame([("a b",)], "text string")
    found = bpe.encode(docs, RANKS, PATTERN).withColumn("back", bpe.decode(F.col("ids"), RANKS))
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "lambda" not in plan and "regexp_extract_all" not in plan and plan.count("encoded(") == 1


def test_time_of_a_long_word(spark):
    """It grew with the square of the word: 4,000 letters took a second."""
    text = "abcde" * 40_000
    start = time.perf_counter()
    row = bpe.encode(spark.createDataFrame([(text,)], "text string"), RANKS, PATTERN).first()
    assert time.perf_counter() - start < 60 and row.ids == LIBRARY.encode_ordinary(text)


def test_batches_with_unknown_and_no_ids(spark):
    rows = [([],), ([RANKS[b"a"], 10**6],), ([RANKS[b"b"], RANKS[b"c"]],), (None,), ([-1],), ([None],), ([RANKS[b"d"]],)]
    got = spark.createDataFrame(rows, "ids array<int>").coalesce(1).select(bpe.decode(F.col("ids"), RANKS).alias("b")).collect()
    assert [r.b and bytes(r.b) for r in got] == [b"", None, b"bc", None, None, None, b"d"]


def _seconds(call, *args):
    start = time.process_time()
    return call(*args), time.process_time() - start


def test_cutting_does_not_look_through_far_ranges():
    """Each character in no class was held against all ranges beyond the first plane: five times the time."""
    pick = random.Random(7)
    text = " ".join("".join(pick.choices("aeihnorsté", k=pick.randint(1, 12))) + pick.choice(["", ",", "."]) for _ in range(200_000))
    words, taken = _seconds(bpe._cutter(PATTERN), text)
    wide, before = _seconds(re.compile(bpe.spelled_pattern(PATTERN)).findall, text)
    assert words == wide and taken < before / 2


@pytest.mark.parametrize("text", ["\U00020000a \U0001F600b9\U0001D7CE \U00010D40", "\uffff\ufffda\uffdc", "\U00010000 a", ""])
def test_letters_beyond_the_first_plane_are_cut_alike(text):
    assert bpe._cutter(PATTERN)(text) == re.findall(bpe.spelled_pattern(PATTERN), text)


def _numbers(ids):
    return [np.frombuffer(one, np.int32).tolist() for one in ids]


def test_words_merged_together_are_merged_as_the_library_does():
    pick = random.Random(6)
    sizes = [1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 65, 66, 200]
    words = ["".join(pick.choices(letters, k=size)) for letters in ("abe ", "the aniro", "=-", "a", "éü北京aſ", "\x00\x7f") for size in sizes for _ in range(20)]
    got = bpe._Merges(RANKS).fold([word.encode() for word in words] + [b""])
    assert _numbers(got) == [LIBRARY._encode_single_piece(word) for word in words] + [[]]


def test_words_merged_together_where_a_merge_makes_a_lower_rank():
    ranks = {bytes([i]): i + 10 for i in range(256)} | {b"ab": 1, b"abc": 2, b"bc": 5, b"cd": 3, b"aa": 4, b"dddd": 6}
    library = tiktoken.Encoding("small", pat_str=r"\p{L}+", mergeable_ranks=ranks, special_tokens={})
    words = ["".join(letters) for size in range(1, 7) for letters in itertools.product("abcd", repeat=size)]
    assert _numbers(bpe._Merges(ranks).fold([word.encode() for word in words])) == [library._encode_single_piece(word) for word in words]


def test_merging_words_together_takes_less_time_than_one_by_one():
    """They were merged one by one, in most of the query's time."""
    pick = random.Random(8)
    words = list({"".join(pick.choices(["the", "an", "er", "on", "ti", "éa", "q"], k=pick.randint(2, 6))).encode() for _ in range(40_000)})
    merges = bpe._Merges(RANKS)
    together, taken = _seconds(merges.fold, words)
    single, before = _seconds(lambda: [list(bpe.fold(RANKS, word)) for word in words])
    assert _numbers(together) == single and taken < 0.7 * before


@pytest.mark.parametrize("most", [0, 2, 100])
def test_rows_in_portions(monkeypatch, most):
    """Rows shorter and longer than a portion, empty ones, and words too long to be kept."""
    monkeypatch.setattr(bpe, "AT_ONCE", 3)
    ids = bpe._Ids(bpe._Merges(RANKS), most)
    long = "xyz" * 50
    rows = [[], ["a"], ["the", " cat", long, "s", "the", long, "qqzz"], [], ["a", "b", "c"], ["a"], [long], []]
    got = bpe._lists(iter(rows), ids)
    assert got.to_pylist() == [[i for word in row for i in LIBRARY._encode_single_piece(word)] for row in rows]
    assert len(ids) <= most and long not in ids
    assert bpe._lists(iter([]), ids).to_pylist() == [] and bpe._lists(iter([[], []]), ids).to_pylist() == [[], []]
