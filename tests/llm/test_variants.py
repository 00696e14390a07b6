"""Spelling variants against all pairs compared plainly."""

import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm.brute import LOWER
from yardstats.llm import variants


def plain_counts(rows, damaged):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            check = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if check % damaged == 0:
                run = run[: check % len(run)] + run[check % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return counts


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a != b and len(b) - len(a) <= 1 and a[at + (len(a) == len(b)) :] == b[at + 1 :]


def plain(rows, least_count=5, ratio=5, damaged=199):
    n = {w: c for w, c in plain_counts(rows, damaged).items() if c >= least_count}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root)
    return out


def got(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = variants.spelling_variants(docs, **more)
    assert set(found.columns) == {"word", "n", "n_near", "form", "form_n", "root"}
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found.collect()}
    assert len(out) == found.count()
    return out


def changed(word):
    at, letter = random.randrange(len(word) + 1), random.choice("abcéÿz")
    return random.choice([word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :], word[:at] + word[at + 1 :]])


@pytest.fixture(scope="module")
def words():
    random.seed(13)
    stems = ["".join(random.choices("abcéo", k=random.randint(6, 11))) for _ in range(40)] + ["longer" * 40]
    return stems + [changed(random.choice(stems)) for _ in range(250)]


@pytest.fixture(scope="module")
def rows(words):
    random.seed(14)
    texts = [" ".join(random.choices(words, weights=[30 if i < 40 else 1 for i in range(len(words))], k=200)) for _ in range(80)]
    return [(i, t.title() if i % 3 == 0 else t) for i, t in enumerate(texts)] + [(None, texts[0]), (5, None), (6, ""), (7, "123 __ x")]


def test_same_as_plain(spark, rows):
    want = plain(rows, least_count=2)
    assert got(spark, rows, least_count=2) == want
    assert any(v[4] != w and v[2] != v[4] for w, v in want.items()) or any(v[2] for v in want.values())


def test_production_parameters(spark, rows):
    assert got(spark, rows * 3) == plain(rows * 3)


def test_damage_of_every_run(spark, rows):
    assert got(spark, rows[:20], damaged=1, least_count=1) == plain(rows[:20], damaged=1, least_count=1)


@pytest.mark.parametrize("size", [1, 3, 40])
def test_large_groups_are_parted(spark, words, size):
    """Words that share a half, so that groups of ``size`` words are parted down to their last gap."""
    alike = sorted({*words, *("shared" + w for w in words), *(w + "shared" for w in words)})
    table = spark.createDataFrame([(w, i) for i, w in enumerate(alike)], "word string, n long")
    found = {(r.word, r.near): r.near_n for r in variants.near_words(table, group_rows=size).collect()}
    assert found == {(a, b): j for a in alike for j, b in enumerate(alike) if one_edit(a, b)}


def test_small_blocks(spark, words, monkeypatch):
    monkeypatch.setattr(variants, "ASKED", 7)
    monkeypatch.setattr(variants, "CELLS", 64)
    table = spark.createDataFrame([(w, i) for i, w in enumerate(dict.fromkeys(words))], "word string, n long")
    found = {(r.word, r.near) for r in variants.near_words(table).collect()}
    assert found == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_words_outside_latin(spark):
    table = spark.createDataFrame([("слово", 1), ("слова", 2), ("слов", 3), ("𝒂b𝒄", 4), ("𝒂𝒄", 5), ("a", 6), ("b", 7)], "word string, n long")
    found = {(r.word, r.near) for r in variants.near_words(table).collect()}
    want = {("слово", "слова"), ("слово", "слов"), ("слова", "слов"), ("𝒂b𝒄", "𝒂𝒄"), ("a", "b")}
    assert found == want | {(b, a) for a, b in want}


def test_forms_lead_on(spark):
    text = " ".join(["planet"] * 200 + ["planets"] * 30 + ["planetss"] * 5 + ["zlanet"] * 40 + ["qlanet"] * 40)
    found = got(spark, [(1, text)])
    assert found["planetss"] == (5, 1, "planets", 30, "planet")
    assert found["planets"][2] == "planet" and found["qlanet"][:3] == (40, 2, "planet")
    assert found["planet"][1:] == (3, None, None, "planet")


def test_empty_and_clashing(spark):
    assert got(spark, []) == {}
    assert got(spark, [(1, None), (2, "")]) == {}
    docs = spark.createDataFrame([(1, "flower " * 100_000, "x", 1)], "doc_id long, text string, word string, n int")
    assert [tuple(r) for r in variants.spelling_variants(docs).select("word", "n", "n_near", "root").collect()] == [("flower", 100_000, 0, "flower")]
