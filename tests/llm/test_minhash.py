import random

import numpy as np
import pytest

from tests.llm.brute import near_duplicates
from yardstats.llm import minhash

SCHEMA = "doc_id long, text string, node string, key long"


def _found(docs, percent=85):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, percent).collect())


def _texts(seed, groups=12, size=14):
    """Groups of copies with more and more changed words, short texts, shared passages."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(4))
    passage, out = " ".join(word() for _ in range(60)), []
    for _ in range(groups):
        base = [word() for _ in range(pick.choice([5, 9, 30, 120, 400]))]
        for _ in range(size):
            copy = list(base)
            for _ in range(pick.choice([0, 0, 1, 2, 4])):
                copy[pick.randrange(len(copy))] = word()
            out.append((passage + " " if pick.random() < 0.2 else "") + " ".join(copy))
    return out + ["", " ", "a b c d e", "A B\tC d e", "a b", "a b", "a"]


@pytest.mark.parametrize("percent", [85, 80])
def test_same_as_all_pairs(rows, percent):
    texts = _texts(percent)
    data = [(i, t, "x", 1) for i, t in enumerate(texts)]
    assert _found(rows(data, SCHEMA), percent) == near_duplicates([d[:2] for d in data], percent)


def test_blocks_of_a_large_group(rows, monkeypatch):
    # Copies around the threshold: many are apart after the first rounds and meet in blocks.
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "TEXT_BLOCK", 4)
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 1)
    pick = random.Random(9)
    base = [f"w{i}" for i in range(90)]
    data = []
    for i in range(90):
        copy = list(base)
        copy[pick.randrange(90)] = f"x{i}"
        data.append((i, " ".join(copy), "", 0))
    assert _found(rows(data, SCHEMA)) == near_duplicates([d[:2] for d in data], 85)


def test_members_of_a_large_group_meet_few_centres(rows, monkeypatch):
    seen, estimated = [], minhash._estimated
    monkeypatch.setattr(minhash, "_estimated", lambda pairs, *rest: seen.append(pairs.count()) or estimated(pairs, *rest))
    base = [f"w{i}" for i in range(600)]
    data = [(i, " ".join([*base[: 4 * i], f"x{i}", *base[4 * i + 1 :]]), "", 0) for i in range(140)]
    assert {r.component_id for r in minhash.near_duplicates(rows(data, SCHEMA), 80).collect()} == {0}
    assert 0 < sum(seen) <= 8 * len(data), seen  # an order of centres per key makes about 30 pairs a node


def test_shuffled_join_of_texts(rows, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 0)
    data = [(i, t, "x", 1) for i, t in enumerate(_texts(3, groups=3))]
    assert _found(rows(data, SCHEMA)) == near_duplicates([d[:2] for d in data], 85)
    assert minhash.keep_one(rows(data, SCHEMA)).count() < len(data)


def test_nulls_and_repeated_rows(rows):
    text = "one two three four five six seven"
    data = [(None, text, "", 0), (7, text, "", 0), (7, text, "", 0), (3, text, "", 0), (3, "other words that are not alike at all", "", 0),
            (5, None, "", 0), (None, None, "", 0), (None, "null id alone and nothing else here", "", 0)]
    docs = rows(data, SCHEMA)
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert found == {
        (None, 3, 3, False), (7, 3, 3, False), (3, 3, 3, True), (3, 4, 3, True), (5, 0, 5, True), (None, 0, None, True),
        (None, 3, None, True),
    }
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(
        map(str, docs.filter("not (coalesce(text, '') like 'one%' and (doc_id is null or doc_id = 7))").collect())
    )


def test_one_of_wholly_equal_rows_stays(rows):
    data = [(1, "a b c d e f", "x", 1)] * 4 + [(2, "", "y", 2)] * 2
    assert sorted(tuple(r) for r in minhash.keep_one(rows(data, SCHEMA)).collect()) == [data[0], data[4], data[4]]


def test_empty(rows):
    assert minhash.near_duplicates(rows([], SCHEMA)).count() == 0 and minhash.keep_one(rows([], SCHEMA)).count() == 0


def test_registers_estimate_the_similarity():
    pick = np.random.default_rng(1)
    both, rest = pick.integers(0, 1 << 63, 3000).astype(np.uint64) * 2, pick.integers(0, 1 << 63, 600).astype(np.uint64) * 2
    left, right = (np.unique(np.concatenate([both, part])) for part in (rest[:300], rest[300:]))
    a, b = minhash.registers(left), minhash.registers(right)
    assert abs((a == b).mean() - 3000 / 3600) < 0.1
    assert minhash.may_reach(a, b, 85) and not minhash.may_reach(a, minhash.registers(rest), 85)
