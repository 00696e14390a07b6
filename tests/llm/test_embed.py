import numpy as np

from tests.llm.brute import components
from yardstats.llm import embed

SCHEMA = "vec_id long, embedding array<float>, label int, class string"


def _expected(vectors, cosine=0.95):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    label = components(len(vectors), np.argwhere(near).tolist())
    return {i: (int(near[i].sum()), label[i]) for i in range(len(vectors))}


def _groups(seed, count=400, size=32):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(count // 8, size))
    noise = rng.choice([0.0, 0.1, 0.2, 0.25], count)[:, None] * rng.normal(size=(count, size))
    return (centres[rng.integers(0, len(centres), count)] + noise).astype(np.float32)


def _found(rows, vectors):
    data = [(i, v.tolist(), 0, "") for i, v in enumerate(vectors)]
    return {r.vec_id: (r.n_links, r.component_id) for r in embed.near_duplicate_vectors(rows(data, SCHEMA)).collect()}


def test_recall_and_no_false_links(rows):
    vectors = _groups(1)
    expected, found = _expected(vectors.astype(float)), _found(rows, vectors)
    links = sum(n for n, _ in expected.values())
    assert links > 300 and all(found[i][0] <= expected[i][0] for i in expected)
    assert sum(n for n, _ in found.values()) >= 0.99 * links


def test_blocks_of_one_bucket(rows, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK", 16)
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=32) + 0.02 * rng.normal(size=(120, 32))).astype(np.float32)
    assert _found(rows, vectors) == _expected(vectors.astype(float))


def test_odd_vectors(rows):
    inf, nan = float("inf"), float("nan")
    data = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [1.0, 0.0, 0.0]), (9, [1e300, 1e299]), (9, [1e300, 1e299]), (None, [0.0, -1.0]), (None, [0.0, -2.0]), (10, [])]
    found = embed.near_duplicate_vectors(rows(data, "vec_id long, embedding array<double>")).collect()
    linked = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in found if r.n_links}
    assert len(found) == len(data)
    assert linked == {(1, 3, 1, True), (2, 3, 1, False), (9, 3, 1, False), (None, 1, None, True)}
    assert {(r.component_id, r.kept) for r in found if not r.n_links} == {(i, True) for i in (3, 4, 5, 6, 7, 8, 10)}


def test_empty(rows):
    assert embed.near_duplicate_vectors(rows([], SCHEMA)).count() == 0
