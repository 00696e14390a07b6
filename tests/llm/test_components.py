import random

from tests.llm.brute import components
from yardstats.llm.components import connected_components


def _run(rows, edges):
    return {r.node: r.component for r in connected_components(rows(edges, "a long, b long")).collect()}


def test_chain_star_and_repeats(rows):
    chain = [(i + 1, i) for i in range(40)]
    star = [(100, i) for i in range(101, 140)] + [(100, 101)] * 3 + [(7, 7)]
    found = _run(rows, chain + star)
    assert set(found.values()) == {0, 100}
    assert [found[i] for i in range(41)] == [0] * 41 and found[139] == 100


def test_random_graph(rows):
    pick = random.Random(2)
    edges = [(pick.randrange(60), pick.randrange(60)) for _ in range(45)]
    label = components(60, edges)
    found = _run(rows, edges)
    assert found == {n: label[n] for a, b in edges if a != b for n in (a, b)}


def test_nothing(rows):
    assert _run(rows, []) == {}
    assert _run(rows, [(1, 1)]) == {}
