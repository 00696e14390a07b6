import pytest

from yardstats.llm import mix

SCHEMA = "doc_id long, text string, source string, size int"


def _filled(sizes):
    """Targets by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mix.WEIGHTS[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def _docs(rows, sizes):
    data, at = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            data.append((at, "one two three", source, 1))
            at += 1
    return rows(data, SCHEMA)


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 200, None: 30, "é": 5, "z": 100}, {"a": 1}, {"a": 3, "b": 3, "c": 3, "d": 3}, {None: 40, "x": 2},
])
def test_targets(rows, sizes):
    plan = mix.plan_mix(_docs(rows, sizes)).collect()
    wanted = _filled({s: 3 * n for s, n in sizes.items()})
    for r in plan:
        assert r.source_size == 3 * sizes[r.source] and r.target == pytest.approx(wanted[r.source])
        assert 0 <= r.copies <= 2 and r.size == 3


def test_taken_words_come_near_the_target_and_reruns_agree(rows):
    docs = _docs(rows, {"a": 900, "b": 600, "c": 300})
    first, again = ({r.doc_id: r.copies for r in mix.plan_mix(docs.repartition(n)).collect()} for n in (2, 5))
    assert first == again
    by = {}
    for r in mix.plan_mix(docs).collect():
        by.setdefault(r.source, [r.target, 0])[1] += r.size * r.copies
    for target, taken in by.values():
        assert abs(taken - target) <= 0.1 * target


def test_emitted_rows_are_the_planned_ones(rows):
    docs = _docs(rows, {"a": 40, None: 25}).withColumnRenamed("size", "target")
    planned = {r.doc_id: r.copies for r in mix.plan_mix(docs).collect()}
    emitted = {}
    out = mix.emit_mix(docs)
    assert out.columns == [*docs.columns, "_copy"]
    for r in out.collect():
        emitted[r.doc_id] = max(emitted.get(r.doc_id, 0), r._copy)
    assert emitted == {d: n for d, n in planned.items() if n}


def test_empty_texts_and_tables(rows):
    data = [(1, None, "a", 0), (1, "", "a", 0), (None, " \n", None, 0)]
    assert [(r.size, r.target, r.copies) for r in mix.plan_mix(rows(data, SCHEMA)).collect()] == [(0, 0.0, 0)] * 3
    assert mix.plan_mix(rows([], SCHEMA)).count() == 0 and mix.emit_mix(rows([], SCHEMA)).count() == 0
