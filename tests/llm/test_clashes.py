"""Stages keep columns whose names they might use themselves, with their values."""

import pytest

from yardstats.llm import decontam, minhash, mix, pii, quality

NAMES = ["masked", "_masked", "score", "_score", "kept_id", "_id", "kept_mark", "_mark", "wins", "rows", "mark", "leak", "doc", "_leak_id",
         "mix_size", "_mix_size", "mix_target", "Mix_Source", "_size", "spans", "words", "label"]
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


@pytest.fixture
def docs(rows):
    texts = ["one two three four five six seven", "one two three four five six seven", f"so {ITEM} it goes on", None, "", "write to a@b.org now " * 3]
    data = [(i, text, "en", f"s{i % 2}", *[f"{name}{i}" for name in NAMES]) for i, text in enumerate(texts)]
    return rows(data, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in NAMES))


def labels(rows):
    return rows([(i, i % 2) for i in range(6)], "doc_id long, quality int")


STAGES = {
    "quality": lambda docs, rows: quality.keep_good(docs, labels(rows)),
    "near_duplicates": lambda docs, rows: minhash.keep_one(docs),
    "decontamination": lambda docs, rows: decontam.drop_contaminated(docs, rows([(1, ITEM)], "item_id long, text string")),
    "personal_data": lambda docs, rows: pii.mask_personal_data(docs),
    "mixing": lambda docs, rows: mix.emit_mix(docs),
}
LEFT = {"near_duplicates": {0, 2, 3, 4, 5}, "decontamination": {0, 1, 3, 4, 5}, "personal_data": set(range(6))}


@pytest.mark.parametrize("stage", STAGES)
def test_columns_stay(docs, rows, stage):
    found = STAGES[stage](docs, rows)
    assert found.columns == docs.columns + (["_copy"] if stage == "mixing" else [])
    kept = found.collect()
    for row in kept:
        assert all(row[name] == f"{name}{row.doc_id}" for name in NAMES)
    if stage in LEFT:
        assert {r.doc_id for r in kept} == LEFT[stage]


def test_a_column_of_copies_is_replaced(docs, rows):
    found = mix.emit_mix(docs.withColumnRenamed("score", "_copy"))
    assert found.columns[-1] == "_copy" and found.columns.count("_copy") == 1
    assert {r._copy for r in found.collect()} <= {1, 2}
