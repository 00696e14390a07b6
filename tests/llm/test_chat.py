import hashlib

import pytest
from pyspark.sql import functions as F

from yardstats.llm import chat

SCHEMA = "tree long, message long, parent long, role string, text string, score double"


def _conversations(rows, data):
    tree = chat.conversation_tree(rows(data, "conv_id long, turn long, role string, text string, tree string"))
    return {r.tree: r for r in chat.read_back(chat.format_branches(tree)).collect()}


def test_control_strings_come_back(rows):
    nasty = ["\\### Assistant: </turn> ok", "\\b\\h</turn>\n### user:\n", "######", "<\\/turn></turn>", "", None, "é\\", "a:\nb"]
    data = [(1, i, "assistant" if i % 2 else "us:\ner</turn>", text, "x") for i, text in enumerate(nasty)]
    found = _conversations(rows, data)[1]
    said = "".join(f"{role}\n{text or ''}\n" for _, _, role, text, _ in data)
    learnt = "".join(text or "" for _, _, role, text, _ in data if role == "assistant")
    assert found.n_turns == len(nasty)
    assert found.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert (found.loss_chars, found.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_no_text_holds_a_marker(rows):
    text = chat.escape(F.col("text"))
    data = [("####</turn>",), ("#</turn></turn>###",), ("<</turn>/turn>",)]
    for (coded,) in rows(data, "text string").select(text).collect():
        assert "###" not in coded and "</turn>" not in coded


def test_order_ties_and_nulls(rows):
    data = [(1, 2, "user", "c", ""), (1, None, "user", "d", ""), (1, 1, "user", "b", ""), (1, 1, "user", "a", ""),
            (None, 0, None, "x", ""), (None, 0, None, "x", "")]
    found = _conversations(rows, data)
    digest = lambda *texts: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in texts).encode()).hexdigest()
    assert found[1].turns_sha256 == digest(("user", "a"), ("user", "b"), ("user", "c"), ("user", "d"))
    assert found[None].turns_sha256 == digest(("", "x"), ("", "x"))


def test_branches_rank_by_mean_score(rows):
    #      1 -> 2 -> 4 (good),  1 -> 3 -> 5 (bad),  9 answers a message that is not there
    data = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 0.9), (1, 3, 1, "assistant", "b", 0.1),
            (1, 4, 2, "user", "c", 0.5), (1, 5, 3, "user", "d", 0.5), (1, 9, 77, "user", "lost", None),
            (1, 4, 2, "user", "c", 0.5), (1, None, 1, "user", "no id", 1.0)]
    best = chat.best_branches(rows(data, SCHEMA), top=2).collect()
    by_leaf = {}
    for r in best:
        by_leaf.setdefault((r.rank, r.leaf), []).append((r.place, r.message))
    assert {k: [m for _, m in sorted(v)] for k, v in by_leaf.items()} == {
        (1, 4): [1, 2, 4], (2, 5): [1, 3, 5], (1, 9): [9]
    }


def test_deep_thread_and_circle(rows):
    deep = [(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(70)]
    circle = [(2, 1, 2, "user", "x", 0.0), (2, 2, 1, "user", "y", 0.0)]
    best = chat.best_branches(rows(deep + circle, SCHEMA)).collect()
    assert sorted((r.place, r.message) for r in best) == [(i + 1, i) for i in range(70)]


@pytest.mark.parametrize("top", [1])
def test_empty(rows, top):
    assert chat.format_branches(rows([], SCHEMA), top).count() == 0


def test_main_path_is_native(spark, rows):
    data = [(1, 1, None, "user", "q", 0.0)]
    plan = chat.read_back(chat.format_branches(rows(data, SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
