"""Reply trees formatted as conversations. DataFrame functions only.

Self-joins double the reach of every message's pointer to its ancestors, so a tree of
depth d takes about log2(d) rounds however deep its threads are. A round also adds up
the scores on the way, which ranks every root-to-leaf branch before one is spelled
out; the stored rounds then list the messages of the chosen branches, each once.

The template: ``### role:``, a new line, the text, ``</turn>`` and a new line. In
roles and texts a backslash becomes ``\\b`` and a control string is broken up by an
escape, so no text can look like a marker and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from yardstats.llm.shared import write_through

HEAD, ROLE_END, TURN_END = "### ", ":\n", "</turn>\n"
TEXT_ESCAPES = [("\\", "\\b"), ("###", "##\\h"), ("</turn>", "<\\/turn>")]
ROLE_ESCAPES = [*TEXT_ESCAPES, (":", "\\c"), ("\n", "\\n")]
CODES = [("\\h", "#"), ("\\/", "/"), ("\\c", ":"), ("\\n", "\n"), ("\\b", "\\")]


def escape(text: Column, escapes: list[tuple[str, str]] = TEXT_ESCAPES) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, code in escapes:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    """Every backslash in escaped text starts a code, so the order matters for ``\\b`` only."""
    for code, plain in CODES:
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def conversation_tree(conversations: DataFrame) -> DataFrame:
    """Conversations as reply trees: each row answers the one before it.

    Rows by turn, null last; ties by role and text. A null conv_id is a conversation
    of its own. Null role or text: empty. A conversation becomes one row of text in
    the end, so numbering its rows in one task asks for no more memory than that.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", role.alias("role"), text.alias("text"))
    place = W.partitionBy("tree").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = rows.withColumn("message", F.row_number().over(place).cast("long"))
    parent = F.when(F.col("message") > 1, F.col("message") - 1)
    return rows.select("tree", "message", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _same(a: str, a_key: str, b: str, b_key: str) -> Column:
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree")) & (F.col(f"{a}.{a_key}") == F.col(f"{b}.{b_key}"))


def _doubled(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """What is known of every message at its root, and the rounds that led there.

    Both have tree, message, up, nodes, total, root; in round k ``up`` is the 2^k-th
    ancestor. Only messages that have not reached their root take part in a round. A
    parent that is not there makes a root. Messages on a circle of replies reach none;
    the rounds end when the reach is above the number of messages.
    """
    known = messages.select("tree", "message")
    step = messages.alias("m").join(known.alias("p"), _same("m", "parent", "p", "message"), "left")
    parent = F.col("p.message")
    step = step.select(
        "m.tree", "m.message", parent.alias("up"), F.lit(1).cast("long").alias("nodes"),
        F.coalesce(F.col("m.score"), F.lit(0.0)).alias("total"), F.when(parent.isNull(), F.col("m.message")).alias("root"),
    )
    step = write_through(step, "reply-round")
    most, ended, rounds = step.count(), step.filter("up is null"), [step.filter("up is not null")]
    while 1 << len(rounds) <= 2 * most and not rounds[-1].isEmpty():
        going = rounds[-1]
        joined = going.alias("a").join(ended.union(going).alias("b"), _same("a", "up", "b", "message"))
        step = joined.select(
            "a.tree", "a.message", "b.up", (F.col("a.nodes") + F.col("b.nodes")).alias("nodes"),
            (F.col("a.total") + F.col("b.total")).alias("total"), "b.root",
        )
        step = write_through(step, "reply-round")
        ended = ended.union(step.filter("up is null"))
        rounds.append(step.filter("up is not null"))
    return ended, rounds


def best_branches(messages: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` branches of each root: tree, leaf, rank, score, place, message.

    ``messages``: tree, message, parent, score. One row per message of a branch,
    ``place`` counts from the root. Branches rank by mean score (null: 0), then
    length, then leaf. Of repeated (tree, message) the one with the smallest parent
    counts; a message without id is no message.
    """
    first = F.min(F.struct(F.col("parent"), F.col("score"))).alias("first")
    messages = messages.filter("message is not null").groupBy("tree", "message").agg(first)
    messages = messages.select("tree", "message", "first.parent", "first.score")
    ends, rounds = _doubled(messages)
    parents = rounds[0].select("tree", F.col("up").alias("message")).distinct()
    leaves = ends.alias("e").join(parents.alias("p"), _same("e", "message", "p", "message"), "left_anti")
    leaves = leaves.withColumn("score", F.col("total") / F.col("nodes"))
    order = W.partitionBy("tree", "root").orderBy(F.desc("score"), F.desc("nodes"), "message")
    leaves = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    path = leaves.select(
        "tree", F.col("message").alias("leaf"), "rank", "score", F.col("nodes").alias("place"), "message"
    )
    for step in reversed(rounds):  # each ancestor is reached once: by the bits of its distance
        joined = path.alias("a").join(step.alias("b"), _same("a", "message", "b", "message"), "left")
        here = F.struct(F.col("a.place").alias("place"), F.col("a.message").alias("message"))
        above = F.struct((F.col("a.place") - F.col("b.nodes")).alias("place"), F.col("b.up").alias("message"))
        both = F.when(F.col("b.up").isNull(), F.array(here)).otherwise(F.array(here, above))
        path = joined.select("a.tree", "a.leaf", "a.rank", "a.score", F.inline(both))
    return path


def format_branches(messages: DataFrame, top: int = 1, learn: str = "assistant") -> DataFrame:
    """One conversation per chosen branch: tree, leaf, rank, score, n_turns, text, loss_spans.

    ``loss_spans`` has an entry per turn: where the text of a ``learn`` turn stands in
    ``text`` (code points, end exclusive), null for other turns. No messages: no rows.
    """
    path = best_branches(messages.select("tree", "message", "parent", "score"), top)
    # The smallest of repeated messages, as in best_branches.
    said = F.min(F.struct(F.col("parent"), F.col("score"), F.col("role"), F.col("text"))).alias("said")
    texts = messages.filter("message is not null").groupBy("tree", "message").agg(said)
    turns = path.alias("a").join(texts.alias("b"), _same("a", "message", "b", "message"))
    role, text = escape(F.col("said.role"), ROLE_ESCAPES), escape(F.col("said.text"))
    head = F.concat(F.lit(HEAD), role, F.lit(ROLE_END))
    turns = turns.select(
        "a.tree", "a.leaf", "a.rank", "a.score", "a.place", (F.col("said.role") == learn).alias("learn"),
        F.length(head).cast("long").alias("head_chars"), F.length(text).cast("long").alias("text_chars"),
        F.concat(head, text, F.lit(TURN_END)).alias("piece"),
    )
    before = W.partitionBy("tree", "leaf").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) + F.col("head_chars")
    span = F.struct(F.col("start"), (F.col("start") + F.col("text_chars")).alias("end"))
    turn = F.struct("place", "piece", F.when(F.col("learn"), span).alias("span"))
    grouped = turns.withColumn("start", start).groupBy("tree", "leaf").agg(
        F.max("rank").alias("rank"), F.max("score").alias("score"), F.array_sort(F.collect_list(turn)).alias("turns")
    )
    return grouped.select(
        "tree", "leaf", "rank", "score", F.size("turns").cast("long").alias("n_turns"),
        F.array_join("turns.piece", "").alias("text"), F.col("turns.span").alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What a formatted text holds: per conversation the turns' digest and the text under the loss mask."""
    pieces = F.slice(F.split("text", TURN_END), F.lit(1), F.col("n_turns").cast("int"))
    parts = formatted.select(
        "tree", "leaf", "n_turns", F.length("text").cast("long").alias("formatted_chars"),
        F.posexplode(F.arrays_zip(pieces.alias("piece"), F.col("loss_spans").alias("span"))),
    ).select("tree", "leaf", "n_turns", "formatted_chars", "pos", "col.piece", "col.span")
    before = W.partitionBy("tree", "leaf").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece").cast("long") + len(TURN_END)).over(before), F.lit(0))
    role = F.substring_index(F.substr("piece", F.lit(len(HEAD) + 1)), ROLE_END, 1)
    text = F.substr(F.col("piece"), F.length(role) + len(HEAD) + len(ROLE_END) + 1)
    learnt = F.substr(
        F.col("piece"), (F.col("span.start") - F.col("start") + 1).cast("int"),
        (F.col("span.end") - F.col("span.start")).cast("int"),
    )
    turn = F.struct(
        "pos", F.concat(unescape(role), F.lit("\n"), unescape(text), F.lit("\n")).alias("said"),
        F.coalesce(unescape(learnt), F.lit("")).alias("learnt"),
    )
    turns = parts.withColumn("start", start).groupBy("tree", "leaf").agg(
        F.max("n_turns").alias("n_turns"), F.max("formatted_chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(turn)).alias("turns"),
    )
    learnt = F.array_join("turns.learnt", "")
    return turns.select(
        "tree", "leaf", "n_turns", F.sha2(F.array_join("turns.said", ""), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars",
    )


CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
coded AS (
  SELECT *, replace(replace(replace(replace(replace(role, '\', '\b'), '###', '##\h'), '</turn>', '<\/turn>'),
      ':', '\c'), chr(10), '\n') AS coded_role,
    replace(replace(replace(text, '\', '\b'), '###', '##\h'), '</turn>', '<\/turn>') AS coded_text FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(coded_role) + length(coded_text) + 14)::BIGINT AS formatted_chars
FROM coded GROUP BY conv_id
"""
