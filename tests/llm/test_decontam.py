import re

from pyspark.sql import functions as F

from yardstats.llm import decontam

DOCS = "doc_id long, text string, item_id string"
ITEMS = "item_id long, text string"
QUESTION = "If Tom buys 12 apples for 3 dollars each and Anna buys 7 pears, how much money does Tom spend in the shop today?"
OTHER = "if Peter buys 40 apples for 9.5 dollars each and Maria Lopez buys 8 pears, how much money does {} spend in the shop today"


def _found(rows, docs, items):
    found = decontam.find_contamination(rows([(d, t, "") for d, t in docs], DOCS), rows(items, ITEMS)).collect()
    return {(r.doc_id, r.item_id): r for r in found}


def test_copies_and_other_parameters(rows):
    docs = [(1, f"Intro words. {QUESTION} Bye."), (2, "so " + OTHER.format("Peter")), (3, "so " + OTHER.format("Klaus")),
            (None, QUESTION), (5, QUESTION.replace(" ", "\n").replace(",", "")), (6, "a quite different text about nothing at all here")]
    found = _found(rows, docs, [(1, QUESTION)])
    assert set(found) == {(1, 1), (2, 1), (None, 1), (5, 1)}
    assert found[1, 1].changed_slots == 0 and found[1, 1].share == 1
    assert found[2, 1].changed_slots >= 5


def test_part_of_an_item_and_scattered_words(rows):
    item = " ".join(f"word{'abcdefghijklmnopqrstuvwxyz'[i]}" for i in range(26))
    words = item.split()
    docs = [(1, "x " + " ".join(words[5:18]) + " y"), (2, " ".join(words[5:16])), (3, " ".join(w + " z" for w in words)),
            (4, " ".join(words[:24] + ["zz"]))]
    assert set(_found(rows, docs, [(1, item)])) == {(1, 1), (4, 1)}


def test_placeholders_alone_do_not_match(rows):
    assert _found(rows, [(1, "9 8 7 6 5 4 3 2 1 0"), (2, "1 km 2 km 3 km 4 km")], [(1, "1 2 3 4 5 6 7 8"), (2, "5 km 6 km 7 km 8 km")]) == {}


def test_nulls_and_empty(rows):
    docs, items = [(1, None), (None, ""), (2, "<number> <name>")], [(1, None), (2, ""), (None, QUESTION)]
    assert _found(rows, docs, items) == {}
    assert set(_found(rows, [(4, QUESTION)], items)) == {(4, None)}
    assert _found(rows, [], items) == {} and _found(rows, docs, []) == {}


def test_filter_keeps_clean_rows_whole(rows):
    docs = rows([(1, QUESTION, "a"), (1, "clean", "b"), (None, "clean", "c"), (None, None, "d"), (2, "clean", "e"), (2, "clean", "e")], DOCS)
    kept = decontam.drop_contaminated(docs, rows([(1, QUESTION)], ITEMS))
    assert kept.columns == docs.columns and sorted(r.item_id for r in kept.collect()) == ["b", "c", "d", "e", "e"]


def test_same_as_a_search_for_whole_items(spark):
    base = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id) for r in decontam.find_contamination(docs, items).collect()}
    plain = lambda text: " " + " ".join(re.findall(r"\w+", (text or "").lower())) + " "
    texts = [(r.item_id, plain(r.text)) for r in items.collect()]
    wanted = {(r.doc_id, i) for r in docs.collect() for i, text in texts if text in plain(r.text)}
    assert wanted and found == wanted


def test_main_path_is_native(rows):
    docs = rows([(1, "a", "")], DOCS).select("doc_id", decontam.template_words(F.col("text")))
    assert "Python" not in docs._jdf.queryExecution().executedPlan().toString()


def test_one_of_equal_values_changed(rows):
    item = "If Tom buys 12 apples for 3 dollars each and Anna buys 7 pears how much money does Anna spend in the shop today when all 7 pears are sold"
    docs = [(1, item.replace("all 7 pears", "all 8 pears")), (2, item.replace("does Anna", "does Peter Smith"))]
    assert set(_found(rows, docs, [(1, item)])) == {(1, 1), (2, 1)}


def test_items_of_placeholders(rows):
    items = [(1, "12 km in 3 hours 40 km in 5 hours 7 km in 2 hours 90 km in 6 hours"), (2, "3 7 9 4 1 8 2 6 5"),
             (3, "in a race on the lake Tom ran 5 km in 20 minutes and 12 km in 70 minutes and then they all went home again")]
    docs = [(1, "Table. " + items[0][1] + " end of it"), (2, "so 0 " + items[1][1] + " is it"), (3, "the 9 8 7 6 5 4 3 2 1 of it"),
            (4, "we saw Eva ran 6 km in 30 minutes and 13 km in 80 minutes and then they all left")]
    assert set(_found(rows, docs, items)) == {(1, 1), (2, 2), (4, 3)}


def test_first_word_of_an_item_and_short_items(rows):
    items = [(1, "What is the capital of France?"), (2, "Is Tom Lee older than Anna?"), (3, "Define photosynthesis briefly."), (4, "Tom met Anna")]
    docs = [(1, "Question: What is the capital of France? Answer: unknown"), (2, "first, Is Tom Lee older than Anna? yes he is"),
            (3, "Now define photosynthesis briefly, in not more than ten words."), (4, "as of now: Tom met Anna at the lake again"),
            (5, "as of now: Eva met Paul at the lake again")]
    assert set(_found(rows, docs, items)) == {(1, 1), (2, 2), (3, 3), (4, 4)}


def test_a_word_more_in_the_middle(rows):
    words = [a + b for a in "abcdefgh" for b in "vwxyz"][:24]
    docs = [(1, "so " + " ".join(words[:12] + ["really"] + words[12:]) + " it was"), (2, " ".join(words[:12]) + " and" * 60 + " " + " ".join(words[12:]))]
    assert set(_found(rows, docs, [(1, " ".join(words))])) == {(1, 1)}


def test_thousands_of_names_and_numbers_in_a_row(rows):
    names, numbers = " Abc Üd-e" * 20_000, "1,2.3" + ",45" * 20_000
    docs = [(1, f"of{names} at noon. {QUESTION}"), (2, f"so {numbers} and {QUESTION}"), (3, "so" + " A" * 50_000), (4, f"of{names}")]
    found = _found(rows, docs, [(1, QUESTION)])
    assert set(found) == {(1, 1), (2, 1)} and all(r.share == 1 for r in found.values())
    words = rows([(1, docs[0][1], ""), (2, docs[1][1], "")], DOCS).select(decontam._valued_words(F.col("text")).alias("words")).collect()
    assert words[0].words[1] == "<name" + names.lower() + ">" and words[1].words[1] == f"<number {numbers}>"
