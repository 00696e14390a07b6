"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus
signs, digits, ``://`` and identifier cues. From each anchor a local parser finds the
boundaries and checks the value. A parser never goes back over text that its kind has
passed, so the time is linear in the text, also for megabytes of one character class.

Base kinds (email, ip, card, phone) are the leftmost non-overlapping matches of their
patterns, of which failing ones are dropped. Added kinds: ``url``, a scheme address
that carries user data before its host, and ``account``, a checked IBAN, with or without a
cue, or a number of 6 to 17 digits right behind a cue such as "account no.".
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from yardstats.llm.shared import fresh

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long"))
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "ssn", "social security", "passport")

Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGITS = re.compile(r"[0-9]++")
FOUR = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
SPACED = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
AUTHORITY = re.compile(r"://([^\s/?#@\"'<>]++)@([A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+)(?::[0-9]++)?(?:[/?#][^\s\"'<>]*+)?")
LABEL = re.compile(r"[\x20]?(?:no\.?|nr\.?|num(?:ber|ero|éro|mer)?\.?|#)?[\x20]?[:=#]?[\x20]?", re.IGNORECASE)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9]){5,16}(?![0-9])")


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        doubled = digit * (1 + place % 2)
        total += doubled - 9 * (doubled > 9)
    return total % 10 == 0


def _iban_holds(value: str) -> bool:
    plain = value.replace(" ", "")
    moved = plain[4:] + plain[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _word(char: str) -> bool:
    return char.isascii() and char.isalnum()


def _iban_end(text: str, start: int) -> int:
    """The longest end, behind a whole word, of an IBAN whose checksum holds; ``start`` where there is none."""
    m = IBAN.match(text, start)
    end = m.end() if m else start
    while end - start >= 15:
        if text[end - 1] != " " and not _word(text[end : end + 1]):
            value = text[start:end]
            if len(value) - value.count(" ") < 15:
                break
            if _iban_holds(value):
                return end
        end -= 1
    return start


def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for mark in ("@", "+", "://", *"0123456789"):
        found.add_word(mark, mark)
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize(), cue.title()):
            found.add_word(form, cue)
    found.make_automaton()
    return found


def span_finder() -> Callable[[str], list[Span]]:
    """A function that lists a text's spans by start, then kind in the order of ``KINDS``."""
    anchors = _anchors()
    order = {kind: place for place, kind in enumerate(KINDS)}

    def find(text: str) -> list[Span]:
        spans: list[Span] = []
        passed = dict.fromkeys((*KINDS, "run"), 0)
        for last, mark in anchors.iter(text):
            if mark == "@":
                start = last
                while start > passed["email"] and text[start - 1] in LOCAL:
                    start -= 1
                if start < last and (m := DOMAIN.match(text, last)):
                    spans.append(("email", start, m.end()))
                    passed["email"] = m.end()
                elif start < last:
                    passed["email"] = last  # what stands before this sign leads to no later one
            elif mark == "+":
                if last >= passed["phone"] and (m := PHONE.match(text, last)):
                    passed["phone"] = m.end()
                    if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                        spans.append(("phone", last, m.end()))
            elif mark == "://":
                at = last - 2
                start = at
                while start > passed["url"] and text[start - 1] in SCHEME:
                    start -= 1
                passed["url"] = at
                while start < at and not text[start].isalpha():
                    start += 1
                if start < at and (m := AUTHORITY.match(text, at)):
                    spans.append(("url", start, m.end()))
                    passed["url"] = m.end()
            elif len(mark) > 1:
                end = last + 1
                begin = end - len(mark)
                if begin < passed["account"] or (begin and text[begin - 1].isalnum()):
                    continue
                value = LABEL.match(text, end).end()
                if value == end:
                    continue
                stop = _iban_end(text, value)
                if stop == value and (m := NUMBER.match(text, value)):
                    stop = m.end()
                if stop > value:
                    spans.append(("account", value, stop))
                    passed["account"] = stop
            elif last >= passed["run"]:
                passed["run"] = DIGITS.match(text, last).end()
                begin = last - 2  # two capitals before two digits may begin an IBAN without a cue
                if begin >= passed["account"] and not (begin and _word(text[begin - 1])):
                    stop = _iban_end(text, begin)
                    if stop > begin:
                        spans.append(("account", begin, stop))
                        passed["account"] = stop
                if last >= passed["ip"] and (m := FOUR.match(text, last)):
                    passed["ip"] = m.end()
                    parts = [part.lstrip("0") or "0" for part in m.group().split(".")]
                    if all(len(part) <= 3 and int(part) <= 255 for part in parts):
                        spans.append(("ip", last, m.end()))
                if last >= passed["card"]:
                    m = SPACED.match(text, last)
                    passed["card"] = m.end()
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and _luhn(digits):
                        spans.append(("card", last, m.end()))
        return sorted(spans, key=lambda span: (span[1], order[span[0]], span[2]))

    return find


def masker() -> Callable[[str], str]:
    """A function that puts ``[KIND]`` in place of each span; overlapping spans become one, named by the first."""
    find = span_finder()

    def mask(text: str) -> str:
        pieces, at = [], 0
        for kind, start, end in find(text):
            if start >= at:
                pieces += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        return "".join([*pieces, text[at:]]) if pieces else text

    return mask


@arrow_udf(SPANS)
def find_spans(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """All spans of each text in code points, end exclusive. Null: none."""
    find = span_finder()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in texts:
        found = (find(text or "") for text in batch.to_pylist())
        yield pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in found], kind)


@arrow_udf(T.StringType())
def masked(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each text with its spans masked; null stays null."""
    mask = masker()
    for batch in texts:
        yield pa.array([None if text is None else mask(text) for text in batch.to_pylist()], pa.string())


def span_list(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of these kinds, comma-joined in their order."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, spans: one row per row of ``docs``, in whole texts. Repeated rows are searched alike."""
    return docs.select("doc_id", find_spans(F.col("text")).alias("spans"))


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, with the personal data in ``text`` masked.

    ``n_chars``, where there is one, follows the texts that change.
    """
    name = fresh(docs, "masked")
    out = docs.withColumn(name, masked(docs["text"]))
    if "n_chars" in docs.columns:
        size = F.length(name).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(name) != F.col("text"), size).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col(name)).select(*docs.columns)
