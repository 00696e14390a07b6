"""Byte-level BPE by Arrow functions.

A text is cut into words by the tokenizer's pattern. A word's bytes are merged by rank: of all
neighbours that are a token together, those of lowest rank, the leftmost first, until there are none.

The words of a portion of the texts are merged together, one pair of each word at a time; long ones one
by one. A task keeps the ids of a bounded number of words, so that a frequent word is folded once;
others are folded in each portion they stand in. Counting the words of the corpus beforehand, to fold the frequent ones
once for all tasks, took more time than it saved. So nothing is shuffled. Decoding takes each id's
bytes out of one Arrow array, a batch at a time.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
import sys
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush
from io import BytesIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from yardstats.llm.shared import giving_back, write_through

FREQUENT = 1 << 17  # words of a vocabulary at most, and words that a task counts at once
KEPT = 1 << 18  # words at most whose ids a task keeps
FREQUENT_LENGTH = 64  # characters of such a word at most
AT_ONCE = 1 << 16  # words that are folded at once, about
WIDTHS = (-1, 8, 16, 32, 64)  # most bytes of words that are merged together, above that of the class before
CLASSES = 16  # of counts, per factor of two

#: White space as Unicode has it; Java's and Python's own classes are others.
SPACE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
KINDS = (r"\p{L}", r"\p{N}")
FIRST_PLANE, LAST = 0xFFFF, 0x10FFFF  # last characters of Unicode's first plane, and of all


@functools.cache
def _library_class(kind: str) -> str:
    """All characters of a class, as the tokenizer library's edition of Unicode has them."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    probe = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return bytes(probe.encode_ordinary(every)).decode()


@functools.cache
def _ranges(kind: str, last: int) -> str:
    """The ranges of a class up to ``last``, spelled out; no letter or number has a meaning of its own within brackets."""
    ranges: list[list[int]] = []
    for code in map(ord, _library_class(kind)):
        if code > last:
            break
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(f"{chr(low)}-{chr(high)}" for low, high in ranges)


def spelled_pattern(pattern: str, last: int = LAST) -> str:
    """A tokenizer's pattern with the white space, letters and numbers of the tokenizer's library spelled out.

    It means the same to Python and Java, whatever their own editions of Unicode. Letters and numbers
    are those up to the character ``last``.
    """
    inner = {r"\s": SPACE} | {kind: _ranges(kind, last) for kind in KINDS if kind in pattern}
    parts = re.split(r"(\[\^?[^\]]*\])", pattern)  # classes in brackets, and what is between
    for at, part in enumerate(parts):
        if at % 2 == 0:
            part = part.replace(r"\S", f"[^{SPACE}]")
        for kind, ranges in inner.items():
            part = part.replace(kind, ranges if at % 2 else f"[{ranges}]")
        parts[at] = part
    return "".join(parts)


def _cutter(pattern: str) -> Callable[[str], list[str]]:
    """What cuts a text into words.

    Ranges beyond the first plane are looked through one by one for each character that is in none, which
    takes most of the time. So a text that has no character there is cut by a pattern without them.
    """
    narrow, wide = spelled_pattern(pattern, FIRST_PLANE), spelled_pattern(pattern)

    def words(text: str) -> list[str]:
        beyond = len(text.encode("utf-16-le")) > 2 * len(text)
        return re.compile(wide if beyond else narrow).findall(text)  # compiled once in a process

    return words


def java_pattern(spark: SparkSession, pattern: str) -> str:
    """``spelled_pattern``, as it needs no session any more."""
    return spelled_pattern(pattern)


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, which are their ids, out of a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def fold(ranks: dict[bytes, int], word: bytes) -> tuple[int, ...]:
    """Ids of one word: a token as it is, else its bytes merged by rank. Time grows as n log n."""
    if word in ranks:
        return (ranks[word],)
    size = len(word)
    until, before = list(range(1, size + 1)), list(range(-1, size - 1))  # of the part that starts here; until 0: none does
    waiting = [(ranks[word[at : at + 2]], at, at + 2) for at in range(size - 1) if word[at : at + 2] in ranks]
    heapify(waiting)
    while waiting:
        _, at, end = heappop(waiting)
        middle = until[at]
        if not middle or middle >= size or until[middle] != end:
            continue  # one of the two parts has been merged otherwise
        until[at], until[middle] = end, 0
        if end < size:
            before[end] = at
            rank = ranks.get(word[at : until[end]])
            if rank is not None:
                heappush(waiting, (rank, at, until[end]))
        if at:
            rank = ranks.get(word[before[at] : end])
            if rank is not None:
                heappush(waiting, (rank, before[at], end))
    return tuple([ranks[word[at:end]] for at, end in enumerate(until) if end])


class _Merges:
    """All pairs of tokens that are a token together, to merge many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.none = ranks, max(ranks.values()) + 1
        self.singles = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                left, right = ranks.get(token[:at]), ranks.get(token[at:])
                if left is not None and right is not None:
                    pairs[left * (self.none + 1) + right] = rank
        keys = sorted(pairs)
        self.keys = np.array([*keys, np.iinfo(np.int64).max])
        self.ids = np.array([*map(pairs.get, keys), self.none], np.int32)

    def _together(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The tokens that two make together, which are their ranks too, or ``none``."""
        wanted = left.astype(np.int64) * (self.none + 1) + right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.ids[at], np.int32(self.none))

    def _fold_rows(self, words: list[bytes], width: int) -> Iterator[tuple[int, bytes]]:
        """Places of words of at most ``width`` bytes, and their ids; in each round all words merge one pair.

        A row has ``none`` before and behind its tokens, which makes no token with any other.
        """
        letters = np.frombuffer(b"".join(word.ljust(width, b"\0") for word in words), np.uint8).reshape(-1, width)
        inside = np.arange(width) < np.fromiter(map(len, words), np.int64, len(words))[:, None]
        tokens = np.full((len(words), width + 2), self.none, np.int32)
        tokens[:, 1:-1] = np.where(inside, self.singles[letters], np.int32(self.none))
        ranks, places = self._together(tokens[:, :-1], tokens[:, 1:]), np.arange(len(words))
        while len(places):
            row = np.arange(len(places))
            at = ranks.argmin(axis=1)  # the leftmost of lowest rank
            made = ranks[row, at]
            done = made == self.none
            if done.any():
                real = tokens[done] != self.none
                data, ends = tokens[done][real].tobytes(), np.append(0, np.cumsum(real.sum(axis=1) * 4)).tolist()
                yield from zip(places[done].tolist(), map(data.__getitem__, map(slice, ends, ends[1:])))
                tokens, ranks, places, at, made = (x[~done] for x in (tokens, ranks, places, at, made))
                row = row[: len(places)]
            column = np.arange(tokens.shape[1] - 1)
            tokens[row, at] = made
            tokens = np.where(column <= at[:, None], tokens[:, :-1], tokens[:, 1:])
            ranks = np.where(column[:-1] < at[:, None], ranks[:, :-1], ranks[:, 1:])
            ranks[row, at - 1] = self._together(tokens[row, at - 1], made)
            ranks[row, at] = self._together(made, tokens[row, at + 1])

    def fold(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as the bytes of 32-bit numbers."""
        whole = map(self.ranks.get, words)
        found = [None if rank is None else rank.to_bytes(4, sys.byteorder) for rank in whole]
        left = [at for at, ids in enumerate(found) if ids is None]
        for least, width in itertools.pairwise(WIDTHS):
            some = [at for at in left if least < len(words[at]) <= width]
            for at, ids in self._fold_rows([words[at] for at in some], width):
                found[some[at]] = ids
        for at in left:
            if len(words[at]) > WIDTHS[-1]:  # merged by itself
                found[at] = array("i", fold(self.ranks, words[at])).tobytes()
        return found


class _Ids(dict):
    """Ids by word, as the bytes of 32-bit numbers, of the words at hand and of ``most`` others at most."""

    def __init__(self, merges: _Merges, most: int):
        self.merges, self.most, self.long = merges, most, 0

    def learn(self, words: Iterable[str]) -> None:
        new = [word for word in set(words) if word not in self]
        long = [word for word in new if len(word) > FREQUENT_LENGTH]
        if long:  # they come last
            new = [word for word in new if len(word) <= FREQUENT_LENGTH] + long
        self.long = len(long)
        self.update(zip(new, self.merges.fold([word.encode() for word in new])))

    def forget(self) -> None:
        """Long words, and the latest of too many."""
        for _ in range(max(self.long, len(self) - self.most)):
            self.popitem()


def _portions(rows: Iterable[list[str]]) -> Iterator[list[tuple[list[str], bool]]]:
    """Pieces of rows, and whether a row ends with its piece, in portions of about AT_ONCE words."""
    portion, n = [], 0
    for row in rows:
        for at in range(0, len(row) or 1, AT_ONCE):
            piece = row[at : at + AT_ONCE]
            portion.append((piece, at + AT_ONCE >= len(row)))
            n += len(piece)
            if n >= AT_ONCE:
                yield portion
                portion, n = [], 0
    if portion:
        yield portion


def _lists(words: Iterable[list[str]], ids: _Ids) -> pa.Array:
    """The ids of each list of words, as one Arrow array."""
    values, ends = BytesIO(), [0]
    for portion in _portions(words):
        ids.learn(itertools.chain.from_iterable(piece for piece, _ in portion))
        for piece, last in portion:
            values.writelines(map(ids.__getitem__, piece))
            if last:
                ends.append(values.tell() // 4)
        ids.forget()
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(values.getbuffer(), np.int32)))


def frequent_words(texts: DataFrame, pattern: str, most: int = FREQUENT) -> DataFrame:
    """word: the most frequent words of all texts, ``most`` at most. ``pattern`` is a spelled one.

    Counts are put into classes, and whole classes are taken from the top, so nothing is sorted in
    one task. For a look at a corpus; encoding does without.
    """

    def counted(found: Counter) -> pa.RecordBatch:
        kept = [(word, n) for word, n in found.items() if len(word) <= FREQUENT_LENGTH]
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, found = re.compile(pattern).findall, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(words(text or ""))
                if len(found) > FREQUENT:
                    yield counted(found)
        yield counted(found)

    words = texts.select("text").mapInArrow(giving_back(run), "word string, n long")
    words = words.groupBy("word").agg(F.sum("n").alias("n"))
    words = words.filter("n > 1").select("word", F.floor(F.log2("n") * CLASSES).alias("class"))
    words = write_through(words, "word-classes")
    sizes = words.groupBy("class").count().collect()  # at most 64 * CLASSES rows
    taken, least = 0, None
    for row in sorted(sizes, reverse=True):
        taken += row["count"]
        if taken > most:
            break
        least = row["class"]
    return words.filter(F.col("class") >= least if least is not None else F.lit(False)).select("word")


def encode_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """word, ids: each row's word folded, or taken as it is where it is a token."""

    merges = _Merges(ranks)

    @arrow_udf("array<int>")
    def folded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids = _Ids(merges, KEPT)
        for batch in batches:
            yield _lists(([word] for word in batch.to_pylist()), ids)

    return words.select("word", folded("word").alias("ids"))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, frequent: int = KEPT) -> DataFrame:
    """All columns of ``docs``, and ``ids``: the token ids of its column ``text``, as array<int>.

    Null and empty texts have none. Special tokens are never made. A column ``ids`` of ``docs`` is
    replaced. ``ranks`` has all 256 bytes. ``frequent`` bounds the words whose ids a task keeps; it changes
    the time only. Equal rows stay as many as they are.
    """
    words, merges = _cutter(pattern), _Merges(ranks)

    @arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids = _Ids(merges, frequent)
        for batch in batches:
            yield _lists((words(text or "") for text in batch.to_pylist()), ids)

    return docs.withColumn("ids", encoded("text"))


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of token ids; null where an id is not known."""
    size = max(ranks.values()) + 1
    listed = [None] * size
    for token, rank in ranks.items():
        listed[rank] = token

    @arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = pa.array(listed, pa.binary())
        for batch in batches:
            ends, values = batch.offsets.to_numpy(), batch.values
            inside = pc.and_(pc.greater_equal(values, 0), pc.less(values, size))
            found = tokens.take(pc.if_else(inside, values, pa.scalar(None, values.type)))
            unknown = np.append(0, np.cumsum(found.is_null().to_numpy(zero_copy_only=False)))
            known = pc.and_(batch.is_valid(), pa.array(unknown[ends[1:]] == unknown[ends[:-1]]))
            # The bytes of neighbouring tokens lie side by side already; only the ends are others.
            found = found.fill_null(b"")
            cuts = np.frombuffer(found.buffers()[1], np.int32)[found.offset :][ends] if len(found) else np.zeros(len(ends), np.int32)
            data = found.buffers()[2] or pa.py_buffer(b"")
            buffers = [known.buffers()[1], pa.py_buffer(np.ascontiguousarray(cuts, np.int32)), data]
            yield pa.Array.from_buffers(pa.binary(), len(batch), buffers)

    return decoded(ids)
