"""Words of whole Arrow batches as 64-bit hashes, with numpy and without a loop over words.

A word is a run of bytes that are no ASCII white space, A to Z lower-cased. Its hash is
a polynomial over its bytes, read off prefix sums modulo 2^64 and mixed afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18  # bytes looked at together, unless one word is longer

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[ord("A") + np.arange(26)] = _VALUE[ord("a") + np.arange(26)]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, count: int) -> np.ndarray:
    factors = np.full(count, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


class WordReader:
    """Hashes and places of the words of texts; holds the powers that all blocks use."""

    def __init__(self) -> None:
        self._up, self._down = _powers(_BASE, BLOCK), _powers(_INVERSE, BLOCK)

    def _hashes(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if n > len(self._up):
            self._up, self._down = _powers(_BASE, n), _powers(_INVERSE, n)
        inside = ~_SPACE[data]
        first = np.empty(n, bool)
        first[0] = True
        np.logical_not(inside[:-1], out=first[1:])
        first[cuts] = True
        starts = np.flatnonzero(inside & first)
        last = np.empty(n, bool)
        last[-1] = True
        np.logical_not(inside[1:], out=last[:-1])
        last[cuts[cuts > 0] - 1] = True
        ends = np.flatnonzero(inside & last) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[data] * self._up[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self._down[starts]), starts

    def read(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, hashes, text number of each word), texts in order, several at a time.

        A text longer than a block is a yield of its own. Null counts as empty.
        """
        texts = pc.fill_null(texts, "")
        wide = pa.types.is_large_string(texts.type)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        text = 0
        while text < len(texts):
            until = max(text + 1, int(np.searchsorted(at, at[text] + BLOCK, "right")) - 1)
            low, high = int(at[text]), int(at[until])
            hashes, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            while low < high:
                looked, end = low, min(high, low + BLOCK)
                while end < high:  # up to the last space, or on while there is none
                    spaces = np.flatnonzero(_SPACE[data[looked:end]])
                    if len(spaces):
                        end = looked + int(spaces[-1]) + 1
                        break
                    looked, end = end, min(high, end + BLOCK)
                inner = at[text:until]
                cuts = inner[(inner >= low) & (inner < end)] - low
                found, starts = self._hashes(data[low:end], cuts)
                hashes.append(found)
                owner.append(np.searchsorted(at[text : until + 1], starts + low, "right") - 1)
                low = end
            yield text, np.concatenate(hashes), np.concatenate(owner)
            text = until


_PLACE = [np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of ``width`` words of one text; of a shorter text, the whole as one; of none, none."""
    if not len(hashes):
        return hashes
    size = min(width, len(hashes))
    runs = len(hashes) - size + 1
    total = np.full(runs, size, np.uint64)
    for place in range(size):
        total += hashes[place : place + runs] * _PLACE[place]
    return mix(total)


def shingle_sets(reader: WordReader, texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: one array for every text, empty where it has no words."""
    none, place = np.zeros(0, np.uint64), 0
    for first, hashes, owner in reader.read(texts):
        for _ in range(place, first):  # texts without words at the end of the block before
            yield none
        until = int(owner[-1]) + 1 if len(owner) else 0
        bounds = np.searchsorted(owner, np.arange(until + 1))
        for low, high in zip(bounds[:-1], bounds[1:]):
            yield np.unique(shingles(hashes[low:high], width))
        place = first + until
    for _ in range(place, len(texts)):
        yield none
