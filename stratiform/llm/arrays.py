"""Words and their 64-bit hashes, taken from Arrow text columns without a Python object per word.

A word is a run of bytes other than space and 0x09-0x0D. Hashes are of the word with A-Z
lowered, as polynomials over a table of random values, finished by a bit mixer; two of a
billion different words agree with a probability of about 3 in 100.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_RADIX = 0x9E3779B97F4A7C15 | 1
_RADIX_INVERSE = pow(_RADIX, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
# First and last characters of scripts that are written without spaces, each character a word, and of
# the punctuation between them.
UNSPACED = np.array([
    (0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF),
    (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035), (0x3040, 0x30FA), (0x30FC, 0x312F),
    (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F),
    (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
])
UNSPACED_MARKS = np.array([
    (0x3000, 0x3004), (0x3008, 0x3020), (0x302A, 0x3030), (0x3036, 0x303F), (0x30FB, 0x30FB), (0xFE10, 0xFE1F),
    (0xFE30, 0xFE4F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65),
])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _powers(radix: int, count: int) -> np.ndarray:
    out = np.full(count, radix, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = _powers(_RADIX, PIECE + 1)
_INVERSES = _powers(_RADIX_INVERSE, PIECE + 1)


def mix(values: np.ndarray) -> np.ndarray:
    """Finish 64-bit values so that every bit of the input reaches every bit of the output."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xC4CEB9FE1A85EC53)
    values ^= values >> np.uint64(33)
    return values


class Texts(NamedTuple):
    """UTF-8 bytes of all texts of a batch, and where each text begins (one more for the end)."""

    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def texts(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The bytes of a text column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def slices(batch: Texts, size: int = 1 << 21) -> Iterator[tuple[int, int, Texts]]:
    """Consecutive groups of whole texts of about ``size`` bytes: first text, end, texts."""
    first, count = 0, len(batch.offsets) - 1
    while first < count:
        last = int(np.searchsorted(batch.offsets, batch.offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), count)
        offsets = batch.offsets[first : last + 1]
        yield first, last, Texts(batch.data[offsets[0] : offsets[-1]], offsets - offsets[0])
        first = last


def word_bounds(batch: Texts, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends; no word crosses a border between texts."""
    inside = ~between[batch.data]
    begins = np.ones(len(inside) + 1, dtype=bool)
    begins[1:-1] = ~inside[:-1]
    begins[batch.offsets] = True
    start = np.flatnonzero(inside & begins[:-1])
    ends = np.ones(len(inside), dtype=bool)
    ends[:-1] = ~inside[1:]
    borders = batch.offsets[(batch.offsets > 0) & (batch.offsets <= len(inside))] - 1
    ends[borders] = True
    return start, np.flatnonzero(inside & ends) + 1


def _within(codes: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    place = np.searchsorted(ranges[:, 0], codes, "right") - 1
    return (place >= 0) & (codes <= ranges[np.maximum(place, 0), 1])


def unspaced_words(batch: Texts, between: np.ndarray = NOT_ALNUM) -> Words:
    """Words as by ``words``, but each character of a script without spaces is one, and its punctuation none."""
    data = batch.data
    lead = np.flatnonzero(data >= 0xE0)
    width = np.where(data[lead] >= 0xF0, 4, 3)
    tail = [data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) & 0x3F for k in (1, 2, 3)]
    three = (data[lead].astype(np.int64) & 0x0F) << 12 | tail[0] << 6 | tail[1]
    four = (data[lead].astype(np.int64) & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
    code = np.where(width == 4, four, three)
    single, mark = _within(code, UNSPACED), _within(code, UNSPACED_MARKS)
    if not (single.any() or mark.any()):
        return words(batch, between)
    inside = ~between[data]
    for k in range(3):
        inside[lead[mark] + k] = False
    border = np.zeros(len(data) + 1, dtype=bool)
    border[batch.offsets] = True
    border[lead[single]] = True
    border[lead[single] + width[single]] = True
    begins, ends = border[:-1].copy(), border[1:].copy()
    begins[1:] |= ~inside[:-1]
    ends[:-1] |= ~inside[1:]
    start, end = np.flatnonzero(inside & begins), np.flatnonzero(inside & ends) + 1
    return Words(start, end, np.searchsorted(batch.offsets, start, "right") - 1, span_hashes(data, start, end))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans that are sorted and do not overlap, in pieces of bounded size."""
    out = np.zeros(len(start), dtype=np.uint64)
    if not len(start):
        return out
    for low in range(0, len(data), PIECE):
        piece = data[low : low + PIECE]
        high = low + len(piece)
        first = int(np.searchsorted(end, low, "right"))
        last = int(np.searchsorted(start, high, "left"))
        if first >= last:
            continue
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[LOWER[piece]] * _POWERS[: len(piece)], out=sums[1:])
        begin = np.maximum(start[first:last], low) - low
        stop = np.minimum(end[first:last], high) - low
        part = (sums[stop] - sums[begin]) * _INVERSES[begin]
        if start[first] < low:  # goes on from the piece before
            part[:1] *= np.uint64(pow(_RADIX, int(low - start[first]), 1 << 64))
        out[first:last] += part
    return mix(out)


def words(batch: Texts, between: np.ndarray = SPACE) -> Words:
    start, end = word_bounds(batch, between)
    doc = np.searchsorted(batch.offsets, start, "right") - 1
    return Words(start, end, doc, span_hashes(batch.data, start, end))


def per_text(batch: Texts, doc: np.ndarray) -> np.ndarray:
    """Where the words of each text begin in a list of words (one more for the end)."""
    return np.searchsorted(doc, np.arange(len(batch.offsets)), "left")


def run_hashes(hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` successive words of one text, with the text of each."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = len(hashes) - width + 1
    total = np.zeros(count, dtype=np.uint64)
    for k in range(width):
        total += hashes[k : k + count] * _POWERS[k + 1]
    whole = doc[:count] == doc[width - 1 :]
    return mix(total[whole]), doc[:count][whole]


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of one whole word sequence of any length."""
    total = np.uint64(len(hashes))
    with np.errstate(over="ignore"):
        for value in hashes:
            total = total * np.uint64(_RADIX) + value
    return mix(np.array([total], dtype=np.uint64))[0]


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order], first)


class Members:
    """Membership in a fixed sorted set of hashes; most others are turned away by a bit table."""

    def __init__(self, keys: np.ndarray, bits: int = 20) -> None:
        self.keys = np.asarray(keys, dtype=np.uint64)
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, dtype=bool)
        self.table[self.keys >> self.shift] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions among ``hashes`` that are members, and their places among the keys."""
        near = np.flatnonzero(self.table[hashes >> self.shift])
        if not len(near):
            return near, near
        place = np.minimum(np.searchsorted(self.keys, hashes[near]), len(self.keys) - 1)
        same = self.keys[place] == hashes[near]
        return near[same], place[same]


def mapper(function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch | None]]):
    """A function for mapInArrow from one that takes a batch and yields batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in function(batch):
                if out is not None and out.num_rows:
                    yield out
        release()

    return run


def release() -> None:
    """Give freed memory back to the machine: a worker outlives its task and waits beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
