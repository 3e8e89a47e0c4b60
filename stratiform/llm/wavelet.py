"""Token ids of a corpus in wavelet-matrix files.

A file holds one shard: for every bit of the ids, from the highest, a plane of that bit in the
order that the higher bits gave (all zeros first, then all ones, each in the order before).
Planes are cut into blocks, compressed one by one, with the count of ones before each block, so
a token, a count of an id in a range, or the place of its k-th occurrence is found by opening
one block per bit. Ends and ids of the documents are in the same file.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratiform.llm import arrays, files
from stratiform.session import new_path, stage

MAGIC = b"WVMX0001"
BLOCK_BYTES = 1 << 14
BLOCK_BITS = BLOCK_BYTES * 8
END_ID = 1
SHARD_TOKENS = 1 << 23
CACHED_WORDS = 3_000_000


def build(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bit planes of ``ids``, highest bit first, packed."""
    order = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    planes, spare = [], np.empty_like(order)
    for level in range(bits - 1, -1, -1):
        ones = (order & order.dtype.type(1 << level)).astype(bool)
        planes.append(np.packbits(ones))
        border = len(order) - int(np.count_nonzero(ones))
        spare[border:] = order[ones]
        spare[:border] = order[~ones]
        order, spare = spare, order
    return planes


class Shard:
    """One file, opened from its bytes; blocks are decompressed when they are needed."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        self.data = data
        self.length, self.documents, self.bits, sizes = struct.unpack_from("<qqqq", data, 8)
        head = zstandard.decompress(data[40 : 40 + sizes])
        self.start = 40 + sizes
        blocks = -(-self.length // BLOCK_BITS)
        numbers = np.frombuffer(head, dtype=np.int64)
        parts = np.split(numbers, np.cumsum([self.documents, self.documents, self.documents, self.bits]))
        self.doc_ids, self.doc_null, self.doc_ends, self.zeros = parts[:4]
        self.places, self.ones_before = parts[4].reshape(2, self.bits, blocks + 1)
        self._open: OrderedDict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = OrderedDict()

    def _raw(self, level: int, block: int) -> bytes:
        low, high = self.places[level, block : block + 2]
        return zstandard.decompress(self.data[self.start + low : self.start + high])

    def _block(self, level: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Bits of a block, and the ones before each of them within the block."""
        key = (level, block)
        if key not in self._open:
            if len(self._open) >= 4 * self.bits:
                self._open.popitem(last=False)
            ones = np.unpackbits(np.frombuffer(self._raw(level, block), dtype=np.uint8))
            self._open[key] = ones, np.concatenate([[0], np.cumsum(ones)])
        self._open.move_to_end(key)
        return self._open[key]

    def _rank(self, level: int, at: int) -> int:
        """Ones among the first ``at`` bits of a plane."""
        block, within = divmod(at, BLOCK_BITS)
        before = int(self.ones_before[level, block])
        return before if within == 0 else before + int(self._block(level, block)[1][within])

    def access(self, at: int) -> int:
        """The token at a place."""
        if not 0 <= at < self.length:
            raise IndexError(at)
        token = 0
        for level in range(self.bits):
            block, within = divmod(at, BLOCK_BITS)
            one = int(self._block(level, block)[0][within])
            rank = self._rank(level, at)
            at = int(self.zeros[level]) + rank if one else at - rank
            token = token << 1 | one
        return token

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        if token < 0 or token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            ones = self._rank(level, low), self._rank(level, high)
            if token >> (self.bits - 1 - level) & 1:
                low, high = (int(self.zeros[level]) + x for x in ones)
            else:
                low, high = low - ones[0], high - ones[1]
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often a token stands in the places from ``low`` to before ``high``."""
        high = self.length if high is None else min(high, self.length)
        first, last = self._range(token, min(max(low, 0), high), high)
        return last - first

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of a token."""
        first, last = self._range(token, 0, self.length)
        if not 0 <= k < last - first:
            raise IndexError(k)
        at = first + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            at = self._find(level, one, at - int(self.zeros[level]) if one else at)
        return at

    def _find(self, level: int, one: int, k: int) -> int:
        """The place of the k-th bit of a kind in a plane."""
        before = self.ones_before[level]
        if not one:
            before = np.minimum(np.arange(len(before)) * BLOCK_BITS, self.length) - before
        block = int(np.searchsorted(before, k, "right")) - 1
        ones = self._block(level, block)[0]
        here = min(BLOCK_BITS, self.length - block * BLOCK_BITS)
        return block * BLOCK_BITS + int(np.flatnonzero(ones[:here] == one)[k - int(before[block])])

    def tokens(self) -> np.ndarray:
        """All tokens in order: planes are undone from the lowest bit up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        out = np.zeros(self.length, dtype=kind)
        blocks = -(-self.length // BLOCK_BITS)
        for level in range(self.bits - 1, -1, -1):
            plane = b"".join(self._raw(level, block) for block in range(blocks))
            ones = np.unpackbits(np.frombuffer(plane, dtype=np.uint8))[: self.length].view(bool)
            before, border = np.empty_like(out), int(self.zeros[level])
            before[~ones] = out[:border]
            before[ones] = out[border:] | kind(1 << (self.bits - 1 - level))
            out = before
        return out


def pack(ids: np.ndarray, doc_ids: list[int | None], doc_ends: np.ndarray, bits: int) -> list[bytes]:
    """The byte parts of a file."""
    compress = zstandard.ZstdCompressor(level=1).compress
    zeros, places, ones_before, body, size = [], [], [], [], 0
    for plane in build(ids, bits):
        counts = np.bitwise_count(plane)
        at, ones = [size], [0]
        for low in range(0, len(plane), BLOCK_BYTES):
            block = compress(plane[low : low + BLOCK_BYTES].tobytes())
            body.append(block)
            size += len(block)
            at.append(size)
            ones.append(ones[-1] + int(counts[low : low + BLOCK_BYTES].sum()))
        zeros.append(len(ids) - ones[-1])
        places.append(at)
        ones_before.append(ones)
    numbers = [
        np.array([0 if x is None else x for x in doc_ids], dtype=np.int64),
        np.array([x is None for x in doc_ids], dtype=np.int64),
        doc_ends.astype(np.int64), np.array(zeros, dtype=np.int64),
        np.array(places, dtype=np.int64).ravel(), np.array(ones_before, dtype=np.int64).ravel(),
    ]
    head = compress(np.concatenate(numbers).tobytes())
    return [MAGIC + struct.pack("<qqqq", len(ids), len(doc_ids), bits, len(head)) + head, *body]


class Encoder:
    """Ids of texts by a tokenizer that treats words between ASCII white space on their own.

    A word is encoded once and remembered by its hash, up to ``CACHED_WORDS``; then the memory
    is emptied. The tokenizer lowers letters, so words are known with A-Z lowered. Texts with a
    special token, which is matched before that, are encoded as they are.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bits = max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.kind = np.dtype(np.uint16 if self.bits <= 16 else np.uint32)
        special = [token.content.lower().encode() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, special))) if special else None
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)  # sorted
        self.begins = np.zeros(0, dtype=np.int64)  # of each key's ids
        self.sizes = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=self.kind)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Encode words together, and tell them apart by where each id's text begins."""
        ids, sizes = [self.ids], []
        for low in range(0, len(words), 4096):
            part = words[low : low + 4096]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            lengths = np.array([len(word) + 1 for word in part])
            at = np.fromiter((offset[0] for offset in found.offsets), dtype=np.int64, count=len(found.ids))
            sizes.append(np.bincount(np.searchsorted(np.cumsum(lengths), at, "right"), minlength=len(part)))
            ids.append(np.array(found.ids, dtype=self.kind))
        new_sizes = np.concatenate(sizes)
        begins = np.concatenate([self.begins, len(self.ids) + np.cumsum(new_sizes) - new_sizes])
        self.ids = np.concatenate(ids)
        keys = np.concatenate([self.keys, hashes])
        order = np.argsort(keys)
        self.keys, self.begins = keys[order], begins[order]
        self.sizes = np.concatenate([self.sizes, new_sizes])[order]

    def _known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
        place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return place, self.keys[place] == hashes

    def encode(self, batch: arrays.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id after it, and where each text's ids end."""
        if len(self.keys) > CACHED_WORDS:
            self._forget()
        found, count = arrays.words(batch), len(batch.offsets) - 1
        distinct, back = np.unique(found.hash, return_inverse=True)
        place, known = self._known(distinct)
        if not known.all():
            at = np.flatnonzero(~known[back])
            new, first = np.unique(found.hash[at], return_index=True)
            at = at[first]
            words = [bytes(batch.data[a:b]).lower().decode() for a, b in zip(found.start[at], found.end[at], strict=True)]
            self._learn(new, words)
            place, known = self._known(distinct)
        # Every word's ids are copied to where the words before it and the ends of texts before it leave off.
        own = self.sizes[place][back]
        text_sizes = np.bincount(found.doc, weights=own, minlength=count).astype(np.int64) + 1
        ends = np.cumsum(text_sizes)
        stops = np.cumsum(own)
        total = int(stops[-1]) if len(stops) else 0
        source = np.arange(total)
        source += np.repeat(self.begins[place][back] - (stops - own), own)
        out = np.full(int(ends[-1]) if count else 0, END_ID, dtype=self.kind)
        keep = np.ones(len(out), dtype=bool)
        keep[ends - 1] = False
        out[keep] = self.ids[source]
        return self._with_special(batch, out, ends)

    def _with_special(self, batch: arrays.Texts, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids in which the texts that hold a special token, in whatever case, are encoded whole."""
        data = batch.data.tobytes() if self.special else b""
        marks = [m.start() for m in self.special.finditer(data.lower())] if self.special else []
        if not marks:
            return ids, ends
        texts = np.unique(np.searchsorted(batch.offsets, marks, "right") - 1)
        pieces = np.split(ids, ends[:-1])
        for k in texts:
            text = data[batch.offsets[k] : batch.offsets[k + 1]].decode()
            own = self.tokenizer.encode(text, add_special_tokens=False).ids
            pieces[k] = np.array([*own, END_ID], dtype=self.kind)
        return np.concatenate(pieces), np.cumsum([len(piece) for piece in pieces])


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Written(NamedTuple):
    folder: str
    shards: DataFrame  # part, piece, file, documents, tokens


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, shard_tokens: int = SHARD_TOKENS) -> Written:
    """Encode every text of ``docs`` (doc_id, text) and write the shards in ascending doc_id order.

    ``tokenizer`` is a path that every worker can read. A null text is empty and has the end id
    only; rows without id come last; rows of one id are ordered by their texts. Other columns
    are ignored. Texts are dealt by ranges of id (and text, so one id may have any number of
    rows); a task writes a file whenever ``shard_tokens`` ids have gathered. No rows, no files.
    """
    folder = folder or new_path(docs.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, piece = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        sizes: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            ends = np.cumsum(np.concatenate(sizes))
            name = files.write_file(folder, f"{part:06d}-{piece:06d}", pack(np.concatenate(ids), doc_ids, ends, encoder.bits))
            row = [[part], [piece], [name], [len(doc_ids)], [total]]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["part", "piece", "file", "documents", "tokens"])

        for batch in batches:
            batch_ids = batch.column(0).to_pylist()
            for first, last, texts in arrays.slices(arrays.texts(batch.column(1)), min(1 << 21, 4 * shard_tokens)):
                found, ends = encoder.encode(texts)
                ids.append(found)
                sizes.append(np.diff(ends, prepend=0))
                doc_ids += batch_ids[first:last]
                total += len(found)
                if total >= shard_tokens:
                    yield flush()
                    ids, doc_ids, sizes, total, piece = [], [], [], 0, piece + 1
        if doc_ids:
            yield flush()
        ids.clear()
        arrays.release()

    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    dealt = docs.select("doc_id", "text").repartitionByRange(*order[:3]).sortWithinPartitions(*order)
    rows = dealt.mapInArrow(run, "part long, piece long, file string, documents long, tokens long")
    return Written(folder, stage(rows, "shards"))


def positioned(shards: DataFrame) -> DataFrame:
    """``shards`` with ``start``: the tokens of all shards before. One row per task is ordered in one place."""
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"))
    inside = Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    return shards.join(parts, "part").withColumn("start", start).drop("before")


def read(written: Written) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    folder = written.folder

    def run(batch: pa.RecordBatch):
        for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard = Shard(files.read_file(folder, name))
            tokens = shard.tokens().astype("<u4")
            ends = shard.doc_ends
            begins = np.concatenate([[0], ends[:-1]])
            crc = [zlib.crc32(tokens[a:b]) for a, b in zip(begins, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard.doc_ids, mask=shard.doc_null.astype(bool)), pa.array(begins + start),
                    pa.array(ends - begins), pa.array(crc, pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    def each(batches):
        for batch in batches:
            yield from run(batch)
        arrays.release()

    rows = positioned(written.shards).select("file", "start")
    shards = rows.repartition(max(1, written.shards.count()), "file")  # a number, or AQE puts the short rows together
    return shards.mapInArrow(each, "doc_id long, start long, n_tokens long, ids_crc32 long")
