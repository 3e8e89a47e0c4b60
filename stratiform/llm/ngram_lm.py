"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped for scoring.

Words (A-Z lowered) are known by 64-bit hashes. The vocabulary is a sorted array of hashes; a
word's place in it is its number. Bigrams are sorted arrays of number pairs, cut into shards by
context; contexts with more tokens than a part of a shard holds are dealt over all shards, so no
shard grows with one word. Every task adds up its bigrams before they are shuffled.

A text is its words and one end token; the first word's context is the beginning of a text.

    p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) * p(w)
    p(w)     = max(k(w) - D'(k(w)), 0) / K + g' / (V + 1)

with k(w) the number of different contexts of w, K their sum, D and D' the three discounts each
from counts of counts, and g(v), g' the mass that they free. Unknown words share 1 / (V + 1).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratiform.llm import arrays, files
from stratiform.session import new_path, stage

END = np.uint64(0x656E6421)  # hashes are mixed, so these two are as unlikely as any other
BEGIN_ID = np.uint64(0xFFFFFFFF)
LARGE = (1 << 32) - 1  # counts from here on are kept apart, in 64 bits


@dataclass(frozen=True)
class Settings:
    shard_tokens: int = 2_000_000  # training tokens to a shard of bigrams
    least_shards: int = 64
    range_words: int = 1_000_000  # words to a file of context counts
    least_ranges: int = 16
    held: int = 3_000_000  # keys that a task adds up at once


class Vocabulary(NamedTuple):
    """Files of sorted hashes (signed) and counts, in order; ``first`` is each file's first hash."""

    folder: str
    names: list[str]
    first: np.ndarray
    sizes: np.ndarray


class Model(NamedTuple):
    vocabulary: Vocabulary
    tokens: int
    texts: int
    words: int
    shards: list[str | None]
    hot: np.ndarray  # sorted numbers of contexts dealt over all shards
    hot_followers: np.ndarray  # followers seen once, twice, more often, of each
    ranges: list[str | None]
    range_words: int
    discounts: tuple[np.ndarray, np.ndarray]  # of bigrams, of context counts
    pairs: int
    freed: float


def discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts for counts 1, 2 and more (place 0 is for 0) from the numbers of things seen 1 to 4 times."""
    n1, n2, n3, n4 = (float(x) for x in counts)
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.5, 0.75, 0.75])  # too little data for an estimate
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(d, 0.05), k + 1.0) for k, d in enumerate(raw))])


def tokens_of(batch: arrays.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of all texts, ends included, and the text of each."""
    found = arrays.words(batch)
    count = len(batch.offsets) - 1
    per = np.bincount(found.doc, minlength=count)
    doc = np.repeat(np.arange(count), per + 1)
    out = np.full(len(found.hash) + count, END, dtype=np.uint64)
    out[np.arange(len(found.hash)) + found.doc] = found.hash
    return out, doc


class _Sums:
    """Adds up keys with counts, in portions of bounded size."""

    def __init__(self, held: int) -> None:
        self.held, self.keys, self.counts, self.size = held, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        return self.size >= self.held

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = arrays.add_up(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts, self.size = [], [], 0
        return keys, counts


def _count_words(docs: DataFrame, settings: Settings) -> DataFrame:
    """word (hash), n over all texts of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(settings.held)

        def out() -> pa.RecordBatch:
            keys, counts = sums.take()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["word", "n"])

        for batch in batches:
            for _, _, part in arrays.slices(arrays.texts(batch.column(0))):
                if sums.add(*np.unique(tokens_of(part)[0], return_counts=True)):
                    yield out()
        if sums.size:
            yield out()

    counted = docs.select("text").mapInArrow(run, "word long, n long")
    return stage(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")


def _write_vocabulary(words: DataFrame, folder: str) -> Vocabulary:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            hashes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            name = files.write_file(folder, "words", [hashes.tobytes(), counts.tobytes()])
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashes[0]]), pa.array([name]), pa.array([len(hashes)])], ["first", "name", "size"]
            )

    dealt = words.repartitionByRange("word").sortWithinPartitions("word")
    rows = stage(dealt.mapInArrow(run, "first long, name string, size long"), "vocabulary").orderBy("first").collect()
    return Vocabulary(
        folder, [r["name"] for r in rows], np.array([r["first"] for r in rows], dtype=np.int64),
        np.array([r["size"] for r in rows], dtype=np.int64),
    )


class Words:
    """A vocabulary, memory-mapped."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        maps = [files.mapped(vocabulary.folder, name, np.int64) for name in vocabulary.names]
        self.hashes = [m[:size] for m, size in zip(maps, vocabulary.sizes, strict=True)]
        self.counts = [m[size:] for m, size in zip(maps, vocabulary.sizes, strict=True)]
        self.start = np.concatenate([[0], np.cumsum(vocabulary.sizes)])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers (-1 if unknown) and counts of distinct words, and which of them each hash is."""
        distinct, back = np.unique(hashes.view(np.int64), return_inverse=True)
        numbers = np.full(len(distinct), -1, dtype=np.int64)
        counts = np.zeros(len(distinct), dtype=np.int64)
        if self.hashes:
            border = np.searchsorted(distinct, np.append(self.v.first[1:], np.iinfo(np.int64).max))
            border[-1] = len(distinct)
            low = 0
            for k, high in enumerate(border):
                if high > low:
                    keys = self.hashes[k]
                    place = np.minimum(np.searchsorted(keys, distinct[low:high]), len(keys) - 1)
                    same = keys[place] == distinct[low:high]
                    numbers[low:high][same] = self.start[k] + place[same]
                    counts[low:high][same] = self.counts[k][place[same]]
                low = high
        return numbers, counts, back


_OPEN: dict[str, Words | Scorer] = {}


def _words(vocabulary: Vocabulary) -> Words:
    if vocabulary.folder not in _OPEN:
        _OPEN[vocabulary.folder] = Words(vocabulary)
    return _OPEN[vocabulary.folder]


def _pairs(numbers: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Context and token of every place as one key; unknown ones must be masked by the caller."""
    context = np.empty(len(numbers), dtype=np.uint64)
    context[1:] = numbers[:-1].astype(np.uint64)
    first = np.ones(len(numbers), dtype=bool)
    first[1:] = doc[1:] != doc[:-1]
    context[first] = BEGIN_ID
    return (context << np.uint64(32)) | (numbers.astype(np.uint64) & np.uint64(0xFFFFFFFF))


def shard_of(keys: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each pair: by its context, or by the whole pair if the context is hot."""
    context = keys >> np.uint64(32)
    base = np.where(_in(context, hot), keys, context)
    return (arrays.mix(base) % np.uint64(shards)).astype(np.int64)


def _in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _narrow(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts in 32 bits, the greatest standing for all that do not fit, and the places of those."""
    return np.minimum(counts, LARGE).astype(np.uint32), np.flatnonzero(counts >= LARGE)


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted pairs by context: contexts, run lengths, tokens, counts, places and counts of large ones, compressed."""
    context = (keys >> np.uint64(32)).astype(np.uint32)
    first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    runs = np.diff(np.append(first, len(keys))).astype(np.uint32)
    small, large = _narrow(counts)
    head = np.array([len(first), len(keys), len(large)], np.uint32)
    body = [head, context[first], runs, keys.astype(np.uint32), small, large.astype(np.uint32), counts[large].astype(np.uint64)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in body))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(zstandard.decompress(data), dtype=np.uint32)
    contexts, pairs, large = (int(x) for x in numbers[:3])
    context, runs, token, counts, places, high = np.split(numbers[3:], np.cumsum([contexts, contexts, pairs, pairs, large]))
    counts = counts.astype(np.int64)
    counts[places] = np.frombuffer(high.tobytes(), dtype=np.uint64).astype(np.int64)
    return (np.repeat(context, runs).astype(np.uint64) << np.uint64(32)) | token, counts


def _shard_file(keys: np.ndarray, counts: np.ndarray, own: np.ndarray, followers: np.ndarray) -> list[bytes]:
    """Sorted pairs, large pairs with their counts, counts in 32 bits, contexts of the shard alone with their followers."""
    small, large = _narrow(counts)
    return [
        np.array([len(keys), len(large), len(own)], np.uint64).tobytes(), keys.tobytes(), keys[large].tobytes(),
        counts[large].astype(np.uint64).tobytes(), small.tobytes(), own.tobytes(), np.ascontiguousarray(followers).tobytes(),
    ]


class Shard(NamedTuple):
    pairs: np.ndarray
    large: np.ndarray
    large_counts: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    followers: np.ndarray

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Counts of some pairs."""
        place = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        found = np.where(self.pairs[place] == keys, self.counts[place], 0).astype(np.int64)
        many = np.flatnonzero(found == LARGE)
        found[many] = self.large_counts[np.searchsorted(self.large, keys[many])].astype(np.int64)
        return found


def _open_shard(raw: np.ndarray) -> Shard:
    pairs, large, contexts = (int(x) for x in raw[:24].view(np.uint64))
    borders = np.cumsum([24, 8 * pairs, 8 * large, 8 * large, 4 * pairs, 4 * contexts, 12 * contexts])
    parts = [raw[a:b] for a, b in zip(borders[:-1], borders[1:], strict=True)]
    kinds = [np.uint64, np.uint64, np.uint64, np.uint32, np.uint32, np.uint32]
    views = [part.view(kind) for part, kind in zip(parts, kinds, strict=True)]
    return Shard(*views[:5], views[5].reshape(-1, 3))


def _count_pairs(docs: DataFrame, vocabulary, hot, shards: int, settings: Settings) -> DataFrame:
    """shard, pairs: packed bigrams with their counts, added up per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums = _words(vocabulary.value), _Sums(settings.held)

        def out() -> pa.RecordBatch:
            keys, counts = sums.take()
            shard = shard_of(keys, hot.value, shards)
            order = np.argsort(shard, kind="stable")
            border = np.searchsorted(shard[order], np.arange(shards + 1))
            used = np.flatnonzero(np.diff(border))
            packed = [_pack(keys[part], counts[part]) for part in (order[border[k] : border[k + 1]] for k in used)]
            return pa.RecordBatch.from_arrays([pa.array(used), pa.array(packed, pa.binary())], ["shard", "pairs"])

        for batch in batches:
            for _, _, part in arrays.slices(arrays.texts(batch.column(0))):
                hashes, doc = tokens_of(part)
                numbers, _, back = words.find(hashes)
                if sums.add(*np.unique(_pairs(numbers[back], doc), return_counts=True)):
                    yield out()
        if sums.size:
            yield out()

    return docs.select("text").mapInArrow(run, "shard long, pairs binary")


def _spectrum(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5]


def _write_shards(counted: DataFrame, hot, folder: str, words: int, ranges: int, range_words: int) -> DataFrame:
    """A file per shard, and for every range of words how many contexts each has in the shard.

    A file has the sorted pairs, their counts, then the contexts of the shard alone with how
    many followers they have once, twice and more often.
    """

    def merge(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        parts = [_unpack(x.as_py()) for x in table.column("pairs")]
        keys, counts = arrays.add_up(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        context = (keys >> np.uint64(32)).astype(np.uint32)
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        followers = np.stack([np.add.reduceat((counts == k).astype(np.int64), first) for k in (1, 2)], axis=1)
        total = np.diff(np.append(first, len(keys)))
        followers = np.column_stack([followers, total - followers.sum(axis=1)]).astype(np.uint32)
        is_hot = _in(context[first].astype(np.uint64), hot.value)
        own = context[first][~is_hot]
        name = files.write_file(folder, f"pairs-{shard:06d}", _shard_file(keys, counts, own, followers[~is_hot]))
        token, contexts = np.unique(keys.astype(np.uint32), return_counts=True)
        border = np.searchsorted(token, np.minimum(np.arange(ranges + 1) * range_words, 1 << 32))
        blobs = [
            np.concatenate([token[a:b], contexts[a:b].astype(np.uint32)]).tobytes()
            for a, b in zip(border[:-1], border[1:], strict=True)
        ]
        hot_part = np.column_stack([context[first][is_hot], followers[is_hot]]).astype(np.uint32)
        meta = [name, len(keys), _spectrum(counts).tolist(), hot_part.tobytes()]
        return pa.table({
            "shard": pa.array([shard] * (ranges + 1), pa.int64()), "range": pa.array([-1, *range(ranges)], pa.int64()),
            "name": pa.array([meta[0], *[None] * ranges], pa.string()), "pairs": pa.array([meta[1], *[0] * ranges], pa.int64()),
            "spectrum": pa.array([meta[2], *[None] * ranges], pa.list_(pa.int64())),
            "data": pa.array([meta[3], *blobs], pa.binary()),
        })

    schema = "shard long, range long, name string, pairs long, spectrum array<long>, data binary"
    return stage(counted.groupBy("shard").applyInArrow(merge, schema), "shards")


def _write_ranges(rows: DataFrame, folder: str, words: int, range_words: int) -> list:
    """A file per range of words with each one's number of contexts; range, name, spectrum."""

    def merge(table: pa.Table) -> pa.Table:
        number = table.column("range")[0].as_py()
        low = number * range_words
        total = np.zeros(max(0, min(range_words, words - low)), dtype=np.uint32)
        for data in table.column("data"):
            token, contexts = np.split(np.frombuffer(data.as_py(), dtype=np.uint32), 2)
            total[token - np.uint32(low)] += contexts
        name = files.write_file(folder, f"contexts-{number:06d}", [total.tobytes()])
        return pa.table({"range": [number], "name": [name], "spectrum": pa.array([_spectrum(total).tolist()], pa.list_(pa.int64())),
                         "more": [int((total >= 3).sum())]})

    found = rows.where("range >= 0").select("range", "data").groupBy("range")
    return stage(found.applyInArrow(merge, "range long, name string, spectrum array<long>, more long"), "ranges").collect()


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Count all texts of ``docs`` (text; null is empty); other columns are ignored.

    The driver keeps a line per file, the hot contexts (each holds at least a quarter of a
    shard's tokens, so they are at most four per shard) and their counts of followers.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "model")
    counted = _count_words(docs, settings)
    tokens, words = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    texts = counted.where(F.col("word") == int(END.view(np.int64))).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if words >= int(BEGIN_ID):
        raise ValueError("more different words than 32 bits can number")
    vocabulary = _write_vocabulary(counted, folder)
    shards = max(settings.least_shards, -(-tokens // settings.shard_tokens))
    heavy = max(1, tokens // shards // 4)
    hot_hashes = np.array([r["word"] for r in counted.where(F.col("n") >= heavy).select("word").collect()], dtype=np.int64)
    hot = Words(vocabulary).find(hot_hashes)[0].astype(np.uint64)
    hot = np.unique(np.append(hot, BEGIN_ID) if texts >= heavy else hot)

    share = spark.sparkContext.broadcast
    pairs = _count_pairs(docs, share(vocabulary), share(hot), shards, settings)
    range_words = min(settings.range_words, max(1, -(-words // settings.least_ranges)))
    ranges = max(1, -(-words // range_words))
    written = _write_shards(pairs, share(hot), folder, words, ranges, range_words)
    meta = written.where("range = -1").select("shard", "name", "pairs", "spectrum", "data").collect()
    names: list[str | None] = [None] * shards
    followers = np.zeros((len(hot), 3), dtype=np.int64)
    for row in meta:
        names[row["shard"]] = row["name"]
        part = np.frombuffer(row["data"], dtype=np.uint32).reshape(-1, 4)
        followers[np.searchsorted(hot, part[:, 0].astype(np.uint64))] += part[:, 1:]
    spectrum = np.sum([row["spectrum"] for row in meta], axis=0) if meta else np.zeros(4)
    total = sum(row["pairs"] for row in meta)
    by_range = _write_ranges(written, folder, words, range_words)
    of_range: list[str | None] = [None] * ranges
    for row in by_range:
        of_range[row["range"]] = row["name"]
    spectrum_low = np.sum([row["spectrum"] for row in by_range], axis=0) if by_range else np.zeros(4)
    low = discounts(spectrum_low)
    more = sum(row["more"] for row in by_range)
    freed = (low[1] * spectrum_low[0] + low[2] * spectrum_low[1] + low[3] * more) / total if total else 1.0
    return Model(
        vocabulary, tokens, texts, words, names, hot, followers, of_range, range_words,
        (discounts(spectrum), low), total, float(freed),
    )


class Scorer:
    """A model, memory-mapped."""

    def __init__(self, model: Model) -> None:
        self.m, self.words = model, Words(model.vocabulary)
        folder = model.vocabulary.folder
        self.ranges = [files.mapped(folder, name, np.uint32) if name else None for name in model.ranges]
        self.shards = [_open_shard(files.mapped(folder, name, np.uint8)) if name else None for name in model.shards]

    def _word_share(self, numbers: np.ndarray) -> np.ndarray:
        """p(w) of distinct words."""
        m = self.m
        contexts = np.zeros(len(numbers), dtype=np.int64)
        part = numbers // m.range_words
        for k in np.unique(part[numbers >= 0]):
            here = (part == k) & (numbers >= 0)
            contexts[here] = self.ranges[k][numbers[here] - k * m.range_words]
        own = np.maximum(contexts - m.discounts[1][np.minimum(contexts, 3)], 0)
        return (own / m.pairs if m.pairs else np.zeros(len(numbers))) + m.freed / (m.words + 1)

    def _pair_parts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of distinct sorted pairs, and the freed mass (not yet divided) of their contexts."""
        m = self.m
        counts = np.zeros(len(keys), dtype=np.int64)
        freed = np.zeros(len(keys))
        high = m.discounts[0][1:]
        context = keys >> np.uint64(32)
        shard = shard_of(keys, m.hot, len(m.shards))
        # The followers of a context that is not hot are all in the shard that its own number names.
        order = np.argsort(shard, kind="stable")
        border = np.searchsorted(shard[order], np.arange(len(m.shards) + 1))
        for k in np.flatnonzero(np.diff(border)):
            if self.shards[k] is None:
                continue
            at = order[border[k] : border[k + 1]]
            contexts, followers = self.shards[k].contexts, self.shards[k].followers
            counts[at] = self.shards[k].find(keys[at])
            if len(contexts):
                wanted = context[at].astype(np.uint32)
                place = np.minimum(np.searchsorted(contexts, wanted), len(contexts) - 1)
                freed[at] = np.where(contexts[place] == wanted, followers[place] @ high, 0.0)
        if len(m.hot):
            place = np.minimum(np.searchsorted(m.hot, context), len(m.hot) - 1)
            is_hot = m.hot[place] == context
            freed[is_hot] = m.hot_followers[place[is_hot]] @ high
        return counts, freed

    def score(self, batch: arrays.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens, base score and score of each text."""
        m, texts = self.m, len(batch.offsets) - 1
        hashes, doc = tokens_of(batch)
        numbers, counts, back = self.words.find(hashes)
        share = self._word_share(numbers)[back]
        number, count = numbers[back], counts[back]
        first = np.ones(len(doc), dtype=bool)
        first[1:] = doc[1:] != doc[:-1]
        total = np.empty(len(doc), dtype=np.int64)  # tokens in training after this context
        total[1:] = count[:-1]
        total[first] = m.texts
        keys = _pairs(np.maximum(number, 0), doc)
        known = total > 0  # else the context was never seen
        distinct, pair_back = np.unique(keys[known], return_inverse=True)
        seen, freed = self._pair_parts(distinct)
        seen = np.where(number[known] >= 0, seen[pair_back], 0)
        chance = share.copy()
        own = np.maximum(seen - m.discounts[0][np.minimum(seen, 3)], 0)
        chance[known] = (own + freed[pair_back] * share[known]) / total[known]
        base = np.log10((count + 1) / (m.tokens + m.words + 1))
        return (
            np.bincount(doc, minlength=texts), np.bincount(doc, weights=count > 0, minlength=texts).astype(np.int64),
            np.bincount(doc, weights=base, minlength=texts), np.bincount(doc, weights=np.log10(chance), minlength=texts),
        )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score, score; only ``text`` is read for them.

    A null or empty text is its end token; a very long one is scored whole. An empty table gives no
    rows. A model of no texts gives every token the same share.
    Repeated rows get equal scores; input columns of these names are replaced.
    """
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [c for c in docs.columns if c not in names]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        model = shared.value
        key = f"{model.vocabulary.folder}/scorer"
        if key not in _OPEN:
            _OPEN[key] = Scorer(model)
        for first, last, part in arrays.slices(arrays.texts(batch.column(at))):
            tokens, known, base, own = _OPEN[key].score(part)
            rows = batch.slice(first, last - first)
            added = [pa.array(tokens), pa.array(known), pa.array([model.tokens] * (last - first), pa.int64()), pa.array(base), pa.array(own)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *added], [*rows.schema.names, *names])

    schema = ", ".join(
        [*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields),
         "n_tokens long, n_known long, train_tokens long, base_score double, score double"]
    )
    return docs.mapInArrow(arrays.mapper(run), schema)


def perplexity(tokens: Column, score: Column) -> Column:
    """Perplexity per token of a text from its log10 probability."""
    return F.pow(F.lit(10.0), -score / tokens)
