"""Near-duplicate documents by HyperMinHash sketches.

A document's set holds the hashes of its distinct shingles (five successive words; the whole
sequence if it has fewer). Its sketch has 512 buckets; each keeps, for the least hash that fell
into it, the count of leading zeros and the next ten bits. For banding, sketches of fewer
buckets are taken, as many as the set fills: 32 of 4 buckets for small sets, 8 of 16 for
middling and one of 128 for large ones, with an overlap so that sets of similar sizes have one
kind in common. Four registers form a band; documents that share a band are candidates.
Candidates pass if the Jaccard estimate of their sketches, corrected for registers that agree by
chance, is within five standard errors of the threshold, and are linked if the exact similarity
of the full sets reaches it.

No group is paired out. Documents with equal sets count once. In each band the links to one
leader are tried first, its least document. Bands whose documents are one component by then are
done; the others elect another leader, the document with most links so far, which is the centre
where copies are linked through one text only, and so on in rounds as long as these shrink what
is left. What stays apart, mostly texts that share a passage and no more, meets in blocks of
bounded size, each pair in the first band that it shares; there the full sets of all but long
texts are compared at once, so that no list of pairs is made that are not links. Two documents of
a band are therefore always tried or already connected.

At the threshold of 0.75 a pair shares none of 32 bands with a probability of about 5 in a
million.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiform.llm import arrays
from stratiform.llm.components import components
from stratiform.session import broadcast_within, stage

BUCKETS = 512
MANTISSA_BITS = 10
BAND_ROWS = 4  # registers of 16 bits, so a band is 64 bits
# Least and most shingles, buckets of a sketch, sketches: each kind gives 32 bands.
KINDS = ((1, 64, 4, 32), (48, 683, 16, 8), (384, 1 << 62, 128, 1))
BANDS = 32 * len(KINDS)
SET = ["doc_id", "key_a", "key_b", "n"]  # a row of ``reps``: an id that stands with several texts has several sets
IDS_LIMIT_BYTES = 32 * 1024 * 1024


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 75  # least similarity, in hundredths
    block: int = 1024  # documents of a band that meet in one task, with as many others
    exact: int = 1024  # most shingles of a set that is compared in full where documents meet
    shrink: float = 0.8  # another round of leaders follows if the last one left at most this share


def shingles(batch: arrays.Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin."""
    found = arrays.words(batch)
    border = arrays.per_text(batch, found.doc)
    runs, doc = arrays.run_hashes(found.hash, found.doc, width)
    counts = np.diff(border)
    short = np.flatnonzero((counts > 0) & (counts < width))
    whole = [arrays.sequence_hash(found.hash[border[k] : border[k + 1]]) for k in short]
    runs = np.concatenate([runs, np.array(whole, dtype=np.uint64)])
    doc = np.concatenate([doc, short])
    order = np.lexsort((runs, doc))
    runs, doc = runs[order], doc[order]
    first = np.ones(len(runs), dtype=bool)
    first[1:] = (runs[1:] != runs[:-1]) | (doc[1:] != doc[:-1])
    runs, doc = runs[first], doc[first]
    return runs, np.searchsorted(doc, np.arange(len(batch.offsets)), "left")


def registers(hashes: np.ndarray, border: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """HyperMinHash registers, one row per set; 0 is an empty bucket.

    A register is greater for a lesser hash: one more than the leading zeros, then the
    inverted bits after the first one.
    """
    count, bits = len(border) - 1, buckets.bit_length() - 1
    out = np.zeros(count * buckets, dtype=np.uint16)
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    rest = (hashes << np.uint64(bits)) | np.uint64(1 << (bits - 1))
    length = np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]
    zeros = np.minimum(53 - length, 52).astype(np.uint64)
    after = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA_BITS)
    code = ((zeros + np.uint64(1)) << np.uint64(MANTISSA_BITS)) | (np.uint64((1 << MANTISSA_BITS) - 1) - after)
    doc = np.repeat(np.arange(count), np.diff(border))
    np.maximum.at(out, doc * buckets + bucket, code.astype(np.uint16))
    return out.reshape(count, buckets)


def bands(hashes: np.ndarray, border: np.ndarray) -> np.ndarray:
    """The bands of each set, one row of 96 keys; 0 where a set has no such band or it is empty."""
    sizes = np.diff(border)
    out = np.zeros((len(sizes), BANDS), dtype=np.uint64)
    for kind, (least, most, buckets, sketches) in enumerate(KINDS):
        chosen = np.flatnonzero((sizes >= least) & (sizes <= most))
        if not len(chosen):
            continue
        own = hashes[np.repeat((sizes >= least) & (sizes <= most), sizes)]
        own_border = np.concatenate([[0], np.cumsum(sizes[chosen])])
        for k in range(sketches):
            seed = np.uint64((kind * 100 + k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            values = registers(arrays.mix(own + seed), own_border, buckets).view(np.uint64)
            number = kind * 32 + k * (buckets // BAND_ROWS) + np.arange(buckets // BAND_ROWS)
            keys = arrays.mix(values + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            out[np.ix_(chosen, number)] = np.where(values == 0, np.uint64(0), keys)
    return out


def second_hashes(hashes: np.ndarray) -> np.ndarray:
    return arrays.mix(hashes + np.uint64(0x9E3779B97F4A7C15))


def similar(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, share: float) -> np.ndarray:
    """Which pairs of sketch rows may reach ``share``, by the corrected estimate and the sizes."""
    used = np.maximum(((a > 0) | (b > 0)).sum(axis=1), 1)
    agree = ((a == b) & (a > 0)).sum(axis=1)
    ratio = np.minimum(sizes_a, sizes_b) / np.maximum(np.maximum(sizes_a, sizes_b), 1)
    # Expected chance agreements of two disjoint sets of these sizes, as published for HyperMinHash.
    chance = 0.169919487159739093975 * BUCKETS / 2.0**MANTISSA_BITS * 4 * ratio / (1 + ratio) ** 2
    estimate = (agree - chance) / used
    # Used buckets are a sample without replacement from the union, which has this size at ``share``.
    union = (sizes_a + sizes_b) / (1 + share)
    left_out = np.maximum(0.0, 1 - used / np.maximum(union, used))
    margin = 5 * np.sqrt(share * (1 - share) / used * left_out) + 2 / used
    return (estimate >= share - margin) & (ratio >= share - 1e-9)


def _list_column(values: np.ndarray, border: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(border.astype(np.int64)), pa.array(values.view(np.int64))).cast(
        pa.list_(pa.int64())
    )


def _sketches(docs: DataFrame, settings: Settings) -> DataFrame:
    """A row per input row: doc_id, n, fingerprint of the set, sketch, bands, and 32 bits of each band by number."""

    def run(batch: pa.RecordBatch):
        for first, last, part in arrays.slices(arrays.texts(batch.column(1))):
            hashes, border = shingles(part, settings.words)
            sizes = np.diff(border)
            sums = _sums(hashes, border)
            sketch = registers(hashes, border)
            keys = bands(hashes, border)
            filled = sizes > 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, last - first),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(sums[0].view(np.int64)),
                    pa.array(sums[1].view(np.int64)),
                    pa.array([row.tobytes() if full else None for row, full in zip(sketch, filled, strict=True)], pa.binary()),
                    _list_column(keys[keys != 0], np.concatenate([[0], np.cumsum((keys != 0).sum(axis=1))])),
                    pa.array([row.tobytes() for row in (keys >> np.uint64(32)).astype(np.uint32)], pa.binary()),
                ],
                ["doc_id", "n", "key_a", "key_b", "sketch", "bands", "marks"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        arrays.mapper(run),
        f"doc_id {kind}, n long, key_a long, key_b long, sketch binary, bands array<long>, marks binary",
    )


def _sums(hashes: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Two sums over each set, which tell different sets apart."""
    sums = np.zeros((2, len(border) - 1), dtype=np.uint64)
    filled = np.diff(border) > 0
    if len(hashes):
        for k, values in enumerate((arrays.mix(hashes), second_hashes(hashes))):
            sums[k, filled] = np.add.reduceat(values, border[:-1][filled])
    return sums


def _sets(docs: DataFrame, settings: Settings) -> DataFrame:
    def run(batch: pa.RecordBatch):
        for first, last, part in arrays.slices(arrays.texts(batch.column(1)), 1 << 20):
            hashes, border = shingles(part, settings.words)
            sums = _sums(hashes, border)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, last - first),
                    pa.array(sums[0].view(np.int64)),
                    pa.array(sums[1].view(np.int64)),
                    pa.array(np.diff(border).astype(np.int64)),
                    _list_column(hashes, border),
                ],
                [*SET, "members"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        arrays.mapper(run), f"doc_id {kind}, key_a long, key_b long, n long, members array<long>"
    )


def _matrix(column: pa.Array | pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def _likely(pairs: DataFrame, reps: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose sketches may reach the threshold."""
    a = reps.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sketch_a"), F.col("n").alias("n_a"))
    b = reps.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sketch_b"), F.col("n").alias("n_b"))
    share = settings.percent / 100

    def run(batch: pa.RecordBatch):
        for low in range(0, batch.num_rows, 1000):
            part = batch.slice(low, 1000)
            one, other = (_matrix(part.column(k), BUCKETS, np.uint16) for k in (2, 4))
            sizes = [part.column(k).to_numpy(zero_copy_only=False) for k in (3, 5)]
            fits = similar(one, other, *sizes, share)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(fits))

    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "sketch_a", "n_a", "sketch_b", "n_b")
    kind = reps.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(arrays.mapper(run), f"a {kind}, b {kind}")


def _of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").join(broadcast_within(ids, IDS_LIMIT_BYTES), "doc_id", "left_semi")


def _links(pairs: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """The pairs whose full sets reach the threshold.

    Sets are taken from the texts again, of the documents concerned only: their ids are
    broadcast if they measure at most 32 MB, and joined by a shuffle beyond that.
    """
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = stage(_sets(_of(docs, ids), settings), "sets")
    a = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("set_a"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("set_b"))
    common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    total = F.size("set_a").cast("long") + F.size("set_b").cast("long")
    joined = pairs.join(a, "a").join(b, "b")
    linked = joined.where(100 * common >= settings.percent * (total - common))
    return stage(linked.select("a", "b"), "verified")


def _open(members: DataFrame) -> DataFrame:
    """The rows of bands that hold more than one component."""
    bands = members.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return members.join(bands.where("low <> high").select("band"), "band")


def _merged(members: DataFrame, links: DataFrame, pairs: DataFrame) -> DataFrame:
    """``members`` with the components that the links join put together."""
    ends = pairs.join(links, ["a", "b"]).select(F.col("component_a").alias("a"), F.col("component_b").alias("b"))
    return _relabelled(members, components(ends))


def _relabelled(members: DataFrame, places: DataFrame) -> DataFrame:
    moved = places.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return members.join(moved, "component", "left").withColumn("component", F.coalesce("_to", "component")).drop("_to")


def _led(members: DataFrame, links: DataFrame, settings: Settings, number: int) -> tuple[DataFrame, DataFrame]:
    """The members, with new leaders marked, and each leader's pairs with the members of other components.

    A band's leader is, of those that have not led it, the document with most links, then the first
    in an order that changes with the round.
    """
    ends = links.select(F.col("a").alias("doc_id")).union(links.select("b"))
    degrees = ends.groupBy("doc_id").agg(F.count("*").alias("degree"))
    ranked = members.join(degrees, "doc_id", "left")
    order = F.struct(
        F.coalesce("degree", F.lit(0)).alias("degree"), F.xxhash64(F.lit(number), "doc_id").alias("order"),
        "doc_id", "key_a", "key_b", "n", "component",
    )
    leaders = ranked.groupBy("band").agg(F.max(F.when(~F.col("led"), order)).alias("leader"))
    both = stage(members.join(leaders, "band"), "led")
    is_leader = (F.col("doc_id") == F.col("leader.doc_id")) & (F.col("key_a") == F.col("leader.key_a"))
    marked = both.withColumn("led", F.col("led") | F.coalesce(is_leader, F.lit(False))).drop("leader")
    share = settings.percent / 100
    near = F.least("n", "leader.n") >= share * F.greatest("n", "leader.n") - 1e-9
    pairs = both.where((F.col("component") != F.col("leader.component")) & near).select(
        F.least("doc_id", "leader.doc_id").alias("a"), F.greatest("doc_id", "leader.doc_id").alias("b"),
        F.when(F.col("doc_id") < F.col("leader.doc_id"), F.col("component")).otherwise(F.col("leader.component")).alias("component_a"),
        F.when(F.col("doc_id") < F.col("leader.doc_id"), F.col("leader.component")).otherwise(F.col("component")).alias("component_b"),
    )
    return marked, stage(pairs.distinct(), "led-pairs")


def _across(members: DataFrame, reps: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of documents that share a band but are not one component: a, b, sure.

    A pair is ``sure`` if its full sets reach the threshold; pairs with a longer set are only likely.
    """
    blocks = members.groupBy("band").agg(F.ceil(F.count("*") / settings.block).cast("int").alias("blocks"))
    small = members.where(F.col("n") <= settings.exact).select("doc_id").distinct()
    sets = _sets(_of(docs, small), settings).where(F.col("n") <= settings.exact).dropDuplicates(SET)
    carried = reps.select(*SET, "sketch", "marks").join(members.select(*SET).distinct(), SET, "left_semi")
    carried = stage(carried.join(sets, SET, "left"), "carried")
    members = members.join(blocks, "band")
    members = members.withColumn("own", F.pmod(F.xxhash64("doc_id", "key_a"), F.col("blocks")).cast("int"))
    members = members.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    members = members.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    members = members.select("band", "low", "high", "own", "component", *SET).join(carried, SET)
    share = settings.percent / 100

    def meet(table: pa.Table) -> pa.Table:
        matrix, marks = _matrix(table.column("sketch"), BUCKETS, np.uint16), _matrix(table.column("marks"), BANDS, np.uint32)
        sizes, component = table.column("n").to_numpy(), table.column("component").to_numpy()
        own, low, high = (table.column(x).to_numpy() for x in ("own", "low", "high"))
        full = table.column("members").combine_chunks()
        border, values = full.offsets.to_numpy(), full.values.to_numpy(zero_copy_only=False).view(np.uint64)
        known = sizes <= settings.exact
        key = np.int64(table.column("band")[0].as_py()).view(np.uint64) >> np.uint64(32)
        here = int(np.flatnonzero(marks[0] == key)[0])
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        found: list[tuple[int, int, bool]] = []
        for k in left:
            others = right[component[right] != component[k]]
            if low[0] == high[0]:
                others = others[others > k]
            near = np.minimum(sizes[others], sizes[k]) >= share * np.maximum(sizes[others], sizes[k]) - 1e-9
            others = others[near]
            if not len(others):
                continue
            fits = similar(matrix[k], matrix[others], sizes[k], sizes[others], share)
            others = others[fits]
            if here:
                others = others[~((marks[others, :here] == marks[k, :here]) & (marks[k, :here] != 0)).any(axis=1)]
            mine = values[border[k] : border[k + 1]]
            for other in others:
                sure = bool(known[k] and known[other])
                if sure:
                    common = len(np.intersect1d(mine, values[border[other] : border[other + 1]], assume_unique=True))
                    if 100 * common < settings.percent * (sizes[k] + sizes[other] - common):
                        continue
                found.append((k, other, sure))
        ids = table.column("doc_id")
        a, b = (ids.take(pa.array([f[side] for f in found], pa.int64())) for side in (0, 1))
        return pa.table({"a": a, "b": b, "sure": pa.array([f[2] for f in found], pa.bool_())})

    kind = reps.schema["doc_id"].dataType.simpleString()
    pairs = members.groupBy("band", "low", "high").applyInArrow(meet, f"a {kind}, b {kind}, sure boolean")
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sure").alias("sure"))


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` rows as doc_id, n_shingles, component_id, kept.

    ``docs`` needs doc_id (an integer) and text; other columns are ignored. A null or empty
    text, or one without words, has an empty set and is linked with nothing. Equal texts are
    linked. A row without id takes no part: its component is null and it is kept. Rows that
    repeat an id are texts of one document, which is linked with all that any of them is
    linked with; each gives a row. Very long texts are taken whole. Empty input gives no rows.
    """
    rows = stage(_sketches(docs, settings), "sketches")
    full = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = stage(full.groupBy("key_a", "key_b", "n").agg(F.min("doc_id").alias("rep")), "classes")
    reps = full.join(
        classes.select(F.col("rep").alias("doc_id"), "key_a", "key_b", "n"), SET, "left_semi"
    )
    reps = stage(reps.dropDuplicates(SET), "reps")

    banded = reps.select(F.explode("bands").alias("band"), F.struct("doc_id", "n").alias("doc"), "key_a", "key_b")
    leaders = banded.groupBy("band").agg(F.min("doc").alias("leader"), F.max("doc").alias("last")).where("leader <> last")
    shared = stage(banded.join(leaders.select("band", "leader"), "band"), "shared")
    share = settings.percent / 100
    near = F.least("doc.n", "leader.n") >= share * F.greatest("doc.n", "leader.n") - 1e-9
    stars = shared.where((F.col("doc.doc_id") != F.col("leader.doc_id")) & near)
    stars = stars.select(F.col("leader.doc_id").alias("a"), F.col("doc.doc_id").alias("b")).distinct()
    first = _links(stage(_likely(stars, reps, settings), "pairs"), docs, settings)

    members = shared.select(
        "band", "doc.doc_id", "key_a", "key_b", "doc.n", F.col("doc.doc_id").alias("component"),
        (F.col("doc.doc_id") == F.col("leader.doc_id")).alias("led"),
    )
    links, left = first, None
    members = stage(_open(_relabelled(members, components(first))), "open")
    count = members.count()
    number = 0
    while count and (left is None or count <= settings.shrink * left):
        number += 1
        marked, pairs = _led(members, links, settings, number)
        likely = stage(_likely(pairs.select("a", "b").distinct(), reps, settings), "pairs")
        new = _links(likely, docs, settings)
        members = stage(_open(_merged(marked, new, pairs)), "open")
        links = stage(links.union(new), "links-so-far")
        left, count = count, members.count()
    if count:
        more = stage(_across(members, reps, docs, settings), "met")
        unsure = more.where("NOT sure").select("a", "b")
        links = links.union(more.where("sure").select("a", "b"))
        if not unsure.isEmpty():
            links = links.union(_links(unsure, docs, settings))

    members = full.join(classes, ["key_a", "key_b", "n"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    groups = components(links.union(members.where("a <> b")))
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(
        groups, F.col("doc_id") == F.col("node"), "left"
    )
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
