"""Exact top-k search by inner product with MaxScore.

Components of the vectors are terms: a shard of candidates keeps, for every dimension, its
postings (rows with a component other than 0) and the greatest and least component. For a
query, a dimension's bound is the most that it can add to a score. Dimensions are sorted by
bound; as long as the bounds of the smallest ones add up to less than the k-th best score so
far, these are non-essential: rows that stand in their postings only cannot get in. Essential
postings are summed for all rows; the others are probed in falling order of their bounds,
for the rows that the remaining bounds still let reach the k-th score.

Shards are independent; their best k are merged per query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratiform.llm import files
from stratiform.session import new_path, stage

EXACT = float(1 << 53)
GROUP = 32  # blocks of queries that use a shard's postings one after another
MOST_TASKS = 100_000


@dataclass(frozen=True)
class Settings:
    k: int = 10
    scale: int = 1024
    shard_rows: int = 8192
    query_rows: int = 256
    first_rows: int = 512  # rows of a shard that are scored in full for a first k-th score
    probe_dims: int = 8


class Index:
    """The postings of one shard, a row per vector; absent components are 0."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.matrix = ids[order], matrix[order]
        self.top = self.matrix.max(axis=0, initial=0)
        self.low = self.matrix.min(axis=0, initial=0)
        self.columns = np.ascontiguousarray(self.matrix.T)
        self.dense = (self.matrix != 0).mean(axis=0) > 0.5 if len(ids) else np.zeros(matrix.shape[1], dtype=bool)
        self.postings = [None if dense else np.flatnonzero(col) for dense, col in zip(self.dense, self.columns, strict=True)]

    def add(self, total: np.ndarray, dim: int, weight) -> None:
        """Add one dimension's contributions to all rows of its postings."""
        rows = self.postings[dim]
        if rows is None:
            total += weight * self.columns[dim]
        else:
            total[rows] += weight * self.columns[dim][rows]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the lesser id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def search(index: Index, query_id: int, query: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows of a shard for one query, without the query's own row."""
    k, total_rows = settings.k, len(index.ids)
    own = index.ids == query_id
    dims = np.flatnonzero(query)
    bounds = np.maximum(np.maximum(query[dims] * index.top[dims], query[dims] * index.low[dims]), 0)
    order = np.argsort(bounds, kind="stable")
    dims, bounds = dims[order], bounds[order]
    up_to = np.cumsum(bounds)

    first = min(settings.first_rows, total_rows)
    scores = index.matrix[:first][:, dims] @ query[dims]
    allowed = scores[~own[:first]]
    threshold = np.partition(allowed, len(allowed) - k)[len(allowed) - k] if len(allowed) >= k else None
    if threshold is None:
        essential = 0
    else:
        essential = int(np.searchsorted(up_to, threshold, "left"))  # dimensions before it are non-essential

    partial = np.zeros(total_rows, dtype=index.matrix.dtype)
    seen = np.zeros(total_rows, dtype=bool)
    for dim in dims[essential:]:
        index.add(partial, dim, query[dim])
        rows = index.postings[dim]
        if rows is None:
            seen[:] = True
        else:
            seen[rows] = True
    if threshold is None or threshold <= 0:  # rows without any posting score 0
        seen[:] = True
    alive = np.flatnonzero(seen & ~own)
    partial = partial[alive]
    for high in range(essential, 0, -settings.probe_dims):
        low = max(0, high - settings.probe_dims)
        keep = partial + up_to[high - 1] >= threshold
        alive, partial = alive[keep], partial[keep]
        partial = partial + index.matrix[alive][:, dims[low:high]] @ query[dims[low:high]]
        if len(partial) >= k:
            threshold = max(threshold, np.partition(partial - _least(index, query, dims[:low]), len(partial) - k)[len(partial) - k])
    places = _best(partial, index.ids[alive], k)
    return index.ids[alive][places], partial[places]


def _least(index: Index, query: np.ndarray, dims: np.ndarray):
    """The most that the remaining dimensions can take away from a score."""
    return -np.minimum(np.minimum(query[dims] * index.top[dims], query[dims] * index.low[dims]), 0).sum()


def quantized(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and the components as floor(scale * x), x as double; vectors with null or non-finite ones are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return kept.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("parts"))


def _blocks(rows: DataFrame, key: str, folder: str) -> DataFrame:
    """One file per block of vectors, ids and then components as 64-bit integers: key, width, file."""

    def gather(table: pa.Table) -> pa.Table:
        parts = table.column("parts").combine_chunks()
        offsets = parts.offsets.to_numpy()
        width = int(np.max(np.diff(offsets), initial=0))
        matrix = np.zeros((len(parts), width), dtype=np.int64)
        flat = parts.values.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(parts)), np.diff(offsets))
        matrix[row, np.arange(offsets[0], offsets[-1]) - offsets[:-1][row]] = flat[offsets[0] : offsets[-1]]
        ids = table.column("vec_id").to_numpy().astype(np.int64)
        number = table.column(key)[0].as_py()
        name = files.write_file(folder, f"{key}-{number:08d}", [ids.tobytes(), matrix.tobytes()])
        return pa.table({key: pa.array([number], pa.int64()), f"{key}_width": [width], f"{key}_file": [name]})

    return stage(rows.groupBy(key).applyInArrow(gather, f"{key} long, {key}_width long, {key}_file string"), key)


def _load(folder: str, name: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(files.read_file(folder, name), dtype=np.int64)
    count = len(numbers) // (1 + width)
    return numbers[:count], numbers[count:].reshape(count, width)


def _wide(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def top_k(vectors: DataFrame, is_query, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows of ``vectors`` (vec_id, embedding), its own row excepted.

    ``is_query`` is a condition on vec_id. Vectors of different lengths are filled up with 0.
    Vectors that are null or hold a null, NaN or infinite component take no part, nor do rows
    without id; an empty vector scores 0 with all. Ties go to the lesser id. Rows that repeat an
    id are candidates of their own, in undetermined order among equals, and queries once, by
    their greatest vector. Other columns are ignored. Scores are exact as long as they fit 64 bits.

    Candidates are blocks of about ``shard_rows`` rows, dealt by hash of id and vector, so a
    repeated id does not fill a block; queries are blocks, too. Each block of queries meets each
    shard once, which is the work that the exact answer for a query set asks for.
    """
    spark = vectors.sparkSession
    rows = stage(quantized(vectors.select("vec_id", "embedding"), settings.scale), "vectors")
    asked = rows.where(is_query).groupBy("vec_id").agg(F.max("parts").alias("parts"))
    shards = max(1, -(-rows.count() // settings.shard_rows))
    blocks = max(1, -(-asked.count() // settings.query_rows))
    folder = new_path(spark, "vectors")
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "parts"), F.lit(shards)))
    candidates = _blocks(dealt, "shard", folder)
    queries = _blocks(asked.withColumn("block", F.pmod(F.xxhash64(F.lit(9), "vec_id"), F.lit(blocks))), "block", folder)
    # A work item is two file names; items of a shard lie together, so its postings are built once.
    numbers = F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")
    work = queries.withColumn("shard", F.explode(numbers)).join(candidates, "shard")
    work = work.withColumn("part", F.floor(F.col("block") / GROUP))
    # A number of partitions, or few bytes of names become few tasks.
    groups = shards * -(-blocks // GROUP)
    work = work.repartition(min(groups, MOST_TASKS), "shard", "part").sortWithinPartitions("shard", "block")

    def run(batches):
        held: tuple = (None, None)
        for batch in batches:
            for row in batch.to_pylist():
                ids, matrix = _load(folder, row["shard_file"], row["shard_width"])
                query_ids, vectors = _load(folder, row["block_file"], row["block_width"])
                wide = max(matrix.shape[1], vectors.shape[1])
                reach = float(np.abs(matrix).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * wide
                kind = np.float64 if reach < EXACT else object  # whole numbers are exact in doubles up to there
                if held[0] != (row["shard"], wide, kind):
                    held = (row["shard"], wide, kind), Index(ids, _wide(matrix, wide).astype(kind))
                vectors = _wide(vectors, wide).astype(kind)
                found = [search(held[1], q, vector, settings) for q, vector in zip(query_ids.tolist(), vectors, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(query_ids, [len(x[0]) for x in found])),
                        pa.array(np.concatenate([x[0] for x in found])),
                        pa.array([int(score) for x in found for score in x[1]], pa.int64()),
                    ],
                    ["query_id", "vec_id", "score"],
                )

    best = work.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.k).select(
        "query_id", "rank", "vec_id", "score"
    )
