import math

import numpy as np
import pytest

from pyspark.sql import functions as F
from stratiform.llm import maxscore

SCHEMA = "vec_id long, embedding array<float>, score string, rank string, shard string, block string, parts string"


def brute(rows, k=10, scale=1024):
    whole = [
        (i, [math.floor(float(np.float32(x)) * scale) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    asked = {}
    for i, v in whole:
        if i % 100 == 0:
            asked[i] = max(asked.get(i, v), v)
    out = []
    for q, vector in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(vector, v)), i) for i, v in whole if i != q)[:k]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, *"xxxxx") for i, v in rows], SCHEMA)


@pytest.mark.parametrize(("dims", "share"), [(16, 1.0), (40, 0.15), (3, 0.5)])
def test_against_all_pairs(spark, dims, share):
    draw = np.random.default_rng(dims)
    rows = [(k, (draw.normal(size=dims) * (draw.random(dims) < share)).astype(np.float32).tolist()) for k in range(700)]
    settings = maxscore.Settings(shard_rows=100, query_rows=3, first_rows=20, probe_dims=2)
    found = maxscore.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0, settings)
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (100, [1.0]), (200, []), (300, None), (400, [None, 1.0]), (500, [nan, 1.0]), (600, [inf, 1.0]),
        (700, [0.0, 0.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, -2.0, 5.0]), (3, [1.0, 2.0]), (None, [9.0, 9.0]),
        (800, [3.0, 1.0]), (800, [3.0, 2.0]), (4, [1e30, -1e30]),
    ]
    rows = [r for r in rows if r[0] != 4]
    found = maxscore.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, found.collect())) == brute(rows)
    assert maxscore.top_k(vectors(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert maxscore.top_k(vectors(spark, [(1, [1.0])]), F.col("vec_id") % 100 == 0).count() == 0


def test_scores_beyond_what_doubles_hold(spark):
    rows = [(0, [3e6, 1.0]), (1, [2.9e6, 1.0]), (2, [2.9e6, 1.01]), (3, [-1.0, 0.0])]
    found = maxscore.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0, maxscore.Settings(k=2))
    assert sorted(map(tuple, found.collect())) == brute(rows, 2)


def test_pruning_leaves_rows_out():
    """Rows without a posting in an essential dimension are never probed."""
    matrix = np.zeros((1000, 8))
    matrix[:, 0] = 1
    matrix[:20, 1] = 100
    index = maxscore.Index(np.arange(1000), matrix)
    ids, scores = maxscore.search(index, -1, np.array([1.0, 1, 0, 0, 0, 0, 0, 0]), maxscore.Settings())
    assert ids.tolist() == list(range(10)) and set(scores.tolist()) == {101.0}
