import numpy as np
import pytest
from helpers import SF_DIR, awkward, doc, frame, words

from stratiform.llm import mixing


def reshared(sizes, weights, repeats=3):
    """Targets by sharing the excess again until none is above."""
    total, target, full = sum(sizes), [0.0] * len(sizes), [False] * len(sizes)
    while True:
        left = total - sum(t for t, f in zip(target, full, strict=True) if f)
        free = sum(w for w, f in zip(weights, full, strict=True) if not f)
        over = False
        for k in range(len(sizes)):
            if not full[k]:
                target[k] = left * weights[k] / free
        for k in range(len(sizes)):
            if not full[k] and target[k] > repeats * sizes[k]:
                target[k], full[k], over = repeats * sizes[k], True, True
        if not over:
            return target


def test_targets_against_repeated_sharing():
    draw = np.random.default_rng(1)
    for _ in range(300):
        sizes = draw.integers(0, 1000, draw.integers(1, 9)).tolist()
        weights = [1.0 + k % 3 for k in range(len(sizes))]
        if sum(sizes):
            got = mixing.targets(sizes, weights, 3)
            assert np.allclose(got, reshared(sizes, weights))
            assert np.isclose(sum(got), sum(sizes))
    assert mixing.targets([0, 0], [1.0, 2.0], 3) == [0.0, 0.0]


@pytest.mark.parametrize("table", [8, 64, 1 << 16])
def test_counts_fit_the_budget(table):
    draw = np.random.default_rng(2)
    for _ in range(200):
        lengths = np.unique(draw.integers(1, 400, draw.integers(1, 20)))
        counts = draw.integers(1, 30, len(lengths))
        total = int((lengths * counts).sum())
        repeats = int(draw.integers(1, 4))
        budget = int(draw.integers(0, total * repeats + 1))
        taken = mixing.fit_counts(lengths, counts, budget, repeats, table)
        used = int((taken * lengths).sum())
        assert (taken >= 0).all() and (taken <= repeats * counts).all() and used <= budget
        assert budget - used < lengths.max() if budget < repeats * total else used == repeats * total


def test_knapsack_finds_the_best_sum():
    draw = np.random.default_rng(3)
    for _ in range(200):
        lengths = np.unique(draw.integers(1, 40, 4))
        room = draw.integers(0, 4, len(lengths))
        budget = int(draw.integers(0, 120))
        sums = {0}
        for length, most in zip(lengths.tolist(), room.tolist(), strict=True):
            sums = {s + k * length for s in sums for k in range(most + 1)}
        chosen = mixing._fill(lengths, room, budget)
        assert (chosen <= room).all()
        assert int((chosen * lengths).sum()) == max(s for s in sums if s <= budget)


def check(rows, texts):
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(ordered, reshared([sizes[s] for s in ordered], [1.0 + k % 3 for k in range(len(ordered))]), strict=True))
    for source in ordered:
        own = [r for r in rows if r["source"] == source]
        assert all(r["source_size"] == sizes[source] and np.isclose(r["target"], want[source]) for r in own)
        longest = max(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - want[source]) <= longest
        assert all(r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3 for r in own)
    assert sorted(r["size"] for r in rows) == sorted(len(words(t)) for t in texts)


def test_test_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = mixing.mix(docs).collect()
    check(rows, [r["text"] for r in docs.collect()])
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 3
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_awkward_documents(spark):
    rows = mixing.mix(frame(spark)).collect()
    check(rows, [row[1] for row in awkward()])
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mix(frame(spark, [])).count() == 0
    assert {r["target"] for r in mixing.mix(frame(spark, [doc(1, None), doc(2, "")])).collect()} == {0.0}


def test_a_large_group_of_one_length_is_split_in_seeded_order(spark):
    rows = [doc(k, "a b c", "en", "big") for k in range(900)] + [doc(5000 + k, "a b", "en", f"t{k}") for k in range(4)]
    out = mixing.mix(frame(spark, rows)).collect()
    big = [r for r in out if r["source"] == "big"]
    assert abs(sum(r["taken"] for r in big) - big[0]["target"]) <= 3
    again = mixing.mix(frame(spark, rows[::-1])).collect()
    assert {(r["doc_id"], r["copies"]) for r in out} == {(r["doc_id"], r["copies"]) for r in again}
    tied = mixing.mix(frame(spark, [doc(1, "a b c", "en", "big")] * 50 + [doc(2, "a", "en", "t")])).collect()
    assert len(tied) == 51
