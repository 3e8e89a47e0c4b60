"""Mixing sources to target weights by subset-sum budget fitting.

Documents of a source are counted by exact length in words. Every length gives copies in
proportion to the source's budget, and a bounded-knapsack dynamic program over what the length
counts still allow fits the words that remain. Only the counts are fitted; then each length's
copies are dealt to its documents evenly, the last ones in a seeded order of their ids.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiform.session import broadcast_within, stage

WORD = r"[^\x20\x09-\x0D]+"


MOST_TASKS = 1000
PLAN_LIMIT_BYTES = 32 * 1024 * 1024  # counts per length take several times their bytes as a hash table


@dataclass(frozen=True)
class Settings:
    weights: Sequence[float] = (1.0, 2.0, 3.0)  # dealt to the sources in turn
    repeats: int = 3  # most copies of a document
    seed: int = 5
    table: int = 1 << 16  # most words that the dynamic program looks ahead


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(settings: Settings = Settings()) -> Column:
    """The seeded number that orders documents of one length; equal for equal ids and texts only."""
    return F.xxhash64(F.lit(settings.seed), "doc_id", "text")


def targets(sizes: Sequence[int], weights: Sequence[float], repeats: int) -> list[float]:
    """Shares of the total by weight, each at most ``repeats`` times its size, the excess shared again.

    That is min(cap, level * weight) for the level at which the shares add up to the total.
    """
    total, level = float(sum(sizes)), 0.0
    caps = [float(repeats * size) for size in sizes]
    free, left = float(sum(weights)), total
    for k in sorted(range(len(sizes)), key=lambda k: caps[k] / weights[k]):
        level = left / free if free > 0 else 0.0
        if caps[k] > level * weights[k]:
            break
        left -= caps[k]
        free -= weights[k]
    return [min(cap, level * weight) for cap, weight in zip(caps, weights, strict=True)]


def _fill(lengths: np.ndarray, room: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: how many of each length, at most ``room``, come nearest below ``budget``."""
    items: list[tuple[int, int, int]] = []  # words, place of the length, copies: counts in powers of two
    for k, (length, most) in enumerate(zip(lengths.tolist(), room.tolist(), strict=True)):
        most, step = min(most, budget // length), 1
        while most > 0:
            step = min(step, most)
            items.append((length * step, k, step))
            most -= step
            step *= 2
    first = np.full(budget + 1, -1, dtype=np.int64)  # the item by which a sum was reached first
    reached = np.zeros(budget + 1, dtype=bool)
    reached[0] = True
    for place, (words, _, _) in enumerate(items):
        if words > budget:
            continue
        new = reached[: budget + 1 - words] & ~reached[words:]
        at = np.flatnonzero(new) + words
        reached[at] = True
        first[at] = place
        if reached[budget]:
            break
    at = int(np.flatnonzero(reached)[-1])
    chosen = np.zeros(len(lengths), dtype=np.int64)
    while at > 0:  # an item's predecessor was reached before it, so no item is used twice
        words, k, copies = items[first[at]]
        chosen[k] += copies
        at -= words
    return chosen


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, repeats: int, table: int) -> np.ndarray:
    """How many copies of documents of each length to take for at most ``budget`` words, as near as found.

    No length gives more than ``repeats`` copies of all its documents. Some words are kept back
    for the dynamic program: four times the longest document, or half of ``table`` if that is
    less. Of the others every length gets its proportional share, rounded down; what that leaves
    is given to the lengths with the greatest rounded-off parts, then to the longest documents,
    until ``table`` words or fewer are left or none fits. The dynamic program fits these.
    """
    room = counts * repeats
    total = int((lengths * counts).sum())
    if budget >= total * repeats or not len(lengths):
        return room
    kept_back = min(budget, table // 2, 4 * int(lengths.max()))
    exact = counts * ((budget - kept_back) / total)
    taken = np.minimum(np.floor(exact).astype(np.int64), room)
    left = budget - int((taken * lengths).sum())
    while left < 0:  # rounding of very large sums
        k = int(np.argmax(np.where(taken > 0, lengths, -1)))
        taken[k] -= 1
        left += int(lengths[k])
    for k in np.argsort(-(exact - taken), kind="stable"):
        if left <= table:
            break
        if taken[k] < room[k] and lengths[k] <= left - table // 2:
            taken[k] += 1
            left -= int(lengths[k])
    for reserve in (table // 2, 0):  # still too much: whole documents, longest first
        for k in np.argsort(-lengths, kind="stable"):
            if left <= table:
                break
            more = min(int(room[k] - taken[k]), max(0, left - reserve) // int(lengths[k]))
            taken[k] += more
            left -= more * int(lengths[k])
    return taken + _fill(lengths, room - taken, min(left, table))


def _plan(sizes: DataFrame, budgets: DataFrame, sources: int, settings: Settings) -> DataFrame:
    """source_key, size, count, and how many copies documents of this size get in all.

    A group is the length counts of one source: as many rows as it has different lengths.
    """

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("size")
        lengths, counts = table.column("size").to_numpy(), table.column("n").to_numpy()
        budget = int(table.column("budget")[0].as_py())
        taken = np.zeros(len(lengths), dtype=np.int64)
        filled = lengths > 0
        taken[filled] = fit_counts(lengths[filled], counts[filled], budget, settings.repeats, settings.table)
        return pa.table({"source_key": table.column("source_key"), "size": lengths, "n": counts, "given": taken})

    # A number of partitions, or the few bytes of all sources become one task.
    dealt = sizes.join(budgets, "source_key").repartition(min(max(1, sources), MOST_TASKS), "source_key")
    return dealt.groupBy("source_key").applyInArrow(
        fit, "source_key string, size long, n long, given long"
    )


def _source_key(source: Column) -> Column:
    """A text that tells a null source from any other."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))


def mix(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies, draw for every row of ``docs``.

    ``docs`` needs doc_id, text and source; other columns are ignored. A null text has size 0,
    and rows of size 0 take nothing; very long texts are counted whole, and an empty table gives no rows. Sources are ranked by code point, null last, and weigh by
    rank. The driver holds one row per source. Equal rows are taken independently, in an order
    that ends with the text's hash, so reruns agree. Without words every target is 0.
    """
    rows = stage(
        docs.select(
            "doc_id", "source", _source_key(F.col("source")).alias("source_key"), word_count(F.col("text")).alias("size"),
            draw(settings).alias("draw"),
        ),
        "sizes",
    )
    counted = stage(rows.groupBy("source_key", "size").agg(F.count("*").alias("n")), "lengths")
    totals = counted.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).collect()
    totals.sort(key=lambda row: (row["source_key"] == "", row["source_key"]))
    weights = [settings.weights[k % len(settings.weights)] for k in range(len(totals))]
    wanted = targets([row["source_size"] for row in totals], weights, settings.repeats)
    plans = []
    for row, target in zip(totals, wanted, strict=True):
        plans.append((row["source_key"], row["source_size"], target, round(target)))
    spark = docs.sparkSession
    budgets = spark.createDataFrame(plans, "source_key string, source_size long, target double, budget long")
    plan = _plan(counted, budgets.select("source_key", "budget"), len(plans), settings)
    each = F.floor(F.col("given") / F.col("n")).cast("long")  # copies that every document of a size gets
    plan = stage(plan.select("source_key", "size", "n", each.alias("each"), (F.col("given") - each * F.col("n")).alias("more")), "plan")

    # Documents of a length are cut into slots of about the root of their number by the draw: slots
    # before the border slot are taken whole, and only rows of the border slot are ordered.
    slots = F.ceil(F.sqrt("n")).cast("long")
    slotted = (
        rows.join(broadcast_within(plan, PLAN_LIMIT_BYTES), ["source_key", "size"])
        .join(broadcast_within(budgets.drop("budget"), PLAN_LIMIT_BYTES), "source_key")
        .withColumn("slot", F.pmod(F.shiftrightunsigned("draw", 1), slots))
    )
    partial = slotted.where("more > 0")
    by_slot = partial.groupBy("source_key", "size", "slot").agg(F.first("more").alias("more"), F.count("*").alias("here"))
    running = Window.partitionBy("source_key", "size").orderBy("slot")
    by_slot = by_slot.withColumn("rest", F.col("more") - (F.sum("here").over(running) - F.col("here")))
    by_slot = stage(by_slot.drop("more"), "slots")
    slotted = slotted.join(broadcast_within(by_slot, PLAN_LIMIT_BYTES), ["source_key", "size", "slot"], "left")
    in_border = F.coalesce(F.col("rest").between(1, F.col("here") - 1), F.lit(False))
    decided = slotted.where(~in_border).withColumn("extra", (F.coalesce("rest", F.lit(0)) > 0).cast("int"))
    order = Window.partitionBy("source_key", "size", "slot").orderBy("draw", "doc_id")
    ordered = slotted.where(in_border).withColumn("extra", (F.row_number().over(order) <= F.col("rest")).cast("int"))
    copies = F.when(F.col("size") > 0, F.col("each") + F.col("extra")).otherwise(0).cast("long")
    return decided.unionByName(ordered).select(
        "doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"),
        "draw",
    )
