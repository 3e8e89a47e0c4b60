"""Rows in order of time per key: last values, validity ranges, and joins to what held at a time.

A key may hold any share of the rows, so no window runs over a whole key. Time is cut into bins;
windows run within a key and bin, and what has to be known from other bins, one row per bin, is
carried over their borders.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiform.session import BROADCAST_LIMIT_BYTES, broadcast_within

WEEK = dt.timedelta(days=7)


def _bin(time: Column, width: dt.timedelta) -> Column:
    return F.floor(F.unix_micros(time.cast("timestamp")) / F.lit(int(width.total_seconds() * 1_000_000)))


def _present(*columns: str) -> Column:
    return reduce(and_, (F.col(c).isNotNull() for c in columns))


def _carried(marks: DataFrame, keys: Sequence[str], value: str, forward: bool = True) -> DataFrame:
    """keys, _bin, _carried: the value of the nearest other bin before, or after, that has one.

    ``marks`` has a row per key and bin, so its windows are as long as a key has bins.
    """
    order = F.col("_bin").asc() if forward else F.col("_bin").desc()
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return marks.select(*keys, "_bin", F.last(value, ignorenulls=True).over(window).alias("_carried"))


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time: str,
    right_time: str,
    within: dt.timedelta | None = None,
    width: dt.timedelta = WEEK,
) -> DataFrame:
    """Every row of ``left`` with the latest row of ``right`` of its key at or before its time.

    The columns of ``right`` but for the keys are added, and null where there is no such row, or none
    ``within`` a time; so are those of rows without a key part or a time. Of several rows of ``right``
    with one key and time the greatest counts, its columns compared in their order. No name but the
    keys' may stand on both sides.

    Both sides meet in one exchange by key and bin of time and are merged in order there.
    """
    added = [c for c in right.columns if c not in keys]
    known = right.where(_present(*keys, right_time)).groupBy(*keys, F.col(right_time).cast("timestamp").alias("_time"))
    known = known.agg(F.max(F.struct(*added)).alias("_right"))
    can = left.where(_present(*keys, time)).withColumn("_time", F.col(time).cast("timestamp"))
    both = can.withColumn("_left", F.lit(True)).unionByName(known.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    both = both.withColumn("_bin", _bin(F.col("_time"), width))

    order = Window.partitionBy(*keys, "_bin").orderBy("_time", "_left").rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("_here", F.last("_right", ignorenulls=True).over(order)).where("_left")
    # Bins of ``left`` come along, so that each finds what the nearest one before it ended with.
    ends = both.groupBy(*keys, "_bin").agg(F.max(F.when(~F.col("_left"), F.struct("_time", "_right"))).alias("_end"))
    carried = _carried(ends, keys, "_end")
    joined = here.join(carried, [*keys, "_bin"], "left")
    match = F.coalesce("_here", F.col("_carried._right"))
    if within is not None:
        gap = F.unix_micros("_time") - F.unix_micros(match[right_time].cast("timestamp"))
        match = F.when(gap <= int(within.total_seconds() * 1_000_000), match)
    found = joined.withColumn("_match", match).select(*left.columns, *(F.col("_match")[c].alias(c) for c in added))
    kinds = {f.name: f.dataType for f in right.schema.fields}
    none = left.where(~F.coalesce(_present(*keys, time), F.lit(False)))
    return found.unionByName(none.select(*left.columns, *(F.lit(None).cast(kinds[c]).alias(c) for c in added)))


def validity(
    deliveries: DataFrame, keys: Sequence[str], fields: Sequence[str], delivered: str, width: dt.timedelta = WEEK
) -> DataFrame:
    """The versions of every key: keys, fields, valid_from, valid_to (null for the one that holds).

    Deliveries in a row with equal fields are one version, nulls being equal; a value that comes back
    later is a version of its own. Of several rows of a key with one time the greatest counts. A null key
    is a key; rows without a time are left out.
    """
    rows = deliveries.where(F.col(delivered).isNotNull()).groupBy(*keys, F.col(delivered).alias("_time"))
    rows = rows.agg(F.max(F.struct(*fields)).alias("_row")).withColumn("_bin", _bin(F.col("_time"), width))
    # A null key would not be found again by an equality join, so keys travel as one value that is never null.
    rows = rows.withColumn("_key", F.struct(*keys))

    def neighbour(df: DataFrame, value: Column, forward: bool) -> DataFrame:
        """``df`` with ``_near``: the value of the row before, or after, in or beyond the bin."""
        order = F.col("_time").asc() if forward else F.col("_time").desc()
        here = F.lag(value).over(Window.partitionBy("_key", "_bin").orderBy(order))
        held = F.struct("_time", value.alias("value"))
        ends = df.groupBy("_key", "_bin").agg((F.max(held) if forward else F.min(held)).alias("_end"))
        joined = df.withColumn("_here", here).join(_carried(ends, ["_key"], "_end", forward), ["_key", "_bin"], "left")
        return joined.withColumn("_near", F.coalesce("_here", F.col("_carried.value"))).drop("_here", "_carried")

    before = neighbour(rows, F.col("_row"), forward=True)
    changes = before.where(F.col("_near").isNull() | ~F.col("_near").eqNullSafe(F.col("_row"))).drop("_near")
    after = neighbour(changes, F.col("_time"), forward=False)
    return after.select(*keys, *(F.col("_row")[f].alias(f) for f in fields), F.col("_time").alias("valid_from"), F.col("_near").alias("valid_to"))


def valid_at(
    left: DataFrame,
    versions: DataFrame,
    keys: Sequence[str],
    time: str,
    width: dt.timedelta = WEEK,
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Every row of ``left`` with the version (of ``validity``) of its key that held at its time, or nulls.

    A range join on bins: a version stands in every bin that its range meets, a row of ``left`` in
    one, so they join on equal key and bin, and a key with most of the rows is spread over its bins.
    Versions are unfolded between the first and the last bin of ``left`` only.
    """
    timed = left.withColumn("_bin", _bin(F.col(time), width))
    low, high = timed.agg(F.min("_bin"), F.max("_bin")).first()
    added = [c for c in versions.columns if c not in keys]
    named = versions.select(*(F.col(c).alias(f"_of_{c}") for c in versions.columns))
    if low is None:
        low, high = 0, -1
    first = F.greatest(_bin(F.col("_of_valid_from"), width), F.lit(low))
    last = F.least(F.coalesce(_bin(F.col("_of_valid_to"), width), F.lit(high)), F.lit(high))
    unfolded = named.where(first <= last).withColumn("_of_bin", F.explode(F.sequence(first, last)))
    same = [F.col(k) == F.col(f"_of_{k}") for k in keys]
    holds = (F.col(time) >= F.col("_of_valid_from")) & (F.col("_of_valid_to").isNull() | (F.col(time) < F.col("_of_valid_to")))
    on = reduce(and_, [*same, F.col("_bin") == F.col("_of_bin"), holds])
    joined = timed.join(broadcast_within(unfolded, broadcast_limit), on, "left")
    return joined.select(*left.columns, *(F.col(f"_of_{c}").alias(c) for c in added))
