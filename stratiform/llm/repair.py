"""Repair of conversation structure by Hirschberg's divide and conquer.

Rows of a conversation, in the order of their turns, are kept, given another role, deleted, or
get a row inserted before them, at the least cost that gives the roles (s?(ua)+)?. Before and
after every row such a sequence is in one of four states: nothing yet, after a system row, after
a user, after an assistant. A row, and likewise any run of rows, is a table of what it costs at
least to get from each state to each other, and of the order of the cheapest edits that do so.

To find the states at the borders, a vector of four costs goes forward from the beginning of a
run to its middle and another backward from its end; where their sum is least the cheapest edits
cross, and of several such states the one whose edits before it come first in ASCII order is
taken, which the forward vector ranks as it goes. Both halves are then solved alike, so memory
grows with the number of rows only by their kinds and states.

A state and the next letter determine the next state, and the edits of one row (insertions, then
one other letter) are never the beginning of another's. So of two sequences the first different
row decides, and ranks of whole runs can be combined as their costs are. Rows that have to be
deleted change neither states nor choices; insertions come after them, as D comes before I.

A conversation may hold any share of all rows: rows are dealt by ranges of their order, so a long
conversation is cut into runs by the borders of the partitions. Every run becomes one table of
costs, the tables of a conversation are solved as rows are, and then each run on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratiform.session import stage

SPACE = r"\x20\x09-\x0D"
STATES = range(4)
EMPTY, SYSTEM, USER, ASSISTANT = STATES
AFTER = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what may be put next
NAMES = {USER: "user", ASSISTANT: "assistant"}
# The state that a row leads to that is kept, by its initial and the state before.
KEPT = {("s", EMPTY): SYSTEM, ("u", EMPTY): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
LEGAL = ("su", "ua", "au")
NEVER = 1 << 60
ORDER = ["turn", "role", "text"]
PART = 33  # bits of a place below the number of its partition
_PUT = "array<struct<edit: string, role: string>>"


@dataclass(frozen=True)
class Settings:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5  # for a truncated row that stays
    run_rows: int = 1 << 16  # rows of a partition, about


class Step(NamedTuple):
    """What a row or a run of rows does: cost and order of the edits, by state before and state after.

    Orders are compared between edits from one state only.
    """

    cost: tuple[tuple[int, ...], ...]
    order: tuple[tuple[int, ...], ...]


class Vector(NamedTuple):
    """Costs of reaching each state, the least being 0, and the rank of the edits that do."""

    cost: tuple[int, ...]
    rank: tuple[int, ...]


@lru_cache(maxsize=4096)
def row_edits(initial: str, truncated: bool, settings: Settings) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """Cheapest cost and letters of a row that need not go, from each state to each other."""
    out: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in STATES]
    stays = settings.truncated if truncated else 0
    for before in STATES:
        at, letters, cost = before, "", 0
        for _ in range(3):  # no insertion, one, or two
            edits = [(at, "D", settings.delete), (AFTER[at], "R", settings.rerole + stays)]
            if (initial, at) in KEPT:
                edits.append((KEPT[initial, at], "K", stays))
            for after, letter, price in edits:
                found, best = (cost + price, letters + letter), out[before][after]
                out[before][after] = found if best is None else min(found, best)
            at, letters, cost = AFTER[at], letters + "I", cost + settings.insert
    return tuple(tuple(row) for row in out)


@lru_cache(maxsize=4096)
def row_step(initial: str, truncated: bool, settings: Settings) -> Step:
    cost, order = [], []
    for edits in row_edits(initial, truncated, settings):
        letters = sorted(e[1] for e in edits if e is not None)
        cost.append(tuple(NEVER if e is None else e[0] for e in edits))
        order.append(tuple(0 if e is None else letters.index(e[1]) for e in edits))
    return Step(tuple(cost), tuple(order))


def last_edits(settings: Settings) -> tuple[tuple[int, str], ...]:
    """Cost and letters of what has to be inserted at the end, by state."""
    return ((0, ""), (2 * settings.insert, "II"), (settings.insert, "I"), (0, ""))


def _ranked(found: Sequence[tuple[int, tuple[int, ...]]]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Costs, and places of the orders among each other."""
    orders = sorted({order for cost, order in found if cost < NEVER})
    return tuple(cost for cost, _ in found), tuple(orders.index(order) if cost < NEVER else 0 for cost, order in found)


@lru_cache(maxsize=1 << 16)
def forward(vector: Vector, step: Step) -> tuple[Vector, int]:
    """The vector after a step, and what was taken off its costs."""
    found = []
    for after in STATES:
        ways = [(vector.cost[s] + step.cost[s][after], (vector.rank[s], step.order[s][after])) for s in STATES]
        found.append(min(ways) if min(ways)[0] < NEVER else (NEVER, (0, 0)))
    cost, rank = _ranked(found)
    least = min(cost)
    return Vector(tuple(c - least if c < NEVER else NEVER for c in cost), rank), least


@lru_cache(maxsize=1 << 16)
def backward(cost: tuple[int, ...], step: Step) -> tuple[int, ...]:
    """Least costs from the states before a step on, up to a number that is the same for all."""
    found = [min(step.cost[s][t] + cost[t] for t in STATES) for s in STATES]
    least = min(found)
    return tuple(min(c - least, NEVER) for c in found)


def _only(state: int) -> tuple[int, ...]:
    return tuple(0 if s == state else NEVER for s in STATES)


def product(steps: Sequence[Step]) -> Step:
    """All steps as one."""
    cost, order = [], []
    for start in STATES:
        vector, total = Vector(_only(start), (0,) * 4), 0
        for step in steps:
            vector, more = forward(vector, step)
            total += more
        cost.append(tuple(c + total if c < NEVER else NEVER for c in vector.cost))
        order.append(vector.rank)
    return Step(tuple(cost), tuple(order))


def crossings(steps: Sequence[Step], start: int, end: tuple[int, ...]) -> list[int]:
    """States before the first step and after each, for the cheapest edits from ``start``, ASCII-least among equals.

    ``end`` is the cost of what follows, by the last state.
    """
    states = [start] * (len(steps) + 1)
    work = [(0, len(steps), end)]
    while work:  # halves are solved left to right, so the state at the beginning of each is known
        low, high, after = work.pop()
        if low == high:
            continue
        middle = high if high - low == 1 else (low + high) // 2
        vector = Vector(_only(states[low]), (0,) * 4)
        for step in steps[low:middle]:
            vector, _ = forward(vector, step)
        cost = after
        for k in range(high - 1, middle - 1, -1):
            cost = backward(cost, steps[k])
        states[middle] = min((vector.cost[s] + cost[s], vector.rank[s], s) for s in STATES)[2]
        if high - low > 1:
            work.append((middle, high, after))
            work.append((low, middle, _only(states[middle])))
    return states


def structured(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Distinct rows of every conversation in the order of turns, as a written table.

    conv_id, turn, role, text, copies, fault (blank, duplicate, truncated or empty), place. Copies
    of a row with the same turn lie together, so they are one row here; those after the first are
    duplicates. ``place`` numbers the rows; its upper bits are the partition.
    """
    text = F.col("text")
    blank = ~text.rlike(f"[^{SPACE}]")
    truncated = ~text.rlike(f"[.!?][{SPACE}]*\\z")
    # The same role and text in one conversation, told by 128 bits.
    same = [F.xxhash64("conv_id", "role", "text").alias("_a"), F.xxhash64(F.lit(1), F.col("conv_id").isNull(), "text", "role").alias("_b")]
    distinct = stage(rows.groupBy("conv_id", *ORDER).agg(F.count("*").alias("copies")).select("*", *same), "distinct-rows")
    # First turns by partial minima, and only of what stands in several turns: copies never meet in one task.
    first = distinct.groupBy("_a", "_b").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"), F.count("*").alias("turns")
    )
    first = first.where("turns > 1").select("_a", "_b", F.col("first.turn").alias("_first"), F.lit(True).alias("_several"))
    again = F.coalesce("_several", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("_first"))
    fault = F.when(blank, "blank").when(again, "duplicate").when(truncated, "truncated").otherwise("")
    judged = distinct.join(first, ["_a", "_b"], "left").select("conv_id", *ORDER, "copies", fault.alias("fault"))
    parts = max(1, -(-distinct.count() // settings.run_rows))
    # Rows that agree in 64 characters of text lie in one partition and are sorted there by the whole of it.
    dealt = judged.repartitionByRange(parts, "conv_id", "turn", "role", F.substring("text", 1, 64))
    return stage(dealt.sortWithinPartitions("conv_id", *ORDER).withColumn("place", F.monotonically_increasing_id()), "rows")


def _sorted(df: DataFrame, keys: Sequence[str], *then: str) -> DataFrame:
    """Rows of equal keys in one task, one after another; the number keeps small rows in as many tasks."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys).sortWithinPartitions(*keys, *then)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _by_group(function: Callable, keys: int, schema: pa.Schema, rows: int = 4096):
    """A function for mapInArrow that gives every group of successive rows to ``function`` as an iterator."""

    def run(batches):
        out = []
        for key, group in groupby(_rows(batches), key=lambda row: row[:keys]):
            out += function(key, group)
            if len(out) >= rows:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in out], schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in out], schema)

    return run


def _put(letters: str, before: int) -> list[dict[str, str | None]]:
    """Each letter with the role that it gives a row; a row that is kept has its own."""
    out, at = [], before
    for letter in letters:
        if letter in "IR":
            at = AFTER[at]
        out.append({"edit": letter, "role": NAMES[at] if letter in "IR" else None})
    return out


_ID = pa.field("conv_id", pa.int64())
_PUT_TYPE = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string())]))


def edited(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The cheapest edits of every conversation: conv_id, place, turn, role, text, copies, fault, put, gone.

    ``rows`` has conv_id and turn (integers), role and text; other columns are ignored. ``put`` lists
    the rows inserted before the row and what becomes of it (K, R, D, with the role given); ``gone``
    is how many copies are deleted after that, all of them for a blank or repeated row, whose
    ``put`` is empty. Rows inserted at the end come as a row of their own without fault and copies.

    Null roles and texts are a single space, which is no known role and a blank text. Rows without
    conv_id are one conversation; rows without turn come first. Rows of one turn are ordered by
    role and text. Texts are taken whole. An empty table gives no rows.
    """
    plain = rows.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    ordered = structured(plain, settings)
    part = F.shiftright("place", PART).alias("part")
    open_rows = ordered.where("fault NOT IN ('blank', 'duplicate')").select(
        "conv_id", part, "place", F.substring("role", 1, 1).alias("initial"), (F.col("fault") == "truncated").alias("truncated")
    )

    def table(key, group):
        whole = product([row_step(initial, truncated, settings) for *_, initial, truncated in group])
        return [(*key, [c for row in whole.cost for c in row], [r for row in whole.order for r in row])]

    run_schema = pa.schema([_ID, ("part", pa.int64()), ("cost", pa.list_(pa.int64())), ("order", pa.list_(pa.int32()))])
    runs = _sorted(open_rows, ["conv_id", "part"], "place").mapInArrow(
        _by_group(table, 2, run_schema), "conv_id long, part long, cost array<long>, order array<int>"
    )
    end = last_edits(settings)

    def borders(key, group):
        runs = list(group)  # one per partition that the conversation lies in
        steps = [Step(*(tuple(tuple(flat[k : k + 4]) for k in range(0, 16, 4)) for flat in run[2:])) for run in runs]
        states = crossings(steps, EMPTY, tuple(cost for cost, _ in end))
        tails = [""] * (len(runs) - 1) + [end[states[-1]][1]]
        return [(*run[:2], before, after, tail) for run, before, after, tail in zip(runs, states, states[1:], tails, strict=False)]

    border_schema = pa.schema([_ID, ("part", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("tail", pa.string())])
    solved = stage(
        _sorted(runs, ["conv_id"], "part").mapInArrow(
            _by_group(borders, 1, border_schema), "conv_id long, part long, before int, after int, tail string"
        ),
        "run-borders",
    )

    def edits(key, group):
        run = list(group)
        steps = [row_step(initial, truncated, settings) for _, _, _, initial, truncated, *_ in run]
        states = crossings(steps, run[0][5], _only(run[0][6]))
        out = []
        for (_, _, place, initial, truncated, *_), before, after in zip(run, states, states[1:], strict=False):
            out.append((place, _put(row_edits(initial, truncated, settings)[before][after][1], before)))
        return out

    edit_schema = pa.schema([("place", pa.int64()), ("put", _PUT_TYPE)])
    on = open_rows["conv_id"].eqNullSafe(solved["conv_id"]) & (open_rows["part"] == solved["part"])
    with_borders = open_rows.join(solved, on).select(open_rows["*"], "before", "after")
    found = _sorted(with_borders, ["conv_id", "part"], "place").mapInArrow(
        _by_group(edits, 2, edit_schema), f"place long, put {_PUT}"
    )
    none = F.array().cast(_PUT)
    forced = F.col("fault").isin("blank", "duplicate")
    gone = F.when(forced, F.col("copies")).otherwise(F.col("copies") - 1).alias("gone")
    whole = ordered.join(found, "place", "left").select(
        "conv_id", "place", *ORDER, "copies", "fault", F.coalesce("put", none).alias("put"), gone
    )
    return whole.unionByName(_tails(solved, whole))


def _tails(solved: DataFrame, whole: DataFrame) -> DataFrame:
    """What is inserted at the ends, after all rows of the partition."""

    def role(state: Column) -> Column:
        return F.when(state == USER, "assistant").otherwise("user")

    letters = F.sequence(F.lit(1), F.length("tail"))
    put = F.transform(
        letters, lambda k: F.struct(F.lit("I").alias("edit"), role(F.when(k == 1, F.col("after")).otherwise(F.lit(USER))).alias("role"))
    )
    place = F.shiftleft(F.col("part") + 1, PART) - 1
    known = {"conv_id": F.col("conv_id"), "place": place, "put": put.cast(_PUT), "gone": F.lit(0)}
    kinds = {f.name: f.dataType for f in whole.schema.fields}
    return solved.where("tail <> ''").select(*(known.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in whole.columns))


def repaired(edits: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, place, number, role, text, edit."""
    put = edits.select("conv_id", "place", F.posexplode("put").alias("number", "_put"), F.col("role").alias("_role"), F.col("text").alias("_text"))
    text = F.when(F.col("_put.edit") == "I", "").otherwise(F.col("_text")).alias("text")
    stays = put.where("_put.edit <> 'D'")
    return stays.select("conv_id", "place", "number", F.coalesce("_put.role", "_role").alias("role"), text, F.col("_put.edit").alias("edit"))


def digests(edits: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row per conversation of ``edited``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A hash of the repaired text is made of its pieces one after another, so the rows of a
    conversation pass through one task; they are streamed in sorted order, and only the audit is held.
    """

    def digest(key, group):
        gaps = blank = duplicate = truncated = illegal = cost = 0
        last_turn, last_role, audit, sha, begun = None, None, [], hashlib.sha256(), False
        for _, _, turn, role, text, copies, fault, put, gone in group:
            if copies is not None:
                if turn is not None:
                    gaps += 0 if last_turn is None or turn == last_turn else turn - last_turn - 1
                    last_turn = turn
                if fault == "blank":
                    blank += copies
                else:
                    duplicate += gone
                    truncated += fault == "truncated"
                illegal += copies - 1 + (last_role is not None and last_role[:1] + role[:1] not in LEGAL)
                last_role = role
            for one in put:
                letter = one["edit"]
                cost += {"K": 0, "R": settings.rerole, "D": settings.delete, "I": settings.insert}[letter]
                audit.append(letter)
                if letter != "D":
                    cost += settings.truncated if letter != "I" and fault == "truncated" else 0
                    said = "" if letter == "I" else text
                    sha.update((("\n" if begun else "") + f"{one['role'] or role}:{said}").encode())
                    begun = True
            cost += settings.delete * gone
            audit.append("D" * gone)
        return [(*key, gaps, blank, duplicate, truncated, illegal, cost, "".join(audit), sha.hexdigest())]

    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = pa.schema([_ID, *((c, pa.int64()) for c in counts), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    columns = edits.select("conv_id", "place", *ORDER, "copies", "fault", "put", "gone")
    return _sorted(columns, ["conv_id"], "place").mapInArrow(
        _by_group(digest, 1, schema), f"conv_id long, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string"
    )


def with_all(ids: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with a row of zeros, an empty audit and the hash of nothing for each other conv_id of ``ids``."""
    every = ids.select(F.col("conv_id").alias("_id")).distinct()
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    filled = [F.coalesce(c, F.lit(empty.get(c, 0))).alias(c) for c in found.columns if c != "conv_id"]
    return every.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(F.col("_id").alias("conv_id"), *filled)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults to repair, chosen by crc32 of ``conv_id:turn`` modulo 20; nulls are one space.

    0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's.
    """
    plain = rows.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    drawn = plain.withColumn("_fault", F.crc32(key.cast("binary")) % 20).where("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(True), F.when(F.col("_fault") == 3, 2).otherwise(1))).alias("_time")
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    return drawn.select("conv_id", "turn", role.alias("role"), text.alias("text"), times).drop("_time")
