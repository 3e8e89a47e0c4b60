"""As-of joins and validity ranges against plain rules, with any width of bins."""

import datetime as dt
import random

import pytest

from stratiform.operators.ordered import as_of, valid_at, validity

T0 = dt.datetime(2024, 1, 1)
WIDTHS = [dt.timedelta(minutes=7), dt.timedelta(days=1), dt.timedelta(days=400)]


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


def made(seed, count, keys=("a", "b", None)):
    draw = random.Random(seed)
    return [(draw.choice(keys), at(draw.choice([None, *range(0, 3000, 11)])), k) for k in range(count)]


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("within", [None, dt.timedelta(hours=2)])
def test_as_of(spark, width, within):
    left, right = made(1, 120), made(2, 25, ("a", "b", "c", None))
    out = as_of(
        spark.createDataFrame(left, "key string, t timestamp, n int"), spark.createDataFrame(right, "key string, seen timestamp, m int"),
        ["key"], "t", "seen", within, width,
    )
    want = []
    for key, t, n in left:
        before = [(s, m) for k, s, m in right if k is not None and k == key and s is not None and t is not None and s <= t]
        best = max(before, default=(None, None))
        if best[0] is not None and within is not None and t - best[0] > within:
            best = (None, None)
        want.append((key, t, n, *best))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def versions_of(rows):
    """(key, a, b, from, to) by walking each key's deliveries."""
    out = []
    for key in {r[0] for r in rows}:
        by_time = {}
        for k, t, a, b in rows:
            if k == key and t is not None:
                by_time[t] = max(by_time.get(t, (a, b)), (a, b), key=lambda x: tuple((v is not None, v or 0) for v in x))
        own = []
        for t in sorted(by_time):
            if not own or own[-1][1:3] != by_time[t]:
                own.append((key, *by_time[t], t))
        out += [(*v, own[k + 1][3] if k + 1 < len(own) else None) for k, v in enumerate(own)]
    return out


def deliveries(seed, count=150):
    draw = random.Random(seed)
    return [(draw.choice(["a", "a", "a", "b", None]), at(draw.choice([None, *range(0, 4000, 37)])), draw.choice([1, 2, None]), draw.choice([1, None])) for _ in range(count)]


@pytest.mark.parametrize("width", WIDTHS)
def test_validity(spark, width):
    rows = deliveries(3)
    out = validity(spark.createDataFrame(rows, "key string, t timestamp, a int, b int"), ["key"], ["a", "b"], "t", width)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(versions_of(rows), key=str)


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_valid_at(spark, width, limit):
    rows, left = deliveries(4, 60), made(5, 150)
    versions = validity(spark.createDataFrame(rows, "key string, t timestamp, a int, b int"), ["key"], ["a", "b"], "t", width)
    out = valid_at(spark.createDataFrame(left, "key string, t timestamp, n int"), versions, ["key"], "t", width, limit)
    want = []
    for key, t, n in left:
        held = [v[1:] for v in versions_of(rows) if key is not None and v[0] == key and t is not None and v[3] <= t and (v[4] is None or t < v[4])]
        want.append((key, t, n, *(held[0] if held else (None,) * 4)))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "key string, t timestamp, n int")
    right = spark.createDataFrame([], "key string, seen timestamp, m int")
    some = spark.createDataFrame([("a", T0, 1)], none.schema)
    assert as_of(none, right, ["key"], "t", "seen").count() == 0
    assert [tuple(r) for r in as_of(some, right, ["key"], "t", "seen").collect()] == [("a", T0, 1, None, None)]
    versions = validity(right, ["key"], ["m"], "seen")
    assert versions.count() == 0 and valid_at(none, versions, ["key"], "t").count() == 0
    assert [tuple(r) for r in valid_at(some, versions, ["key"], "t").collect()] == [("a", T0, 1, None, None, None)]
