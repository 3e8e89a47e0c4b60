import hashlib
import itertools
import random

import pytest
from stratiform.llm import repair
from stratiform.llm.repair import ASSISTANT, EMPTY, NEVER, Settings

SCHEMA = "conv_id long, turn long, role string, text string, place string, put string, copies string, fault string"
CLASH = ("x",) * 4


def frame(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)


def fault_of(role, text, seen):
    body = text.strip(" \t\n\x0b\x0c\r")
    if not body:
        return "blank"
    if (role, text) in seen:
        return "duplicate"
    return "" if body[-1] in ".!?" else "truncated"


def brute(rows, most_inserted=2):
    """Every sequence of edits of the rows (turn, role, text), the cheapest and then ASCII-least that ends well."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        faults.append(fault_of(role, text, seen))
        seen.add((role, text))
    found = []

    def fits(roles):
        initials = "".join(r[:1] or "?" for r in roles)
        body = initials[1:] if initials[:1] == "s" else initials
        return not initials or (body != "" and body == "ua" * (len(body) // 2))

    def go(k, cost, audit, said):
        for names in itertools.chain.from_iterable(itertools.product(("user", "assistant"), repeat=n) for n in range(most_inserted + 1)):
            now = (cost + 5 * len(names), audit + "I" * len(names), said + [(n, "") for n in names])
            if k == len(rows):
                if fits([r for r, _ in now[2]]):
                    found.append(now)
                continue
            _, role, text = rows[k]
            go(k + 1, now[0] + 2, now[1] + "D", now[2])
            if faults[k] not in ("blank", "duplicate"):
                stays = 5 if faults[k] == "truncated" else 0
                go(k + 1, now[0] + stays, now[1] + "K", now[2] + [(role, text)])
                for name in ("user", "assistant"):
                    go(k + 1, now[0] + 1 + stays, now[1] + "R", now[2] + [(name, text)])

    go(0, 0, "", [])
    cost, audit, said = min(found, key=lambda f: (f[0], f[1]))
    turns = sorted({t for t, _, _ in rows if t is not None})
    initials = [r[:1] for _, r, _ in rows]
    return (
        turns[-1] - turns[0] + 1 - len(turns) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
        cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in said).encode()).hexdigest(),
    )


def digests(spark, rows, settings=Settings()):
    out = repair.digests(repair.edited(frame(spark, rows), settings)).collect()
    return {r["conv_id"]: tuple(r)[1:] for r in out}


def made(seed, conversations, most):
    random.seed(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(random.randint(1, most)):
            role = random.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = random.choice(["Yes.", "No", "ok!", "", " \t", None, f"word {turn}.", f"cut {turn}"])
            rows.append((conv, random.choice([turn, turn, None, turn // 2, turn * 3]), role, text))
    return rows


@pytest.mark.parametrize("run_rows", [1 << 16, 5])
def test_edits_against_all_sequences(spark, run_rows):
    rows = made(5, 40, 4)
    out = digests(spark, rows, Settings(run_rows=run_rows))
    for conv in {r[0] for r in rows}:
        assert out[conv] == brute([r[1:] for r in rows if r[0] == conv]), conv


def walk(steps, start, end):
    """Cheapest and then least edits by a table of whole strings: memory that Hirschberg's way does not need."""
    best = {start: (0, "")}
    for edits in steps:
        new = {}
        for (state, (cost, letters)), after in itertools.product(best.items(), range(4)):
            if edits[state][after] is not None:
                way = (cost + edits[state][after][0], letters + edits[state][after][1])
                new[after] = min(new.get(after, way), way)
        best = new
    return min((cost + end[s][0], letters + end[s][1]) for s, (cost, letters) in best.items())


@pytest.mark.parametrize("size", [1, 2, 3, 50, 400])
def test_crossings_give_the_least_audit(size):
    random.seed(size)
    kinds = [(random.choice("suuaax"), random.random() < 0.3) for _ in range(size)]
    settings = Settings()
    end = repair.last_edits(settings)
    steps = [repair.row_step(*kind, settings) for kind in kinds]
    edits = [repair.row_edits(*kind, settings) for kind in kinds]
    states = repair.crossings(steps, EMPTY, tuple(cost for cost, _ in end))
    audit = "".join(edits[k][states[k]][states[k + 1]][1] for k in range(size)) + end[states[-1]][1]
    assert audit == walk(edits, EMPTY, end)[1]


def test_tables_of_runs_give_what_rows_give():
    random.seed(1)
    settings = Settings()
    steps = [repair.row_step(random.choice("suax"), random.random() < 0.3, settings) for _ in range(300)]
    end = tuple(cost for cost, _ in repair.last_edits(settings))
    runs = [repair.product(steps[k : k + 37]) for k in range(0, 300, 37)]
    assert repair.crossings(runs, EMPTY, end) == repair.crossings(steps, EMPTY, end)[::37] + repair.crossings(steps, EMPTY, end)[-1:]
    assert repair.product(steps).cost[ASSISTANT][EMPTY] == NEVER


def test_long_conversation_in_many_runs(spark):
    random.seed(2)
    rows = [(1, k, random.choice(["user", "assistant", "system"]), random.choice(["a.", "b", f"{k}.", ""])) for k in range(3000)]
    whole, cut = (digests(spark, rows, Settings(run_rows=n)) for n in (1 << 16, 100))
    assert whole == cut
    places = repair.structured(frame(spark, rows).select("conv_id", "turn", "role", "text"), Settings(run_rows=100))
    assert places.selectExpr("place >> 33 AS part").distinct().count() > 5


def test_awkward_rows(spark):
    long = "word " * 200_000
    rows = [
        (None, 0, "user", "a."), (None, None, "assistant", None), (7, None, None, "x."), (8, 0, "user", long + "."),
        (8, 1, "assistant", long), (9, 0, "user", " "), (9, 1, "user", " "), (10, 5, "user", "a."), (10, 5, "user", "a."),
        (10, 2, "system", "s."), (10, -3, "assistant", "é!"),
    ]
    out = digests(spark, rows)
    for conv in (None, 7, 8, 9, 10):
        assert out[conv] == brute([r[1:] for r in rows if r[0] == conv]), conv
    assert digests(spark, []) == {}


def test_repaired_rows_are_well_formed(spark):
    rows = made(9, 30, 9)
    edits = repair.edited(frame(spark, rows))
    said = {}
    for r in repair.repaired(edits).orderBy("conv_id", "place", "number").collect():
        said.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in repair.digests(edits).collect():
        assert hashlib.sha256("\n".join(said.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]
        initials = "".join(x[0] for x in said.get(r["conv_id"], []))
        assert initials.removeprefix("s") in {"ua" * n for n in range(1, 20)} or initials == ""


def test_conversations_without_rows_give_zeros(spark):
    rows = frame(spark, [(k, t, "user", "Hi.") for k in (None, *range(60)) for t in (0,)])
    left = {r["conv_id"] for r in repair.damaged(rows).collect()}
    out = {r["conv_id"]: r for r in repair.with_all(rows, repair.digests(repair.edited(repair.damaged(rows)))).collect()}
    gone = set(out) - left
    assert len(out) == 61 and gone
    for conv in gone:
        assert tuple(out[conv])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
