import pytest
from helpers import LONG, SF_DIR, WORD, awkward, frame
from pyspark.sql import functions as F
from stratiform.llm import linerules

OTHER = "Whoever came that way took the long road over the hills, as their parents had done."
PROSE = "The river ran past the old mill, and nobody had crossed it for a year."


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed by plain rules."""
    text = text or ""
    words = WORD.findall(text)
    places = {}
    for k in range(len(words) - 7):
        places.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {k + j for starts in places.values() if len(starts) > 1 for k in starts for j in range(8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        len(words) < 20 or 100 * len(covered) > 30 * len(words),
    )


def cleaned(spark, *texts):
    rows = linerules.clean(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    return {r["doc_id"]: r for r in rows.collect()}


def test_counts_against_plain_rules(spark):
    texts = [
        PROSE, f"{PROSE} " * 6, "a " * 9, "a " * 8, "x y z " * 40, f"{PROSE}\n{PROSE}\n\n{PROSE} \n{PROSE}", "# ** $5 | <b>",
        "  one two \x1c three", "é " * 30, " ".join(f"w{k}" for k in range(500)) + " " + " ".join(f"w{k}" for k in range(20, 31)),
    ]
    out = cleaned(spark, *texts)
    for k, text in enumerate(texts):
        assert tuple(out[k][c] for c in linerules.COLUMNS[:6]) == counts(text), text[:40]


def test_counts_of_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for r in linerules.clean(docs).collect():
        assert tuple(r[c] for c in linerules.COLUMNS[:6]) == counts(r["text"])


@pytest.mark.parametrize(
    "line",
    [
        "Home | About | Contact | Login.", "next > previous > top.", "Read more", "log in, sign up", "© 2020 Somebody.",
        "All Rights Reserved.", "We use cookies to improve your visit.", "Buy!!! now!!! cheap!!!", "a heading without an end",
        "Licensed under the Example License, Version 9.",
    ],
)
def test_lines_that_go(spark, line):
    out = cleaned(spark, "\n".join([PROSE, line, PROSE.upper(), "", OTHER]))[0]
    assert out["cleaned"] == "\n".join([PROSE, PROSE.upper(), "", OTHER])
    assert out["n_failed_lines"] == 1 and out["kept"]


@pytest.mark.parametrize("line", [PROSE, "Really?", "- an entry;", "She said: “Yes.”", "他走了。", "The menu was short.", "1. One (of two)"])
def test_lines_that_stay(spark, line):
    assert cleaned(spark, line)[0]["cleaned"] == line


def test_documents_that_lose_too_much_go(spark):
    links = "\n".join(f"Page {k} | Page {k + 1} | Page {k + 2}" for k in range(30))
    out = cleaned(spark, f"{PROSE}\n{links}", f"{PROSE}\n" * 1 + PROSE.upper() + "\nHome | Help | More")
    assert not out[0]["kept"] and not out[0]["base_failed"] and out[0]["cleaned"] == PROSE
    assert out[1]["kept"]


def test_awkward_rows(spark):
    out = linerules.clean(frame(spark)).collect()
    assert len(out) == len(awkward())
    for r in out:
        assert r["score"] == "x" and tuple(r[c] for c in linerules.COLUMNS[:6]) == counts(r["text"])
        assert r["cleaned"] is not None and r["kept"] is not None
    assert LONG in {r["text"] for r in out}
    assert linerules.clean(frame(spark, [])).collect() == []
    clash = spark.createDataFrame([(None, PROSE, "x", 3)], "doc_id long, text string, kept string, n_words int")
    assert linerules.clean(clash).first()["n_words"] == len(WORD.findall(PROSE))


def test_runs_without_python(spark):
    plan = linerules.clean(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Exchange"))


def test_labelled_documents(spark):
    """Documents labelled as good stay unless the base rules drop them; hardly any of the others does."""
    folder = SF_DIR.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    rows = linerules.clean(spark.read.parquet(f"{folder}/documents.parquet")).join(labels, "doc_id").where("NOT base_failed")
    shares = dict(rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect())
    assert shares[1] > 0.98 and shares[0] < 0.1
