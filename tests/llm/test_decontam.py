import random

import numpy as np
import pytest
from helpers import SF_DIR, awkward, doc, frame

from stratiform.llm import decontam

ITEM_SCHEMA = "item_id long, text string, score string, best string"


def item_frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x") for i, t in rows], ITEM_SCHEMA)


def found(df):
    return {(r["doc_id"], r["item_id"]) for r in df.collect()}


def test_whole_items_in_the_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = {(i, r["item_id"]) for r in items.collect() for i, text in rows if r["text"] in text}
    assert want and found(decontam.contaminated(docs, items)) == want


def planted(seed):
    draw = random.Random(seed)
    common = [f"c{k}" for k in range(60)]

    def text(n):
        return [draw.choice(common) if draw.random() < 0.6 else f"r{draw.randrange(100_000)}" for _ in range(n)]

    items = [(k, " ".join(text(draw.choice([9, 14, 33, 64, 200]))) + ". " + " ".join(text(4)) + ".") for k in range(40)]
    docs, want = [], set()
    for k in range(120):
        words = text(draw.choice([0, 5, 80, 400, 3000]))
        if k % 3 == 0:
            item = draw.randrange(40)
            copy = items[item][1].split()
            if k % 2:
                copy = [w.upper().strip(".") for w in copy]
            if k % 4 == 0 and len(copy) > 30:
                copy[len(copy) // 2] = "changed"
            at = draw.randrange(len(words) + 1)
            words[at:at] = copy
            want.add((k, item))
        docs.append((k, " ".join(words)))
    return items, docs, want


@pytest.mark.parametrize("settings", [decontam.Settings(), decontam.Settings(shard_items=7, block=2)])
def test_planted_items(spark, settings):
    items, docs, want = planted(5)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), item_frame(spark, items)
    out = decontam.contaminated(*frames, settings)
    assert found(out) == want
    assert all(r["score"] >= settings.threshold and r["question_overlap"] >= settings.question for r in out.collect())


def test_search_finds_all_above_the_threshold():
    draw = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in np.minimum(draw.geometric(0.04, 30), 80)) for _ in range(150)]
    items = [decontam.make_item(k, text, text, text) for k, text in enumerate(texts)]
    index = decontam.Index(items, 64, decontam.Settings(block=4))
    for _ in range(100):
        terms = sorted(draw.choice(len(index.terms), 12, replace=False).tolist())
        for threshold in (0.05, 0.2, 0.4):
            scores = {}
            for term in terms:
                for item, weight in zip(*index.postings[term], strict=True):
                    scores[item] = scores.get(item, 0.0) + weight
            want = {k: s for k, s in scores.items() if s >= threshold}
            assert dict(index.search(terms, threshold)) == pytest.approx(want)


def test_an_item_scores_one_for_its_own_text():
    items = [decontam.make_item(k, t, t, t) for k, t in enumerate(["a b c d e f g h i", "a b c x y z u v w w"])]
    index = decontam.Index(items, 16, decontam.Settings())
    for k, item in enumerate(items):
        terms = np.searchsorted(index.terms, np.unique(item.words)).tolist()
        assert dict(index.search(terms, 0.9))[k] == pytest.approx(1.0)


def test_awkward_tables(spark):
    text = "the quick brown fox jumps over the lazy dog near the river bank"
    items = item_frame(spark, [(1, text), (2, None), (3, ""), (4, "one two"), (1, text), (5, text.upper() + "."), (None, text)])
    out = decontam.contaminated(frame(spark), items)
    assert found(out) == {(i, k) for i in (1, 7) for k in (1, 5, None)} | {(8, 4)}
    assert out.count() == 7
    assert decontam.contaminated(frame(spark, []), items).count() == 0
    assert decontam.contaminated(frame(spark), item_frame(spark, [])).count() == 0
    rows = [doc(1, text), doc(1, text), doc(None, text)]
    assert found(decontam.contaminated(frame(spark, rows), items.where("item_id = 1"))) == {(1, 1), (None, 1)}
    assert len(awkward()) == frame(spark).count()


def test_question_and_answer_columns(spark):
    items = spark.createDataFrame(
        [(1, "what is the name of the first ship in the harbour", "Aurora of the north")], "item_id long, question string, answer string"
    )
    docs = spark.createDataFrame(
        [
            (1, "asked what is the name of the first ship in the harbour the answer is aurora of the North said he"),
            (2, "asked what is the name of the first ship in the harbour nobody knew or cared or had seen it at all"),
            (3, None),
        ],
        "doc_id long, text string",
    )
    assert found(decontam.contaminated(docs, items)) == {(1, 1)}


def test_clean_documents_are_left_alone(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = item_frame(spark, [(k, " ".join(f"x{k}y{j}" for j in range(20))) for k in range(30)])
    assert decontam.contaminated(docs, items).count() == 0


def test_short_items_are_found_as_one_run_of_words(spark):
    items = item_frame(spark, [(1, "Who wrote Faust? Goethe."), (2, "Capital of Peru? Lima."), (3, "Peru"), (4, "?!")])
    docs = [
        (1, "quiz: who wrote FAUST -- goethe, of course"),
        (2, "who wrote faust if not goethe"),
        (3, "wrote Faust Goethe who"),
        (4, "the capital of peru lima"),
        (5, "!?"),
        (None, "Capital of Peru? Lima."),
    ]
    out = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert found(out) == {(1, 1), (4, 2), (4, 3), (None, 2), (None, 3)}
    assert out.count() == 5 and all(r["score"] == 1.0 for r in out.collect())


def test_short_questions_and_answers_in_columns(spark):
    items = spark.createDataFrame(
        [(1, "Faust by?", "Goethe", "Q: Faust by? A: Goethe"), (2, None, "forty two", "forty two")],
        "item_id long, question string, answer string, text string",
    )
    docs = spark.createDataFrame(
        [(1, "faust by Goethe"), (2, "Q Faust by A Goethe"), (3, "Goethe faust by"), (4, "forty-two")], "doc_id long, text string"
    )
    assert found(decontam.contaminated(docs, items)) == {(1, 1), (2, 1), (4, 2)}


def test_items_in_scripts_without_spaces(spark):
    long = "世界上最高的山峰叫什么名字？它叫珠穆朗玛峰。"
    items = item_frame(spark, [(1, long), (2, "红色？苹果。"), (3, "ภูเขาที่สูงที่สุดในโลกคืออะไร เอเวอเรสต์")])
    docs = [
        (1, "今天我们问：世界上最高的山峰叫什么名字，它叫珠穆朗玛峰。谢谢大家"),
        (2, "他说红色苹果很好吃"),
        (3, "世界上最低的湖叫什么？红色。"),
        (4, "ถามว่าภูเขาที่สูงที่สุดในโลกคืออะไรเอเวอเรสต์ครับ"),
    ]
    out = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert found(out) == {(1, 1), (2, 2), (4, 3)}


@pytest.mark.parametrize("gap", [0, 25, 60])
def test_stretched_items_are_found_wherever_they_begin(spark, gap):
    draw = random.Random(3)
    question = " ".join(f"q{draw.randrange(10**6)}" for _ in range(27)) + "?"
    answer = " ".join(f"a{draw.randrange(10**6)}" for _ in range(5)) + "."
    between = " ".join(f"g{draw.randrange(10**6)}" for _ in range(gap))
    docs = [(k, " ".join([*(f"x{k}y{j}" for j in range(200 + k)), question, between, answer, *(f"z{k}y{j}" for j in range(300))])) for k in range(40)]
    docs += [(100 + k, text.replace(answer, "")) for k, text in docs[:5]] + [(200, f"{answer} {between}")]
    items = item_frame(spark, [(1, f"{question} {answer}"), *((k, f"other{k} " * 9) for k in range(2, 9))])
    out = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert found(out) == {(k, 1) for k in range(40)}


def test_long_answers_to_short_questions_are_found_apart(spark):
    answer = " ".join(f"a{k}" for k in range(40))
    items = spark.createDataFrame([("x", "What comes then?", answer, None)], "item_id string, question string, answer string, text string")
    filler = " ".join(f"f{k}" for k in range(50))
    docs = [(1, f"{filler} what comes then {filler} {answer}"), (2, f"{filler} {answer}"), (3, f"what comes then {filler}")]
    out = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert found(out) == {(1, "x")}
