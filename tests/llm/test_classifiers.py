import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF_DIR, awkward, doc, frame

from pyspark.sql import functions as F
from stratiform.llm import arrays, langid, quality, queries, toxicity
from stratiform.llm.sampling import held_out, labelled_sample

BIG = "/root/testdata/sf0.1"


def auc(rows, column):
    scores = np.array([r["score"] for r in rows])
    label = np.array([r[column] for r in rows])
    rank = np.empty(len(rows))
    rank[np.argsort(scores)] = np.arange(1, len(rows) + 1)
    positive = label.sum()
    return (rank[label == 1].sum() - positive * (positive + 1) / 2) / (positive * (len(rows) - positive))


@pytest.mark.parametrize(
    ("name", "column", "folds", "fold", "least"),
    [("op1_quality_classifier", "quality", 5, 0, 0.99), ("op3_toxicity", "toxic", 4, 2, 0.97)],
)
def test_held_out_accuracy(spark, name, column, folds, fold, least):
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    rows = queries.QUERIES[name](spark, BIG).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % folds == fold for r in rows)
    assert auc(rows, column) > least
    kept = [r["predicted"] for r in rows if r[column] == 1]
    assert np.mean(kept) > 0.85
    wrong = [r["predicted"] for r in rows if r[column] == 0]
    assert np.mean(wrong) < 0.05
    assert all((r["score"] >= 0.3) == (r["predicted"] == 1) for r in rows)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang")
    rows = queries.op2_language_id(spark, BIG).join(docs, "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_averaged_vectors_give_the_gathered_score():
    random = np.random.default_rng(1)
    texts = ["good text of words " + "".join(random.choice(list("abcd "), 30)) for _ in range(40)]
    texts += ["!!! " * 10 + "".join(random.choice(list("ab!$ "), 30)) for _ in range(40)]
    labels = [1] * 40 + [0] * 40
    settings = quality.Settings(buckets=1 << 10)
    model = quality.train([(t.encode(), y) for t, y in zip(texts, labels, strict=True)], settings)
    scores = quality.score_texts(arrays.texts(pa.array(texts)), model)
    assert (scores[:40] > 0.5).all() and (scores[40:] < 0.5).all()
    one = [quality.score_texts(arrays.texts(pa.array([t])), model)[0] for t in texts]
    assert np.allclose(scores, one)


def documents(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def test_quality_query_against_averaged_vectors_and_softmax(spark):
    """What the query gives, from the vectors and the layer, text by text."""
    texts = documents(spark)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    taught = sorted(i for i in labels if labels[i] is not None and i in texts and zlib.crc32(str(i).encode()) % 5)
    trained = quality.learn([(texts[i].encode(), labels[i]) for i in taught], quality.Settings())
    for row in queries.op1_quality_classifier(spark, SF_DIR).collect():
        raw = np.frombuffer(texts[row["doc_id"]].encode(), dtype=np.uint8)
        bucket, _ = quality.features(arrays.Texts(raw, np.array([0, len(raw)])), trained.bits)
        mean = trained.vectors[bucket].astype(float).mean(axis=0) if len(bucket) else np.zeros(trained.vectors.shape[1])
        logits = trained.layer.astype(float) @ mean + trained.offset
        share = np.exp(logits - logits.max())
        assert row["score"] == pytest.approx(share[1] / share.sum(), abs=1e-4)


def test_language_query_against_plain_profiles(spark):
    """What the query gives, by counting in dictionaries and adding up how far each rank is out of place."""
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    settings = langid.Settings()

    def top(counts):
        return sorted(counts, key=lambda g: (-counts[g], g))[: settings.size]

    def grams(text):
        return langid.grams(langid.letters(text or ""), settings.longest).tolist()

    counts = {}
    for r in rows:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            own = counts.setdefault(r["lang"], {})
            for gram in grams(r["text"]):
                own[gram] = own.get(gram, 0) + 1
    profiles = {lang: {g: k for k, g in enumerate(top(own))} for lang, own in counts.items()}
    found = {r["doc_id"]: r for r in queries.op2_language_id(spark, SF_DIR).collect()}
    for r in rows:
        own = {}
        for gram in grams(r["text"]):
            own[gram] = own.get(gram, 0) + 1
        if not own:
            assert (found[r["doc_id"]]["lang_pred"], found[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        order = top(own)
        far = {
            lang: sum(abs(ranks[g] - k) if g in ranks else settings.size for k, g in enumerate(order)) for lang, ranks in profiles.items()
        }
        best = min(sorted(far), key=far.get)
        assert found[r["doc_id"]]["lang_pred"] == best
        assert found[r["doc_id"]]["score"] == pytest.approx(1 - far[best] / (settings.size * len(order)))


def test_toxicity_query_against_all_pairs(spark):
    """What the query gives, as a sum over single terms and over all pairs of the fitted model."""
    folder = SF_DIR.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels, ~held_out("doc_id", 4, 2))
    assert len(model.terms) > 20
    place = {int(term): k for k, term in enumerate(model.terms)}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for row in queries.op3_toxicity(spark, folder).limit(300).collect():
        raw = np.frombuffer(texts[row["doc_id"]].encode(), dtype=np.uint8)
        hashes, _ = toxicity.text_terms(arrays.Texts(raw, np.array([0, len(raw)])))
        own = sorted({place[h] for h in hashes.tolist() if h in place})
        value = model.bias + sum(float(model.weights[k]) for k in own)
        value += sum(float(model.factors[a] @ model.factors[b]) for a in own for b in own if a < b)
        assert row["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(value, -30, 30))), abs=1e-4)


@pytest.mark.filterwarnings("error")
def test_copies_and_texts_of_few_features_do_not_upset_training():
    draw = np.random.default_rng(3)
    good = ["plain text " + " ".join(f"w{x}" for x in draw.integers(0, 300, 80)) for _ in range(300)]
    bad = ["Of " * int(draw.integers(20, 400)) for _ in range(60)] + ["!!! " + "A" * 50] * 40
    texts = [(t.encode(), 1) for t in good + [good[0]] * 200] + [(t.encode(), 0) for t in bad]
    model = quality.train(texts, quality.Settings(buckets=1 << 14))
    scores = quality.score_texts(arrays.texts(pa.array([t.decode() for t, _ in texts])), model)
    labels = np.array([y for _, y in texts])
    assert (scores[labels == 1] > 0.5).all() and (scores[labels == 0] < 0.3).all()


def test_repeats_are_a_feature():
    bits = 10
    plain, _ = quality.features(arrays.texts(pa.array(["ab cd ab"])), bits)
    again, _ = quality.features(arrays.texts(pa.array(["ab ab cd"])), bits)
    marker = int(quality._REPEAT >> np.uint64(64 - bits))
    assert (again == marker).sum() == (plain == marker).sum() + 1


def test_factors_learn_what_only_counts_together():
    # Neither term alone says anything: both, or none, is one class.
    terms = np.arange(4, dtype=np.uint64)
    rows = [(np.array([0, 1]), 1), (np.array([0, 2]), 0), (np.array([1, 2]), 0), (np.array([2, 3]), 1)] * 60
    settings = toxicity.Settings(epochs=60, factors=4, positive_weight=1.0, decay=0.0)
    model = toxicity.train(rows, terms, settings)
    scores = [toxicity._sigmoid(toxicity._sums(model, places, np.array([0]))[0])[0] for places, _ in rows[:4]]
    assert [s > 0.5 for s in scores] == [True, False, False, True]


def test_machine_is_the_sum_over_pairs():
    random = np.random.default_rng(2)
    model = toxicity.Model(np.arange(6, dtype=np.uint64), 0.3, random.normal(size=6), random.normal(size=(6, 3)))
    places = np.array([0, 2, 5])
    pairs = sum(model.factors[a] @ model.factors[b] for a in places for b in places if a < b)
    assert np.isclose(toxicity._sums(model, places, np.array([0]))[0][0], 0.3 + model.weights[places].sum() + pairs)


def model_for(spark, module, docs, labels):
    return module.fit(docs, labels, F.lit(True))


@pytest.mark.parametrize("module", [quality, toxicity])
@pytest.mark.parametrize("label_rows", [[], [(1, 1), (3, 0), (5, 1), (8, 0), (8, None), (None, 1), (77, 1)], [(1, 1)]])
def test_awkward_documents(spark, module, label_rows):
    docs = frame(spark)
    labels = spark.createDataFrame(label_rows, "doc_id long, label int")
    out = module.score(docs, model_for(spark, module, docs, labels))
    assert set(out.columns) == set(docs.columns)  # clashing names are replaced
    rows = out.collect()
    assert len(rows) == len(awkward())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert len({r["score"] for r in rows if r["text"] == "one two"}) == 1
    assert len({r["score"] for r in rows if not r["text"]}) == 1
    nothing = module.score(frame(spark, []), model_for(spark, module, frame(spark, []), labels))
    assert nothing.count() == 0


def test_language_of_awkward_documents(spark):
    docs = frame(spark)
    model = langid.fit(docs, F.lit(True))
    rows = langid.identify(docs, model).collect()
    assert len(rows) == len(awkward())
    none = {r["lang_pred"] for r in rows if r["text"] is None or not any(c.isalpha() for c in r["text"])}
    assert none == {"und"}
    assert {r["lang_pred"] for r in rows} <= {"en", "fr", "de", "und"}
    assert all(0 <= r["score"] <= 1 for r in rows)
    empty = langid.fit(frame(spark, []), F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(docs, empty).collect()} == {"und"}
    assert langid.identify(frame(spark, []), model).count() == 0


def test_profiles_match_plain_counting(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = langid.fit(docs, F.lit(True), langid.Settings(size=50))
    for place, lang in enumerate(model.languages):
        counts = {}
        for row in docs.where(F.col("lang") == lang).collect():
            for gram in langid.grams(langid.letters(row["text"] or ""), 3).tolist():
                counts[gram] = counts.get(gram, 0) + 1
        best = sorted(counts, key=lambda g: (-counts[g], g))[:50]
        ranks = {int(k): int(r) for k, r in zip(model.keys, model.ranks[place], strict=True) if r < 50}
        assert ranks == {gram: rank for rank, gram in enumerate(best)}


def test_out_of_place_distance():
    settings = langid.Settings(size=3)
    model = langid.Model(["a", "b"], np.array([1, 2, 3], np.uint64), np.array([[0, 1, 2], [2, 1, 3]]), settings)
    own = langid.profile("", settings)
    assert not len(own) and langid.predict("", model) == ("und", 0.0)


def test_ties_go_to_the_lesser_language(spark):
    same = [doc(1, "abc abc", "x"), doc(2, "abc abc", "w")]
    docs = frame(spark, same)
    rows = langid.identify(docs, langid.fit(docs, F.lit(True))).collect()
    assert {r["lang_pred"] for r in rows} == {"w"}


def test_sample_is_bounded_and_stable(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(k, k % 2) for k in (1, 3, 5, 7, 8, 8, 9)], "doc_id long, label int")
    first = [r["doc_id"] for r in labelled_sample(docs, labels, F.lit(True), 4).collect()]
    again = [r["doc_id"] for r in labelled_sample(docs.repartition(5), labels.repartition(3), F.lit(True), 4).collect()]
    assert len(first) == 4 and first == again == sorted(set(first))


def test_held_out_rule(spark):
    rows = spark.range(200).select("id", held_out("id", 7, 2).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 7 == 2) for r in rows)
    assert spark.sql("SELECT CAST(NULL AS BIGINT) id").select(held_out("id", 7, 2)).first()[0] is False
