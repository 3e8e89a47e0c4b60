import pyarrow as pa
import pytest
from helpers import awkward, doc, frame, words
from test_neardup import shingle_set
from test_wavelet import expected, plain  # noqa: F401

import corpus_pipeline
from stratiform.llm import wavelet
from stratiform.session import new_path

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """What every stage was given and what it kept."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = []
    for name, run in corpus_pipeline.STAGES:
        path = new_path(spark, name)
        run(spark, docs, SF_DIR).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stage_list(stages):
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]
    for name, (before, after) in stages.items():
        if name != "tokens":
            assert after.schema == before.schema


def test_quality_keeps_clean_documents(spark, stages):
    before, after = (dict(pairs(x)) for x in stages["quality"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    good = [k for k, q in labels.items() if q == 1 and k in before]
    bad = [k for k, q in labels.items() if q == 0 and k in before]
    assert sum(k in after for k in good) >= 0.98 * len(good)
    assert sum(k in after for k in bad) <= 0.05 * len(bad)


def test_one_document_of_each_group_stays(stages):
    before, after = (dict(pairs(x)) for x in stages["near_duplicates"])
    assert set(after) < set(before)
    sets = {k: shingle_set(t) for k, t in after.items()}
    index = {}
    for k, own in sets.items():
        for s in own:
            index.setdefault(s, []).append(k)
    for k, own in sets.items():
        common = {}
        for s in own:
            for other in index[s]:
                common[other] = common.get(other, 0) + 1
        for other, n in common.items():
            assert other == k or 100 * n < 75 * (len(own) + len(sets[other]) - n)


def test_contaminated_documents_go_and_others_stay(spark, stages):
    before, after = (dict(pairs(x)) for x in stages["decontamination"])
    items = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    gone = {k for k, t in before.items() if any(item in t for item in items)}
    assert gone and set(after) == set(before) - gone


def test_mix_repeats_documents(stages):
    before, after = (x.collect() for x in stages["mixing"])
    sizes, taken = {}, {}
    for rows, sums in ((before, sizes), (after, taken)):
        for r in rows:
            sums[r["source"]] = sums.get(r["source"], 0) + len(words(r["text"]))
    assert set(taken) <= set(sizes)
    assert abs(sum(taken.values()) - sum(sizes.values())) < 5 * len(sizes)


def test_tokens_of_what_was_mixed(stages, plain):  # noqa: F811
    before, after = stages["tokens"]
    assert sorted(tuple(r) for r in after.collect()) == sorted(expected(pairs(before), plain))


def test_awkward_documents_pass_all_stages(spark, tmp_path):
    rows = awkward() + [doc(100 + k, "a good plain text of some words " * (k + 1)) for k in range(5)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_empty_documents_pass_all_stages(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_decisions_hold_for_rows_without_id_and_repeated_ids(spark, tmp_path):
    plain = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(4)]
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    rows = [doc(None, plain[0]), doc(None, plain[0] + " more"), doc(5, plain[0])]  # one group, 5 has an id
    rows += [doc(6, plain[1])] * 5 + [doc(6, plain[2]), doc(7, plain[1])]
    rows += [doc(None, f"{plain[3]} {item}"), doc(8, f"before {item} after"), doc(8, "clean text under the same id"), doc(None, "")]
    rows += [doc(None, "")] * 2 + [doc(9, None)] * 2
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    once = corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path))
    assert once.schema == docs.schema
    want = {(5, plain[0]), (6, plain[1]), (6, plain[2]), (None, f"{plain[3]} {item}"), (8, f"before {item} after")}
    want |= {(8, "clean text under the same id"), (None, ""), (9, None)}
    assert set(pairs(once)) == want and once.count() == len(want)
    clean = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert clean.schema == docs.schema
    assert sorted(map(str, pairs(clean))) == sorted(str((r[0], r[1])) for r in rows if item not in (r[1] or ""))


def test_batches_to_python_are_bounded(spark, monkeypatch):
    """Rows of texts, fewer than the records of a batch, come in several batches."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    monkeypatch.setattr(wavelet, "write", lambda docs, path: docs)
    monkeypatch.setattr(wavelet, "read", lambda docs: docs.mapInArrow(sizes, "n long"))
    docs = spark.range(3000).coalesce(1).selectExpr("id AS doc_id", "repeat('word ', 2000) AS text")
    found = [row.n for row in dict(corpus_pipeline.STAGES)["tokens"](spark, docs, SF_DIR).collect()]
    assert sum(found) >= 3000 * 10_000 and max(found) <= 1.5 * 8 * 1024 * 1024
