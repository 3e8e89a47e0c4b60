import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import SF_DIR, awkward, doc, frame, words

from pyspark.sql import functions as F
from stratiform.llm import arrays, ngram_lm, queries
from stratiform.llm.sampling import held_out


class Plain:
    """The model's formulas over Counters."""

    def __init__(self, texts):
        self.c, self.b = Counter(), Counter()
        for tokens in texts:
            self.c.update(tokens)
            self.b.update(zip(["<begin>", *tokens], tokens))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.contexts = Counter(w for _, w in self.b)
        self.high, self.low = (self.discounts(x) for x in (self.b, self.contexts))
        self.followers, self.total = defaultdict(list), Counter()
        for (v, _), n in self.b.items():
            self.followers[v].append(n)
            self.total[v] += n
        self.freed = sum(self.low[min(n, 3)] for n in self.contexts.values()) / len(self.b) if self.b else 1.0

    @staticmethod
    def discounts(counter):
        spread = Counter(counter.values())
        return ngram_lm.discounts(np.array([spread[k] for k in (1, 2, 3, 4)]))

    def word(self, w):
        k = self.contexts[w]
        own = max(k - self.low[min(k, 3)], 0) / len(self.b) if self.b else 0.0
        return own + self.freed / (self.v + 1)

    def pair(self, v, w):
        if not self.total[v]:
            return self.word(w)
        n = self.b[v, w]
        freed = sum(self.high[min(x, 3)] for x in self.followers[v])
        return (max(n - self.high[min(n, 3)], 0) + freed * self.word(w)) / self.total[v]

    def score(self, tokens):
        return sum(math.log10(self.pair(v, w)) for v, w in zip(["<begin>", *tokens], tokens))

    def base(self, tokens):
        return sum(math.log10((self.c[w] + 1) / (self.n + self.v + 1)) for w in tokens)


def tokens(text):
    return [*words(text), "</end>"]


def compare(rows, plain):
    for r in rows:
        own = tokens(r["text"])
        assert r["n_tokens"] == len(own) and r["train_tokens"] == plain.n
        assert r["n_known"] == sum(plain.c[w] > 0 for w in own)
        assert r["score"] == pytest.approx(plain.score(own), rel=1e-9, abs=1e-9)
        assert r["base_score"] == pytest.approx(plain.base(own), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("settings", [ngram_lm.Settings(), ngram_lm.Settings(shard_tokens=500, least_shards=3, range_words=100, held=2000)])
def test_scores_against_counters(spark, settings):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    learn = ~held_out("doc_id", 7, 2)
    model = ngram_lm.fit(docs.where(learn), settings)
    assert len(model.hot)  # some contexts are dealt over all shards
    texts = [tokens(r["text"]) for r in docs.where(learn).collect()]
    compare(ngram_lm.score(docs, model).collect(), Plain(texts))


def test_probabilities_add_up():
    plain = Plain([tokens(t) for t in ("a b a c", "a b b d", "c", "", "a b a b e f g", "d d d")] * 2)
    for v in [*plain.c, "<begin>", "unknown"]:
        known = sum(plain.pair(v, w) for w in plain.c)
        assert known + plain.pair(v, "unknown") == pytest.approx(1.0)


def test_awkward_documents(spark):
    docs = frame(spark)
    model = ngram_lm.fit(docs)
    out = ngram_lm.score(docs, model)
    assert set(out.columns) == {*docs.columns, "n_tokens", "n_known", "train_tokens", "base_score"}
    rows = out.collect()
    assert len(rows) == len(awkward())
    compare(rows, Plain([tokens(row[1]) for row in awkward()]))
    nothing = ngram_lm.fit(frame(spark, []))
    assert nothing.tokens == 0
    compare(ngram_lm.score(docs, nothing).collect(), Plain([]))
    assert ngram_lm.score(frame(spark, []), model).count() == 0


def test_better_than_the_base_on_held_out_texts(spark):
    rows = queries.op6_ngram_lm(spark, "/root/testdata/sf0.01").where("held_out")
    sums = rows.agg(F.sum("n_tokens").alias("n"), F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert sums["s"] > sums["b"]
    assert all(
        zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows.select("doc_id").collect()
    )


def test_packing_round_trip():
    draw = np.random.default_rng(1)
    keys = np.unique(draw.integers(0, 50, 400, dtype=np.uint64) << np.uint64(32) | draw.integers(0, 1 << 32, 400, dtype=np.uint64))
    counts = draw.integers(1, 1000, len(keys))
    got = ngram_lm._unpack(ngram_lm._pack(keys, counts))
    assert (got[0] == keys).all() and (got[1] == counts).all()


def test_tokens_end_every_text():
    got, doc_of = ngram_lm.tokens_of(arrays.texts(__import__("pyarrow").array(["a b", None, "", "c"])))
    assert doc_of.tolist() == [0, 0, 0, 1, 2, 3, 3]
    assert (got[[2, 3, 4, 6]] == ngram_lm.END).all()


def test_repeated_rows_count_as_often_as_they_stand(spark):
    model = ngram_lm.fit(frame(spark, [doc(1, "a b"), doc(1, "a b")]))
    assert (model.tokens, model.texts, model.words, model.pairs) == (6, 2, 3, 3)


def test_counts_beyond_32_bits():
    keys = np.array([1 << 32 | 5, 1 << 32 | 9, 2 << 32 | 5, 7 << 32 | 1], dtype=np.uint64)
    counts = np.array([3, (1 << 32) + 7, (1 << 32) - 1, 1 << 40])
    for back, want in zip(ngram_lm._unpack(ngram_lm._pack(keys, counts)), (keys, counts), strict=True):
        assert (back == want).all()
    own = np.array([1, 2, 7], dtype=np.uint32)
    followers = np.arange(9, dtype=np.uint32).reshape(3, 3)
    raw = np.frombuffer(b"".join(ngram_lm._shard_file(keys, counts, own, followers)), dtype=np.uint8)
    shard = ngram_lm._open_shard(raw)
    wanted = np.append(keys, np.uint64(3 << 32))
    assert shard.find(wanted).tolist() == [*counts.tolist(), 0]
    assert (shard.contexts == own).all() and (shard.followers == followers).all()
