"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its distinct words (runs of letters and digits, A-Z lowered) and the first
four, five and six bytes of longer words, each as a 64-bit hash. The machine adds a weight per
term and, for every two terms of a text, the product of their factor vectors, so that two terms
that are harmless alone (an insult, a mention of a group) can count together. Terms are kept
if their share of toxic documents differs clearly from that of others; hashes that were not
kept have no part in a score.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratiform.llm import arrays
from stratiform.llm.sampling import labelled_sample


@dataclass(frozen=True)
class Settings:
    train_rows: int = 20000  # most labelled rows that are learned from, taken by hash of the id
    terms: int = 1 << 15  # most terms in the model
    least_documents: int = 3
    least_evidence: float = 8.0  # log-likelihood ratio of a term
    factors: int = 8
    epochs: int = 8
    positive_weight: float = 3.0  # toxic texts are the rare class
    batch: int = 64
    rate: float = 0.1
    decay: float = 1e-4
    seed: int = 11
    threshold: float = 0.3


class Model(NamedTuple):
    terms: np.ndarray  # sorted hashes
    bias: float
    weights: np.ndarray
    factors: np.ndarray


PREFIXES = (4, 5, 6)


def text_terms(batch: arrays.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every term; a term comes as often as it stands in the text."""
    found = arrays.words(batch, arrays.NOT_ALNUM)
    hashes, docs = [found.hash], [found.doc]
    for k, width in enumerate(PREFIXES):
        longer = found.end - found.start > width
        start = found.start[longer]
        head = arrays.span_hashes(batch.data, start, start + width)
        hashes.append(arrays.mix(head + np.uint64(k + 1)))
        docs.append(found.doc[longer])
    return np.concatenate(hashes), np.concatenate(docs)


def distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((keys, docs))
    keys, docs = keys[order], docs[order]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    return keys[first], docs[first]


def _sums(model: Model, term: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Raw value per text and the sum of its factor vectors; texts without terms are not in ``starts``."""
    own = model.factors[term]
    summed = np.add.reduceat(own, starts)
    squares = np.add.reduceat(own * own, starts)
    linear = np.add.reduceat(model.weights[term], starts)
    return model.bias + linear + 0.5 * (summed * summed - squares).sum(axis=1), summed


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def train(rows: list[tuple[np.ndarray, int]], terms: np.ndarray, settings: Settings) -> Model:
    """Stochastic gradient descent with steps scaled per weight; rows hold places in ``terms``, and the label."""
    random = np.random.default_rng(settings.seed)
    positive = sum(label for _, label in rows)
    bias = float(np.log((positive + 0.5) / (len(rows) - positive + 0.5)))
    weights = np.zeros(max(len(terms), 1))
    factors = random.normal(0.0, 0.01, (max(len(terms), 1), settings.factors))
    seen_w, seen_f, seen_b = np.full(weights.shape, 1e-6), np.full(factors.shape, 1e-6), 1e-6
    filled = [r for r in rows if len(r[0])]
    empty = [label for term, label in rows if not len(term)]
    for _ in range(settings.epochs):
        order = random.permutation(len(filled))
        for low in range(0, len(filled), settings.batch):
            chosen = [filled[k] for k in order[low : low + settings.batch]]
            term = np.concatenate([r[0] for r in chosen])
            sizes = np.array([len(r[0]) for r in chosen])
            starts = np.cumsum(sizes) - sizes
            model = Model(terms, bias, weights, factors)
            raw, summed = _sums(model, term, starts)
            label = np.array([r[1] for r in chosen])
            error = (_sigmoid(raw) - label) * np.where(label == 1, settings.positive_weight, 1.0)
            each = np.repeat(error, sizes)[:, None]
            pull = each * (np.repeat(summed, sizes, axis=0) - factors[term])
            by_term = np.argsort(term, kind="stable")
            groups = np.flatnonzero(np.diff(term[by_term], prepend=-1))
            used = term[by_term[groups]]
            step_w = np.add.reduceat(each[by_term, 0], groups) + settings.decay * weights[used]
            step_f = np.add.reduceat(pull[by_term], groups) + settings.decay * factors[used]
            seen_w[used] += step_w**2
            seen_f[used] += step_f**2
            weights[used] -= settings.rate * step_w / np.sqrt(seen_w[used])
            factors[used] -= 0.2 * settings.rate * step_f / np.sqrt(seen_f[used])
            # Texts without a term of the model take part in the bias only, a share in each step.
            share = len(chosen) / len(filled)
            step_b = error.sum() + share * sum(_sigmoid(np.array([bias]))[0] - y for y in empty)
            seen_b += step_b**2
            bias -= settings.rate * step_b / np.sqrt(seen_b)
    return Model(terms, float(bias), weights.astype(np.float32), factors.astype(np.float32))


def score_texts(batch: arrays.Texts, model: Model, members: arrays.Members) -> np.ndarray:
    raw = np.full(len(batch.offsets) - 1, model.bias)
    for first, _, part in arrays.slices(batch, 1 << 20):
        hashes, docs = text_terms(part)
        at, place = members.find(hashes)
        place, doc = distinct(place, docs[at])
        if len(doc):
            starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            raw[first + doc[starts]] = _sums(model, place, starts)[0]
    return _sigmoid(raw)


def _evidence(pos: Column, neg: Column, all_pos: int, all_neg: int) -> Column:
    """Log-likelihood ratio of a term's documents being spread as all documents are."""
    total = pos + neg
    share = all_pos / max(all_pos + all_neg, 1)

    def part(n: Column, expected: Column) -> Column:
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    return 2 * (part(pos, total * F.lit(share)) + part(neg, total * F.lit(1 - share)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings = Settings()) -> Model:
    """Learn from at most ``settings.train_rows`` rows of ``labels`` (doc_id, label) under ``learn``.

    The driver gets ``settings.terms`` terms and the kept terms of the sample, both bounded.
    With labels of one class only, every score is that class's smoothed share.
    """
    sample = labelled_sample(docs, labels, learn, settings.train_rows)
    counts = {row["label"]: row["n"] for row in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    all_pos, all_neg = counts.get(1, 0), counts.get(0, 0)

    def count(batch: pa.RecordBatch):
        label = batch.column(0).to_numpy(zero_copy_only=False)
        for first, last, part in arrays.slices(arrays.texts(batch.column(1))):
            keys, doc = distinct(*text_terms(part))
            positive = label[first:last][doc].astype(np.int64)
            order = np.argsort(keys)
            keys, positive = keys[order], positive[order]
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
            if not len(starts):
                continue
            total = np.diff(np.append(starts, len(keys)))
            pos = np.add.reduceat(positive, starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[starts].view(np.int64)), pa.array(pos), pa.array(total - pos)], ["term", "pos", "neg"]
            )

    counted = (
        sample.select("label", "text")
        .mapInArrow(arrays.mapper(count), "term long, pos long, neg long")
        .groupBy("term")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .where(F.col("pos") + F.col("neg") >= settings.least_documents)
        .withColumn("evidence", _evidence(F.col("pos"), F.col("neg"), all_pos, all_neg))
        .where(F.col("evidence") >= settings.least_evidence)
        .orderBy(F.desc("evidence"), "term")
        .limit(settings.terms)
    )
    terms = np.sort(np.array([row["term"] for row in counted.select("term").collect()], dtype=np.int64).view(np.uint64))
    members = docs.sparkSession.sparkContext.broadcast(arrays.Members(terms))  # at most ``terms`` hashes

    def places(batch: pa.RecordBatch):
        for first, last, part in arrays.slices(arrays.texts(batch.column(2))):
            hashes, doc = text_terms(part)
            at, place = members.value.find(hashes)
            place, doc = distinct(place, doc[at])
            border = np.searchsorted(doc, np.arange(last - first + 1))
            kept = [place[border[k] : border[k + 1]].astype(np.int32).tobytes() for k in range(last - first)]
            part_of = batch.slice(first, last - first)
            yield pa.RecordBatch.from_arrays(
                [part_of.column(0), part_of.column(1), pa.array(kept, pa.binary())], ["doc_id", "label", "places"]
            )

    found = sample.select("doc_id", "label", "text").mapInArrow(
        arrays.mapper(places), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, places binary"
    )
    rows = [(np.frombuffer(row["places"], dtype=np.int32), row["label"]) for row in found.orderBy("doc_id").collect()]
    return train(rows, terms, settings)


def score(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``, from ``text`` alone.

    A null text is an empty one; a text without terms of the model gets the score of the bias.
    Very long texts are scored whole; an empty table gives no rows. Repeated rows get equal scores;
    input columns of these names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index("text")
    shared = docs.sparkSession.sparkContext.broadcast((model, arrays.Members(model.terms)))

    def run(batch: pa.RecordBatch):
        scores = score_texts(arrays.texts(batch.column(at)), *shared.value)
        chosen = (scores >= settings.threshold).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(scores), pa.array(chosen)], [*batch.schema.names, "score", "predicted"]
        )

    schema = ", ".join(
        [*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "score double", "predicted int"]
    )
    return docs.mapInArrow(arrays.mapper(run), schema)
