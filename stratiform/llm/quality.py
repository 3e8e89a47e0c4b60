"""Quality classifier: supervised subword embeddings.

Every word and every run of three or four bytes of a text is hashed to one of ``buckets``
learned vectors; a text is the average of its vectors, and a softmax layer over two classes
reads that average. Vectors and layer are trained together by stochastic gradient descent.

Since the layer is linear, the logit difference of a text is the average of one number per
bucket (vector times difference of the layer's rows). Scoring gathers these numbers only,
which gives the same score as averaging the vectors first.

Besides the word itself, a word that repeats the word before it gives the feature "repeat".
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
    train_rows: int = 4000  # most labelled rows that are learned from, taken by hash of the id
    buckets: int = 1 << 17
    dim: int = 8
    epochs: int = 6
    least_steps: int = 260  # more epochs if so few rows are learned from that these make fewer steps
    batch: int = 32
    rate: float = 1.0
    longest_row: float = 2.0  # most length of a row of the layer
    seed: int = 7
    threshold: float = 0.3


class Trained(NamedTuple):
    vectors: np.ndarray  # a row per bucket
    layer: np.ndarray  # a row per class
    offset: np.ndarray
    bits: int


class Model(NamedTuple):
    weights: np.ndarray  # logit difference per bucket
    bias: float
    bits: int


_REPEAT = np.uint64(0x5BD1E9955BD1E995)
_SALT = {3: np.uint32(0x9E3779B1), 4: np.uint32(0x85EBCA6B)}


def features(batch: arrays.Texts, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every feature; all of a text's features lie between its borders."""
    shift = np.uint32(32 - bits)
    raw = np.where(arrays.SPACE[batch.data], np.uint8(0x20), batch.data).astype(np.uint32)
    ends = batch.offsets[1:]
    buckets, docs = [], []
    for width, salt in _SALT.items():
        count = len(raw) - width + 1
        if count <= 0:
            continue
        code = raw[:count].copy()
        for k in range(1, width):
            code |= raw[k : k + count] << np.uint32(8 * k)
        code ^= code >> np.uint32(15)
        code *= salt
        code ^= code >> np.uint32(13)
        code *= np.uint32(0xC2B2AE35)
        doc = np.repeat(np.arange(len(ends)), np.diff(batch.offsets))[:count]
        whole = np.ones(count, dtype=bool)  # runs that do not cross into the next text
        for k in range(1, width):
            cut = ends - k
            whole[cut[(cut >= 0) & (cut < count)]] = False
        short = ends - batch.offsets[:-1] < width
        if short.any():
            whole &= ~short[doc]
        buckets.append((code >> shift)[whole])
        docs.append(doc[whole])
    found = arrays.words(batch)
    top = np.uint64(64 - bits)
    buckets.append((found.hash >> top).astype(np.uint32))
    docs.append(found.doc)
    again = np.flatnonzero((found.hash[1:] == found.hash[:-1]) & (found.doc[1:] == found.doc[:-1])) + 1
    buckets.append(np.full(len(again), _REPEAT >> top, dtype=np.uint32))
    docs.append(found.doc[again])
    return np.concatenate(buckets), np.concatenate(docs)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def gathered(trained: Trained) -> Model:
    """One number per bucket: the difference that its vector makes between the classes' logits."""
    gap = trained.layer[1] - trained.layer[0]
    return Model((trained.vectors @ gap).astype(np.float32), float(trained.offset[1] - trained.offset[0]), trained.bits)


def train(texts: list[tuple[bytes, int]], settings: Settings) -> Model:
    return gathered(learn(texts, settings))


def learn(texts: list[tuple[bytes, int]], settings: Settings) -> Trained:
    """Stochastic gradient descent over small batches of texts; sparse rows of the vectors are updated.

    A text's step is divided by the squared length of its features' shares, so it moves the
    text's average by the rate whether many features or few make it up; a vector's step is the
    mean over the texts of the batch that have it, so copies weigh no more than one; and the
    layer's rows are kept within a length. Steps therefore stay bounded whatever the texts.

    Without rows, or with one class only, every score is that class's smoothed share.
    """
    bits = settings.buckets.bit_length() - 1
    random = np.random.default_rng(settings.seed)
    rows = []
    for data, label in texts:
        raw = np.frombuffer(data, dtype=np.uint8)
        bucket, _ = features(arrays.Texts(raw, np.array([0, len(raw)])), bits)
        if len(bucket):
            distinct, counts = np.unique(bucket, return_counts=True)
            rows.append((distinct, (counts / counts.sum()).astype(np.float32), label))
    positive = sum(label for _, _, label in rows)
    prior = float(np.log((positive + 0.5) / (len(rows) - positive + 0.5)))
    offset = np.array([-prior / 2, prior / 2], dtype=np.float32)
    if not positive or positive == len(rows):
        return Trained(np.zeros((settings.buckets, 1), np.float32), np.zeros((2, 1), np.float32), offset, bits)
    vectors = random.uniform(-1.0, 1.0, (settings.buckets, settings.dim)).astype(np.float32) / settings.dim
    layer = random.normal(0.0, 0.5, (2, settings.dim)).astype(np.float32)
    per_epoch = -(-len(rows) // settings.batch)
    epochs = max(settings.epochs, -(-settings.least_steps // per_epoch))
    done, steps = 0, epochs * per_epoch
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for low in range(0, len(rows), settings.batch):
            chosen = [rows[k] for k in order[low : low + settings.batch]]
            index = np.concatenate([r[0] for r in chosen])
            value = np.concatenate([r[1] for r in chosen])
            starts = np.cumsum([0, *[len(r[0]) for r in chosen[:-1]]])
            label = np.array([r[2] for r in chosen])
            means = np.add.reduceat(vectors[index] * value[:, None], starts)
            logits = means @ layer.T + offset
            logits -= logits.max(axis=1, keepdims=True)
            share = np.exp(logits)
            share /= share.sum(axis=1, keepdims=True)
            share[np.arange(len(label)), label] -= 1.0  # gradient of the softmax loss
            rate = settings.rate * (1.0 - done / steps)
            done += 1
            sizes = np.diff(np.append(starts, len(index)))
            scale = value / np.repeat(np.add.reduceat(value * value, starts), sizes)
            pull = np.repeat(share @ layer, sizes, axis=0) * scale[:, None]
            by_bucket = np.argsort(index, kind="stable")
            groups = np.flatnonzero(np.diff(index[by_bucket].astype(np.int64), prepend=-1))
            often = np.diff(np.append(groups, len(index)))
            vectors[index[by_bucket[groups]]] -= rate * np.add.reduceat(pull[by_bucket], groups) / often[:, None]
            layer -= rate * (share.T @ means) / len(chosen)
            layer /= np.maximum(np.linalg.norm(layer, axis=1, keepdims=True) / settings.longest_row, 1.0)
            offset -= 0.1 * rate * share.mean(axis=0)
    if not (np.isfinite(vectors).all() and np.isfinite(layer).all()):
        raise ArithmeticError("training did not converge")
    return Trained(vectors, layer, offset, bits)


def score_texts(batch: arrays.Texts, model: Model) -> np.ndarray:
    """Score of each text; a text without features scores the prior."""
    out = np.zeros(len(batch.offsets) - 1)
    for first, last, part in arrays.slices(batch, 1 << 19):
        bucket, doc = features(part, model.bits)
        total = np.bincount(doc, weights=model.weights[bucket], minlength=last - first)
        count = np.bincount(doc, minlength=last - first)
        out[first:last] = total / np.maximum(count, 1)
    return _sigmoid(out + model.bias)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings = Settings()) -> Model:
    """Learn from at most ``settings.train_rows`` rows of ``labels`` (doc_id, label) under ``learn``."""
    sample = labelled_sample(docs, labels, learn, settings.train_rows)
    texts = [((row["text"] or "").encode(), row["label"]) for row in sample.toLocalIterator()]
    return train(texts, settings)


def score(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``; only ``text`` is read for them.

    A null text is an empty one; an empty text gets the score of a text without features
    (the share of good texts among those learned from). Very long texts are scored whole, in
    pieces of bounded size; an empty table gives no rows. Repeated rows get equal scores, and
    columns of the input named ``score`` or ``predicted`` are replaced.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x 4 bytes, whatever the input

    def run(batch: pa.RecordBatch):
        scores = score_texts(arrays.texts(batch.column(at)), shared.value)
        chosen = (scores >= settings.threshold).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(scores), pa.array(chosen)], [*batch.schema.names, "score", "predicted"]
        )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "score double", "predicted int"])
    return docs.mapInArrow(arrays.mapper(run), schema)
