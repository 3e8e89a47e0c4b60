"""Language identification by rank-order profiles.

A profile is the ranked list of the most frequent letter n-grams (one to three letters, words
padded with a blank on both sides, letters lowered). A document's own list is compared with
each language's by the out-of-place distance: the sum, over the document's n-grams, of how far
each is from its rank in the profile, and the length of the profile where it is missing there.
The nearest language wins; equal distances go to the lesser name.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiform.llm import arrays

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    size: int = 300  # n-grams in a profile
    longest: int = 3


class Model(NamedTuple):
    languages: list[str]
    keys: np.ndarray  # sorted n-grams of all profiles
    ranks: np.ndarray  # language x key; ``size`` where the profile lacks the n-gram
    settings: Settings


@cache
def _lowered() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for point in range(sys.maxunicode + 1):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            out[point] = ord(low[0]) if low[0].isalpha() else point
    return out


def letters(text: str) -> np.ndarray:
    """Letters of a text with one 0 before, after and between words."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = _lowered()[points]
    padded = np.zeros(len(low) + 2, dtype=np.uint32)
    padded[1:-1] = low
    keep = np.ones(len(padded), dtype=bool)
    keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)
    out = padded[keep]
    return out if len(out) > 2 else out[:0]


def grams(padded: np.ndarray, longest: int) -> np.ndarray:
    """Keys of all n-grams: single letters, and longer runs with a letter in them but no word border inside."""
    wide = padded.astype(np.uint64)
    out = [wide[wide != 0]]
    if longest >= 2 and len(wide) >= 2:
        out.append((wide[:-1] << np.uint64(21)) | wide[1:])
    if longest >= 3 and len(wide) >= 3:
        whole = wide[1:-1] != 0
        out.append(((wide[:-2] << np.uint64(42)) | (wide[1:-1] << np.uint64(21)) | wide[2:] | np.uint64(1 << 63))[whole])
    return np.concatenate(out) if out else wide


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent keys, most frequent first, equal counts by the lesser key."""
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))][:size]


def profile(text: str | None, settings: Settings) -> np.ndarray:
    padded = letters(text or "")
    if not len(padded):
        return padded.astype(np.uint64)
    keys, counts = np.unique(grams(padded, settings.longest), return_counts=True)
    return ranked(keys, counts, settings.size)


def predict(text: str | None, model: Model) -> tuple[str, float]:
    """The nearest language, and 1 minus its distance as a share of the greatest possible one."""
    own = profile(text, model.settings)
    if not len(own) or not model.languages:
        return UNDETERMINED, 0.0
    size = model.settings.size
    place = np.minimum(np.searchsorted(model.keys, own), len(model.keys) - 1)
    there = model.keys[place] == own
    ranks = np.where(there, model.ranks[:, place], size)
    apart = np.where(ranks < size, np.abs(ranks - np.arange(len(own))), size).sum(axis=1)
    best = int(np.argmin(apart))
    return model.languages[best], float(1.0 - apart[best] / (size * len(own)))


def fit(docs: DataFrame, learn: Column, settings: Settings = Settings()) -> Model:
    """Profiles of every language of ``docs`` (text, lang), counted over all rows under ``learn``.

    Rows without a language teach nothing. Every task counts its n-grams per language before
    the shuffle, so it carries a row per task, language and distinct n-gram, however large the
    share of one language; the driver gets ``size`` rows per language.
    """
    known = docs.where(learn & F.col("lang").isNotNull()).select("lang", "text")

    def count(batches):
        sums: dict[str, list[np.ndarray]] = {}

        def put(lang, keys, counts):
            if lang in sums:
                keys, counts = np.concatenate([sums[lang][0], keys]), np.concatenate([sums[lang][1], counts])
                keys, counts = arrays.add_up(keys, counts)
            sums[lang] = [keys, counts]

        for batch in batches:
            grouped: dict[str, list[np.ndarray]] = {}
            waiting = 0
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                padded = letters(text.as_py() or "")
                if not len(padded):
                    continue
                grouped.setdefault(lang, []).append(padded)
                waiting += len(padded)
                if waiting > 1 << 20:
                    for name, parts in grouped.items():
                        put(name, *np.unique(grams(np.concatenate(parts), settings.longest), return_counts=True))
                    grouped, waiting = {}, 0
            for name, parts in grouped.items():
                put(name, *np.unique(grams(np.concatenate(parts), settings.longest), return_counts=True))
        for lang, (keys, counts) in sums.items():
            if not len(keys):
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))],
                ["lang", "gram", "n"],
            )

    counted = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Keys are unsigned; the three-letter ones have the top bit and come after the shorter ones.
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram") < 0, "gram")
    top = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.size)
    rows = top.collect()
    languages = sorted({row["lang"] for row in rows})
    keys = np.unique(np.array([row["gram"] for row in rows], dtype=np.int64).view(np.uint64))
    ranks = np.full((len(languages), len(keys)), settings.size, dtype=np.int64)
    for row in rows:
        key = np.int64(row["gram"]).view(np.uint64)
        ranks[languages.index(row["lang"]), np.searchsorted(keys, key)] = row["rank"] - 1
    return Model(languages, keys, ranks, settings)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1), from ``text`` alone.

    A text that is null or has no letter gets ``und`` and 0, as does every text if nothing was
    learned. The profile of a very long text is of the whole of it; an empty table gives no rows.
    Repeated rows get equal results; input columns of these names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``size`` keys per language

    def run(batch: pa.RecordBatch):
        found = [predict(text.as_py(), shared.value) for text in batch.column(at)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
            [*batch.schema.names, "lang_pred", "score"],
        )

    schema = ", ".join(
        [*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "lang_pred string", "score double"]
    )
    return docs.mapInArrow(arrays.mapper(run), schema)
