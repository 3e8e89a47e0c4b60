"""Benchmark decontamination: every passage of the corpus is a query to an index of test items.

The index is a BM25 inverted index with block-max WAND. A term's weight in an item is divided by
the item's score for its own text, so one threshold (a share of that score) holds for all items.
An item is indexed by its anchor, the longer of question and answer, as other text may stand
between the two. Passages are windows of two strides of words, a stride apart; anchors are indexed
by length class and a class's stride is at least its longest, so every occurrence of an anchor lies
whole in a window. Traversal starts only for passages that hold enough of some anchor's rarer terms
to reach the threshold even with all of its commoner ones.

What is retrieved is verified word by word around the passage, with a margin of several anchor
lengths: three-word runs of the question have to stand there, and words of the answer close
together, wherever in the margin. Items of few words have no such runs to choose from: they are
looked up by hash and have to stand in a text as one whole run of words. Words are runs of letters
and digits, A-Z lowered; in scripts without spaces every character is a word.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stratiform.llm import arrays

_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？｡])\s*")


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.45  # least BM25 score of a passage, as a share of the item's own
    common: float = 0.15  # share of an item's own score that its commonest terms may hold unseen
    question: float = 0.6  # least share of the question's three-word runs in the passage
    answer: float = 0.6  # least share of the answer's words in the passage
    margin: int = 4  # strides before and after a passage in which the other half is looked for
    least_words: int = 8  # shorter items have to stand as one whole run of words
    k1: float = 1.2
    b: float = 0.75
    block: int = 64  # postings in a block
    shard_items: int = 20_000  # about the most items in one index
    shard_chars: int = 50_000_000  # about the most text in one index


class Item(NamedTuple):
    item_id: object
    words: np.ndarray
    question: np.ndarray  # sorted hashes of three-word runs
    answer: np.ndarray  # sorted hashes of words
    answer_width: int  # words of the answer
    anchor: np.ndarray  # what is retrieved: the longer half, or the text if both are short
    whole: list[np.ndarray]  # the text, and question and answer, as word sequences


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of a plain text: all sentences but the last, and the last; one sentence is both."""
    parts = [part for part in _SENTENCE.split(text.strip()) if part]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return arrays.unspaced_words(arrays.Texts(raw, np.array([0, len(raw)]))).hash


def _runs(words: np.ndarray) -> np.ndarray:
    return np.unique(arrays.run_hashes(words, np.zeros(len(words), dtype=np.int64), 3)[0])


def make_item(item_id, question: str, answer: str, text: str, least_words: int = Settings.least_words) -> Item:
    """An item from its texts; a question of fewer than three words is replaced by the whole text."""
    words, asked, answered = _hashes(text), _hashes(question), _hashes(answer)
    whole = [words]
    if question != text and not np.array_equal(both := np.concatenate([asked, answered]), words) and len(both):
        whole.append(both)
    longer = asked if len(asked) >= len(answered) else answered
    anchor = longer if len(longer) >= least_words else words
    runs = _runs(asked if len(asked) >= 3 else words)
    return Item(item_id, words, runs, np.unique(answered), len(answered), anchor, whole)


class Index:
    """Postings of the anchors of one length class."""

    def __init__(self, items: list[Item], stride: int, settings: Settings) -> None:
        self.items, self.stride, self.settings = items, stride, settings
        count = len(items)
        mean = sum(len(item.anchor) for item in items) / count
        each = [np.unique(item.anchor, return_counts=True) for item in items]
        found = np.concatenate([terms for terms, _ in each])
        self.terms, term = np.unique(found, return_inverse=True)
        item = np.repeat(np.arange(count), [len(terms) for terms, _ in each])
        often = np.concatenate([counts for _, counts in each])
        spread = np.bincount(term)  # items of a term
        rarity = np.log1p((count - spread + 0.5) / (spread + 0.5))
        length = np.array([len(x.anchor) for x in items])[item] / mean
        weight = rarity[term] * often * (settings.k1 + 1) / (often + settings.k1 * (1 - settings.b + settings.b * length))
        weight /= np.bincount(item, weights=weight)[item]

        # An item's commonest terms, up to ``common`` of its score, start no traversal.
        order = np.lexsort((weight, -spread[term], item))
        own_first = np.concatenate([[0], np.cumsum(np.bincount(item))[:-1]])
        running = np.cumsum(weight[order])
        running -= np.concatenate([[0], running])[own_first][item[order]]
        rare = running > settings.common
        self.unseen = np.zeros(count)
        np.maximum.at(self.unseen, item[order][~rare], running[~rare])
        rare_places = order[rare]
        rare_places = rare_places[np.lexsort((item[rare_places], term[rare_places]))]
        self.rare_item, self.rare_weight = item[rare_places], weight[rare_places]
        rare_terms, spread_out = np.unique(term[rare_places], return_counts=True)
        self.rare_border = np.concatenate([[0], np.cumsum(spread_out)])
        self.rare = arrays.Members(self.terms[rare_terms])
        self.members = arrays.Members(self.terms)

        by_term = np.lexsort((item, term))
        border = np.searchsorted(term[by_term], np.arange(len(self.terms) + 1))
        self.postings: list[tuple[list[int], list[float]]] = []
        self.block_last: list[list[int]] = []
        self.block_max: list[list[float]] = []
        self.list_max = np.maximum.reduceat(weight[by_term], border[:-1])
        for k in range(len(self.terms)):
            places = by_term[border[k] : border[k + 1]]
            ids, weights = item[places].tolist(), weight[places].tolist()
            self.postings.append((ids, weights))
            starts = range(0, len(ids), settings.block)
            self.block_last.append([ids[min(s + settings.block, len(ids)) - 1] for s in starts])
            self.block_max.append([max(weights[s : s + settings.block]) for s in starts])

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Items whose weights for the terms add up to the threshold, by block-max WAND."""
        found = []
        cursors = [[self.postings[t][0][0], t, 0] for t in terms]  # current item, term, place
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, term, _) in enumerate(cursors):
                bound += self.list_max[term]
                if bound >= threshold - 1e-12:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            in_blocks, next_item = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(self.items)
            for _, term, _ in cursors[: pivot + 1]:
                block = bisect_left(self.block_last[term], item)
                if block < len(self.block_last[term]):
                    in_blocks += self.block_max[term][block]
                    next_item = min(next_item, self.block_last[term][block] + 1)
            if in_blocks >= threshold - 1e-12:
                score = 0.0
                for cursor in cursors[: pivot + 1]:
                    self._advance(cursor, item)
                    if cursor[0] == item:
                        score += self.postings[cursor[1]][1][cursor[2]]
                if score >= threshold - 1e-12:
                    found.append((item, score))
                next_item = item + 1
            for cursor in cursors[: pivot + 1]:
                self._advance(cursor, max(next_item, item + 1))
            cursors = [cursor for cursor in cursors if cursor[0] < len(self.items)]
        return found

    def _advance(self, cursor: list[int], item: int) -> None:
        """Move a cursor to its first posting at or after an item."""
        ids = self.postings[cursor[1]][0]
        cursor[2] = bisect_left(ids, item, cursor[2])
        cursor[0] = ids[cursor[2]] if cursor[2] < len(ids) else len(self.items)

    def leaks(self, found: arrays.Words, border: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """Text, item, score, and overlap with question and answer of all verified items in some texts."""
        at, rare = self.rare.find(found.hash)
        if not len(at):
            return []
        doc = found.doc[at]
        out: dict[tuple[int, int], tuple[float, float, float]] = {}
        for text, number in self._promising(doc, (at - border[doc]) // self.stride, rare):
            low = border[text] + number * self.stride
            high = min(low + 2 * self.stride, border[text + 1])
            words = found.hash[low:high]
            terms = np.unique(self.members.find(words)[1]).tolist()
            runs = None
            for item, score in self.search(terms, self.settings.threshold):
                if runs is None:
                    margin = self.settings.margin * self.stride
                    around = found.hash[max(low - margin, border[text]) : min(high + margin, border[text + 1])]
                    runs = _runs(around)
                question = _share(self.items[item].question, runs)
                if question < self.settings.question:
                    continue
                answer = _close_share(self.items[item], around)
                if question >= self.settings.question and answer >= self.settings.answer:
                    out[text, item] = max(out.get((text, item), (0.0, 0.0, 0.0)), (score, question, answer))
        return [(text, item, *values) for (text, item), values in out.items()]

    def _promising(self, doc: np.ndarray, window: np.ndarray, term: np.ndarray) -> list[tuple[int, int]]:
        """Windows that may reach the threshold: rarer terms seen, plus all that was left out of them."""
        counts = self.rare_border[term + 1] - self.rare_border[term]
        hit = np.repeat(np.arange(len(term)), counts)
        posting = np.arange(len(hit)) - np.repeat(np.cumsum(counts) - counts, counts) + self.rare_border[term[hit]]
        wide = int(window.max()) + 2
        own = doc[hit] * wide + window[hit] + 1  # one more, so that the window before is no other text's
        both = np.concatenate([own, own - 1])
        item = np.tile(self.rare_item[posting], 2)
        weight = np.tile(self.rare_weight[posting], 2)
        kind = np.tile(term[hit], 2)
        order = np.lexsort((kind, item, both))
        both, item, weight, kind = both[order], item[order], weight[order], kind[order]
        if not len(both):
            return []
        new_pair = np.ones(len(both), dtype=bool)
        new_pair[1:] = (both[1:] != both[:-1]) | (item[1:] != item[:-1])
        again = np.zeros(len(both), dtype=bool)
        again[1:] = ~new_pair[1:] & (kind[1:] == kind[:-1])
        starts = np.flatnonzero(new_pair)
        sums = np.add.reduceat(np.where(again, 0.0, weight), starts)
        enough = sums + self.unseen[item[starts]] >= self.settings.threshold - 1e-9
        keys = np.unique(both[starts][enough])
        return [(int(key // wide), int(key % wide) - 1) for key in keys if key % wide > 0]


def _share(wanted: np.ndarray, present: np.ndarray) -> float:
    return float(np.isin(wanted, present).mean()) if len(wanted) else 1.0


def _close_share(item: Item, words: np.ndarray) -> float:
    """The most of the answer's words that stand together, within about twice its length."""
    wanted = item.answer
    if not len(wanted):
        return 1.0
    place = np.minimum(np.searchsorted(wanted, words), len(wanted) - 1)
    at = np.flatnonzero(wanted[place] == words)
    width = 2 * item.answer_width + 4
    stops = np.searchsorted(at, at + width)
    best = seen = 0
    for first, stop in enumerate(stops.tolist()):
        if stop > seen:  # an end further on than those before; others hold no more
            best, seen = max(best, len(np.unique(place[at[first:stop]]))), stop
    return best / len(wanted)


class Phrases:
    """Items of few words, by the hash of each one's whole word sequence."""

    def __init__(self, items: list[Item]) -> None:
        self.items = items
        by_width: dict[int, list[tuple[int, int]]] = {}
        for place, item in enumerate(items):
            for words in item.whole:
                key = arrays.run_hashes(words, np.zeros(len(words), dtype=np.int64), len(words))[0][0]
                by_width.setdefault(len(words), []).append((int(key), place))
        self.widths = []
        for width, pairs in sorted(by_width.items()):
            pairs.sort()
            keys, first = np.unique(np.array([key for key, _ in pairs], dtype=np.uint64), return_index=True)
            places = np.split(np.array([place for _, place in pairs]), first[1:])
            self.widths.append((width, arrays.Members(keys), places))

    def leaks(self, found: arrays.Words, border: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """Text, item, and full scores of all items that stand in some texts."""
        out = set()
        for width, members, places in self.widths:
            runs, doc = arrays.run_hashes(found.hash, found.doc, width)
            at, key = members.find(runs)
            for pair in np.unique(doc[at] * len(places) + key).tolist():
                out.update((pair // len(places), item) for item in places[pair % len(places)].tolist())
        return [(text, item, 1.0, 1.0, 1.0) for text, item in sorted(out)]


def build(items: list[Item], settings: Settings) -> list[Index | Phrases]:
    """An index per length class, each of anchors of up to twice the length of the class before, and one of short items."""
    classes: dict[int, list[Item]] = {}
    short = []
    for item in items:
        if len(item.words) >= settings.least_words:
            classes.setdefault((len(item.anchor) - 1).bit_length(), []).append(item)
        elif len(item.words):
            short.append(item)
    indexes: list[Index | Phrases] = [Index(members, 1 << size, settings) for size, members in sorted(classes.items())]
    return indexes + [Phrases(short)] if short else indexes


def _items(rows, settings: Settings) -> list[Item]:
    items = []
    for row in rows:
        question, answer = (row["question"] or "", row["answer"] or "") if "question" in row else split_item(row["text"])
        items.append(make_item(row["item_id"], question, answer, row["text"], settings.least_words))
    return items


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: one row per document and verified item.

    ``docs`` needs doc_id and text; ``benchmark`` item_id and text, or item_id, question and
    answer as well. Other columns are ignored. An item's text that is null or empty is its question
    and answer; null or empty texts match nothing otherwise, nor do items without a word. Very long
    texts are taken whole. An empty table on either side gives no rows. Items of fewer than ``least_words`` words have to stand in a text as
    one run of words, the answer right after the question. Equal items are all found; rows that
    repeat a document give its best scores. Rows without doc_id are matched under a null id.

    Items are indexed in parts of about ``shard_items`` and ``shard_chars``, which bounds what is
    broadcast; every part is met by all passages. Texts are not shuffled.
    """
    spark = docs.sparkSession
    wanted = [c for c in ("item_id", "text", "question", "answer") if c in benchmark.columns]
    if "answer" not in wanted:
        wanted = [c for c in wanted if c != "question"]
    if "answer" in wanted:
        both = F.concat_ws(" ", "question", "answer")
        text = F.when(F.length("text") > 0, F.col("text")).otherwise(both) if "text" in wanted else both
        benchmark = benchmark.withColumn("text", text)
        wanted = ["item_id", "text", "question", "answer"]
    benchmark = benchmark.select(*wanted).where(F.length("text") > 0)
    count, chars = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-count // settings.shard_items), -(-chars // settings.shard_chars))
    kinds = [x.schema[name].dataType.simpleString() for x, name in ((docs, "doc_id"), (benchmark, "item_id"))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, question_overlap double, answer_overlap double"
    id_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    found = []
    for part in range(parts):
        rows = benchmark.where(F.pmod(F.xxhash64(*wanted), F.lit(parts)) == part).toLocalIterator()
        indexes = spark.sparkContext.broadcast(build(_items((row.asDict() for row in rows), settings), settings))
        found.append(docs.select("doc_id", "text").mapInArrow(arrays.mapper(_finder(indexes, id_type)), schema))
    everything = found[0]
    for more in found[1:]:
        everything = everything.union(more)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")
    return everything.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def _finder(indexes, id_type: pa.DataType):
    def run(batch: pa.RecordBatch):
        for first, _, part in arrays.slices(arrays.texts(batch.column(1))):
            found = arrays.unspaced_words(part)
            border = arrays.per_text(part, found.doc)
            for index in indexes.value:
                rows = index.leaks(found, border)
                if rows:
                    text, item, score, question, answer = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([first + k for k in text])),
                            pa.array([index.items[k].item_id for k in item], id_type),
                            *map(pa.array, (score, question, answer)),
                        ],
                        ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                    )

    return run
