"""Quality rules, line first: lines that fail a rule are removed, then documents that lost too much are rejected.

A line with a word fails if it does not end as a sentence or list entry does, holds too many
marks, is a row of navigation links, or has a phrase of page boilerplate. What is left is the
document's cleaned text; a document that keeps too little of its word characters is rejected, as
is one with too few words or too many repeated ones.

Everything is DataFrame expressions over one row: nothing is shuffled, and a text is only ever
compared with itself. Windows of eight words are compared by 64-bit hashes of their words' hashes;
their positions are sorted only in texts where two windows agree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What lies between words, the symbols that are counted, and letters that are lowered.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Last characters of a whole line, and marks that prose has few of.
ENDS = ".!?:;,\"')]…”’»。！？：；，、」』）।؟۔"
MARKS = "!?#*$%&|<>~^_=+{}@\\"
# Signs between links, words that are links, and phrases of page boilerplate.
LINK_SIGNS = "|»›>•·"
LINKS = (
    "home|menu|login|log in|logout|log out|sign in|sign up|register|search|contact|contact us|about|about us|help|faq"
    "|sitemap|next|previous|back|back to top|top|more|read more|share|print|subscribe|rss|archive|categories|tags"
)
PHRASES = (
    "all rights reserved", "terms of use", "terms of service", "terms and conditions", "privacy policy", "cookie policy",
    "use of cookies", "uses cookies", "use cookies", "accept cookies", "enable javascript", "javascript is disabled",
    "licensed under", "©", "lorem ipsum", "click here", "sign up for our", "subscribe to our", "follow us on",
    "powered by", "skip to content", "share on facebook", "share on twitter",
)
LINK_WORDS = f"^({LINKS})([ ]*[|»›>•·,/-]?[ ]*({LINKS}))*$"

COLUMNS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
    "n_lines", "n_failed_lines", "kept_chars", "cleaned", "kept",
]


@dataclass(frozen=True)
class Settings:
    window: int = 8  # words of a passage that counts as repeated
    least_words: int = 20
    most_repeated: int = 30  # percent of the words
    most_marks: int = 10  # percent of a line's characters
    few_marks: int = 2  # marks that any line may have
    longest_link: int = 30  # mean characters of what lies between signs in a row of links
    longest_links: int = 200  # characters of a line that is nothing but the words of links
    least_kept: int = 50  # percent of the word characters


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(words: Column, width: int) -> Column:
    """How many words lie in runs of ``width`` words that the list has at least twice."""

    def sorted_places(runs: Column) -> Column:
        places = F.transform(runs, lambda run, at: F.struct(run.alias("run"), at.alias("at")))
        return F.sort_array(places)

    def again(places: Column) -> Column:
        def same(entry: Column, at: Column) -> Column:
            before = F.when(at > 0, F.get(places, at - 1)["run"] == entry["run"])
            return F.coalesce(before, F.lit(False)) | F.coalesce(F.get(places, at + 1)["run"] == entry["run"], F.lit(False))

        return F.sort_array(F.transform(F.filter(places, same), lambda entry: entry["at"]))

    def covered(starts: Column) -> Column:
        none = F.struct(F.lit(0).cast("long").alias("words"), F.lit(-width).alias("last"))
        return F.aggregate(
            starts,
            none,
            lambda sofar, at: F.struct(
                (sofar["words"] + F.least(F.lit(width), at - sofar["last"])).alias("words"), at.alias("last")
            ),
            lambda sofar: sofar["words"],
        )

    def counted(runs: Column) -> Column:
        some = F.size(F.array_distinct(runs)) < F.size(runs)
        return F.when(some, _bind(sorted_places(runs), lambda places: covered(again(places)))).otherwise(F.lit(0).cast("long"))

    def runs_of(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashes) - (width - 1))
        return F.transform(starts, lambda at: F.xxhash64(F.slice(hashes, at, width)))

    hashes = F.transform(words, lambda word: F.xxhash64(word))
    return F.when(F.size(words) <= width, F.lit(0).cast("long")).otherwise(
        _bind(hashes, lambda h: _bind(runs_of(h), counted))
    )


def line_fails(line: Column, settings: Settings = Settings()) -> Column:
    """Whether a line with a word breaks one of the rules; lines without words never do."""

    def phrases(plain: Column) -> Column:
        return reduce(or_, (plain.contains(phrase) for phrase in PHRASES))

    def rules(trimmed: Column) -> Column:
        plain = F.translate(trimmed, UPPER, LOWER)
        no_end = ~F.lit(ENDS).contains(F.substring(trimmed, -1, 1))
        marks = F.length(trimmed) - F.length(_without(trimmed, MARKS))
        marked = (marks > settings.few_marks) & (100 * marks > settings.most_marks * F.length(trimmed))
        signs = F.length(trimmed) - F.length(_without(trimmed, LINK_SIGNS))
        row = (signs >= 2) & (F.length(trimmed) <= settings.longest_link * (signs + 1))
        links = row | (F.length(trimmed) <= settings.longest_links) & plain.rlike(LINK_WORDS)
        return (trimmed != "") & (no_end | marked | links | _bind(plain, phrases))

    return _bind(F.btrim(line, F.lit(SPACE)), rules)


def clean(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with the counts, the verdicts and the cleaned text; only ``text`` is read for them.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that
    equal an earlier one), n_repeat_words, base_failed (too few words or too many repeated),
    n_lines (with a word), n_failed_lines, kept_chars (word characters of the lines that stay),
    cleaned (those lines and the empty ones), kept.

    A null text counts as an empty one, whose ``cleaned`` is empty; it fails by its number of
    words, as does a text without words. Rows are judged one by one, so repeated rows and ids get
    equal results, rows without id are judged like others, and an empty table gives no rows.
    Columns of the input with one of these names are replaced. A very long text is taken whole,
    in memory that grows with its length (about 100 bytes a word if it repeats a passage).
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in COLUMNS]
    text = F.coalesce(F.col("text"), F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"), repeated_words(words, settings.window).alias("n_repeat_words")
        )

    def of_lines(lines: Column) -> Column:
        worded = F.filter(lines, lambda line: _without(line, SPACE) != "")
        staying = F.filter(lines, lambda line: ~line_fails(line, settings))
        return F.struct(
            _bind(worded, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct"))).alias("worded"),
            _bind(staying, lambda x: F.struct(F.size(x).alias("n"), F.array_join(x, "\n").alias("text"))).alias("staying"),
            F.size(lines).alias("n"),
        )

    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda word: word != "")
    found = docs.select(
        *others,
        _bind(words, of_words).alias("_words"),
        _bind(F.split(text, "\n"), of_lines).alias("_lines"),
        F.length(_without(text, SPACE)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
    )
    n_words, repeated = F.col("_words.n_words"), F.col("_words.n_repeat_words")
    base_failed = (n_words < settings.least_words) | (100 * repeated > settings.most_repeated * n_words)
    kept_chars = F.length(_without(F.col("_lines.staying.text"), SPACE)).cast("long")
    return found.select(
        *others,
        n_words.alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.col("_lines.worded.n") - F.col("_lines.worded.distinct")).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        F.col("_lines.worded.n").cast("long").alias("n_lines"),
        (F.col("_lines.n") - F.col("_lines.staying.n")).cast("long").alias("n_failed_lines"),
        kept_chars.alias("kept_chars"),
        F.col("_lines.staying.text").alias("cleaned"),
        (~base_failed & (100 * kept_chars >= settings.least_kept * F.col("word_chars"))).alias("kept"),
    )
