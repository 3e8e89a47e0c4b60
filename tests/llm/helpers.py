"""Documents with every awkward case, and plain rules to check operators against."""

import re

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Names that operators use themselves.
    "score string, predicted string, band string, size string, copies string, n string, node string, place string"
)
CLASH = ("x",) * 8


def words(text):
    return WORD.findall((text or "").translate(_LOWER))


def doc(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), *CLASH)


LONG = "Étude " + "word another third " * 60_000  # over a megabyte
ONE_WORD = "x" * 700_000


def awkward():
    """Nulls, empty and very long texts, a giant word, ties, repeated rows."""
    return [
        doc(1, "The quick brown fox jumps over the lazy dog near the river bank"),
        doc(2, None, None, None),
        doc(3, ""),
        doc(4, " \t\n\x0b\x0c\r "),
        doc(5, LONG),
        doc(6, ONE_WORD, None, "s"),
        doc(7, "the QUICK brown fox jumps over the lazy dog near the river bank", "en", None),
        doc(8, "one two"),
        doc(8, "one two"),
        doc(8, "three four five six seven eight", "fr", "t"),
        doc(None, "no id here", "en", "t"),
        doc(None, None, None, None),
        doc(9, "12 34 !! \U0001f44d <|endoftext|> \\ <|im_end|>", "de", ""),
        doc(10, "ß é ñ İ ﬁ", "de", "=s"),
    ]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
