import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF_DIR, awkward, doc, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from stratiform.llm import arrays, files, wavelet
from stratiform.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def plain():
    tool = tokenizers.Tokenizer.from_file(tokenizer_path())
    return lambda text: [*tool.encode(text or "", add_special_tokens=False).ids, wavelet.END_ID]


@pytest.fixture(scope="module")
def encoder():
    return wavelet.Encoder(tokenizer_path())


def expected(rows, plain):
    """Rows by doc_id, null last, then by text."""
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = plain(text)
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])


def test_files_against_the_tokenizer(spark, plain):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for tokens in (wavelet.SHARD_TOKENS, 5000):
        written = wavelet.write(docs, tokenizer_path(), shard_tokens=tokens)
        assert got(wavelet.read(written)) == expected(rows, plain)
    assert written.shards.count() > 8


TEXTS = st.text(st.one_of(st.sampled_from("aB'sé 1\n\t Σς́"), st.characters(exclude_categories=["Cs"])), max_size=40)
SPECIAL = st.sampled_from(["<|endoftext|>", "<|EndOfText|>", " <|startoftext|>x", "<|"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(TEXTS, SPECIAL, st.tuples(TEXTS, SPECIAL, TEXTS).map("".join)), max_size=5))
def test_words_are_encoded_as_in_whole_texts(encoder, plain, texts):
    ids, ends = encoder.encode(arrays.texts(pa.array(texts, pa.string())))
    assert [part.tolist() for part in np.split(ids, ends)[: len(texts)]] == [plain(t) for t in texts]


def test_forgetting_words_changes_nothing(encoder, plain, monkeypatch):
    monkeypatch.setattr(wavelet, "CACHED_WORDS", 1)
    for text in ("one two three", "two three four", "one two three"):
        ids, _ = encoder.encode(arrays.texts(pa.array([text])))
        assert ids.tolist() == plain(text)


@pytest.mark.parametrize("length", [0, 1, 7, 1000, wavelet.BLOCK_BITS * 2 + 77])
def test_access_count_and_select(length):
    draw = np.random.default_rng(length)
    ids = np.minimum(draw.geometric(0.02, length) * 37, 49407).astype(np.uint32)
    shard = wavelet.Shard(b"".join(wavelet.pack(ids, [5, None], np.array([0, length]), 16)))
    assert (shard.tokens() == ids).all() and shard.doc_null.tolist() == [0, 1]
    for at in draw.integers(0, max(length, 1), 20).tolist() if length else []:
        token = int(ids[at])
        low, high = sorted(draw.integers(0, length + 1, 2).tolist())
        assert shard.access(at) == token
        assert shard.count(token, low, high) == int((ids[low:high] == token).sum())
        places = np.flatnonzero(ids == token)
        assert [shard.select(token, k) for k in (0, len(places) - 1)] == [places[0], places[-1]]
    assert shard.count(49_407 if length < 10 else 3) == 0
    with pytest.raises(IndexError):
        shard.access(length)
    with pytest.raises(IndexError):
        shard.select(3, 0)


def test_awkward_documents(spark, plain):
    rows = got(wavelet.read(wavelet.write(frame(spark), tokenizer_path())))
    want = expected([row[:2] for row in awkward()], plain)
    assert sorted((str(r[0]), r[2], r[3]) for r in rows) == sorted((str(r[0]), r[2], r[3]) for r in want)
    assert [r[0] for r in rows] == [r[0] for r in want]  # null ids last
    starts = np.cumsum([0, *[r[2] for r in rows[:-1]]])
    assert [r[1] for r in rows] == starts.tolist()
    assert wavelet.read(wavelet.write(frame(spark, []), tokenizer_path())).count() == 0
    same = got(wavelet.read(wavelet.write(frame(spark, [doc(1, "b"), doc(1, "a"), doc(1, "b")]), tokenizer_path())))
    again = got(wavelet.read(wavelet.write(frame(spark, [doc(1, "a"), doc(1, "b"), doc(1, "b")]), tokenizer_path())))
    assert same == again


def test_files_of_a_folder(tmp_path):
    for folder in (str(tmp_path / "a"), f"file://{tmp_path}/b", f"file:{tmp_path}/c"):
        name = files.write_file(folder, "x", [b"ab", b"cd"])
        assert files.read_file(folder, name) == b"abcd"
        assert files.mapped(folder, name, np.uint8).tolist() == list(b"abcd")
    with pytest.raises(ValueError):
        wavelet.Shard(b"something else, long enough to have a head")
