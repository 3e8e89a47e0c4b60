import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from helpers import LONG, ONE_WORD, words

from stratiform.llm import arrays

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbBé \t\n\x1c\x85Z", max_size=30)), max_size=8)


def split(found, batch):
    out = [[] for _ in range(len(batch.offsets) - 1)]
    for a, b, k in zip(found.start, found.end, found.doc, strict=True):
        out[k].append(bytes(batch.data[a:b]).decode())
    return out


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    batch = arrays.texts(pa.array(texts, pa.string()))
    found = arrays.words(batch)
    low = [[w.translate(str.maketrans("ABZ", "abz")) for w in part] for part in split(found, batch)]
    assert low == [words(t) for t in texts]
    by_word = {}
    for word, value in zip([w for part in low for w in part], found.hash.tolist(), strict=True):
        assert by_word.setdefault(word, value) == value
    assert len(set(by_word.values())) == len(by_word)


def test_hashes_do_not_depend_on_pieces_or_place():
    batch = arrays.texts(pa.array(["tail " + LONG, ONE_WORD + " " + ONE_WORD, "tail"]))
    found = arrays.words(batch)
    hashes = [found.hash[found.doc == k] for k in range(3)]
    assert hashes[0][0] == hashes[2][0]
    assert hashes[1][0] == hashes[1][1]
    assert len(np.unique(hashes[0])) == 5


def test_slices_hold_whole_texts_once():
    batch = arrays.texts(pa.array(["", "abc", None, "d" * 50, "", "ef"]))
    parts = list(arrays.slices(batch, 8))
    assert [(a, b) for a, b, _ in parts][0][0] == 0 and parts[-1][1] == 6
    assert b"".join(p.data.tobytes() for _, _, p in parts) == batch.data.tobytes()


def test_sliced_and_chunked_columns():
    column = pa.chunked_array([["a b", "c"], ["d", None]])
    assert len(arrays.words(arrays.texts(column.slice(1, 3))).hash) == 2
    assert len(arrays.words(arrays.texts(pa.array([], pa.string()))).hash) == 0


def test_members_and_sums():
    keys = np.unique(arrays.mix(np.arange(500, dtype=np.uint64)))
    asked = arrays.mix(np.arange(250, 1500, dtype=np.uint64))
    at, place = arrays.Members(keys, 8).find(asked)
    assert at.tolist() == list(range(250)) and (keys[place] == asked[at]).all()
    found = arrays.add_up(np.array([3, 1, 3], np.uint64), np.array([1, 5, 2]))
    assert found[0].tolist() == [1, 3] and found[1].tolist() == [5, 3]
