import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from tillstream.llm.packing import whole_groups
from tillstream.llm.text import LETTERS, PRINTED, hashes_of, pieces, shingles_of, texts_of, words_of

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
some_texts = st.lists(st.none() | st.text(st.sampled_from("aAbZ09 \t\n\x0b\r.-éÄ🙂  \x00~"), max_size=30), max_size=6)


@given(some_texts, st.booleans())
def test_words(values, lower):
    texts = texts_of(pa.array(values, pa.string()), lower=lower)
    plain = [(value or "").translate(UPPER) if lower else value or "" for value in values]
    for letters, pattern in ((LETTERS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (PRINTED, r"[^\x20\x09-\x0D]+")):
        if letters is LETTERS and not lower:
            continue
        words = words_of(texts, letters)
        expected = [re.findall(pattern, value) for value in plain]
        found = [texts.data[a:b].tobytes().decode() for a, b in zip(words.start, words.end, strict=True)]
        assert found == [word for own in expected for word in own]
        assert words.counts.tolist() == [len(own) for own in expected]
        by_word = {}
        for word, code in zip(found, words.hash.tolist(), strict=True):
            assert by_word.setdefault(word, code) == code
        assert len(set(by_word.values())) == len(by_word)


@given(st.lists(st.integers(0, 3), max_size=12), st.integers(1, 5))
def test_shingles_are_equal_exactly_if_their_words_are(values, size):
    codes = shingles_of(np.array(values, dtype=np.uint64) + np.uint64(12345), size).tolist()
    expected = [tuple(values[i : i + size]) for i in range(len(values) - size + 1)]
    assert len(codes) == len(expected)
    assert all((codes[i] == codes[j]) == (expected[i] == expected[j]) for i in range(len(codes)) for j in range(len(codes)))


@given(some_texts, st.integers(1, 40))
def test_pieces_lose_nothing(values, limit):
    batch = pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(range(len(values)))], ["text", "i"])
    cut = list(pieces([batch], limit=limit))
    assert [value for piece in cut for value in piece.column("text").to_pylist()] == values
    assert all(len(piece) == 1 or sum(len((v or "").encode()) for v in piece.column(0).to_pylist()) <= limit for piece in cut)


@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 30), max_size=5))
def test_groups_stay_whole(keys, cuts):
    keys = sorted(keys)
    rows = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(range(len(keys)), pa.int64())], ["k", "i"])
    ends = sorted({min(cut, len(keys)) for cut in cuts} | {0, len(keys)})
    batches = [rows.slice(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]
    groups = list(whole_groups(batches, ["k"]))
    assert [i for group in groups for i in group.column("i").to_pylist()] == list(range(len(keys)))
    seen = [set(group.column("k").to_pylist()) for group in groups]
    assert all(not a & b for n, a in enumerate(seen) for b in seen[:n])


def test_long_words_that_fool_polynomials():
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2 ** 64, whatever the base."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    for size in (1024, 2048):
        pair = ["".join("ab"[b ^ flip] for b in bits[:size]) for flip in (0, 1)]
        words = words_of(texts_of(pa.array(pair)), LETTERS)
        assert len(words.hash) == 2 and words.hash[0] != words.hash[1]


@given(st.lists(st.binary(max_size=70), max_size=20))
def test_hashes_differ_exactly_where_bytes_do(values):
    data = np.frombuffer(b"".join(values), dtype=np.uint8)
    end = np.cumsum([len(value) for value in values], dtype=np.int64)
    start = end - np.array([len(value) for value in values], dtype=np.int64)
    codes = hashes_of(data, start, end).tolist()
    assert all((codes[i] == codes[j]) == (values[i] == values[j]) for i in range(len(values)) for j in range(i))
