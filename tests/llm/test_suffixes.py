import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tillstream.llm.doubling import sliding_minimum
from tillstream.llm.fm_index import FMIndex
from tillstream.llm.suffixes import Suffixes, covered, runs

sequences = st.lists(st.lists(st.integers(0, 2), max_size=14), min_size=1, max_size=4)


def keyed(parts):
    owner = np.repeat(np.arange(len(parts)), [len(part) for part in parts])
    values = np.array([value for part in parts for value in part], dtype=np.int64)
    end = np.cumsum([len(part) for part in parts])[owner] if len(owner) else np.zeros(0, dtype=np.int64)
    return owner * 10 + values, end


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@settings(max_examples=200)
@given(sequences, st.integers(1, 4))
def test_longest_repeats(parts, least):
    keys, end = keyed(parts)
    found = Suffixes(keys, end).longest_repeats(least).tolist()
    expected = []
    for part in parts:
        for i in range(len(part)):
            best = max((common(part[i:], part[j:]) for j in range(len(part)) if j != i), default=0)
            expected.append(best if best >= least else 0)
    assert found == expected


@given(sequences)
def test_order(parts):
    keys, end = keyed(parts)
    order = Suffixes(keys, end).order.tolist()
    assert order == sorted(range(len(keys)), key=lambda i: keys[i : end[i]].tolist())


def test_long_periods():
    keys = np.tile([1, 2, 3], 5000)
    longest = Suffixes(keys, np.full(len(keys), len(keys))).longest_repeats(3)
    assert longest[0] == len(keys) - 3 and longest[-3] == 3 and longest[-1] == 0


@given(st.lists(st.booleans(), max_size=30), st.sets(st.integers(0, 30)))
def test_runs(mask, breaks):
    start, end = runs(np.array(mask, dtype=bool), np.array(sorted(breaks), dtype=np.int64))
    found = set()
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        assert all(mask[a:b]) and not any(a < cut < b for cut in breaks)
        assert a == 0 or not mask[a - 1] or a in breaks
        found |= set(range(a, b))
    assert found == {i for i, value in enumerate(mask) if value}


def test_covered():
    assert covered(np.array([1, 2, 6]), np.array([3, 4, 7]), 8).tolist() == [False, True, True, True, False, False, True, False]


@settings(max_examples=150)
@given(
    st.lists(st.integers(0, 3), min_size=1, max_size=40),
    st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=4), min_size=1, max_size=6),
    st.integers(1, 5),
)
def test_fm_index_finds_every_occurrence(text, patterns, sample):
    index = FMIndex(np.array(text, dtype=np.int64), 3, sample)
    width = max(map(len, patterns))
    table = np.array([[0] * (width - len(p)) + p for p in patterns])
    low, high = index.search(table, np.array([len(p) for p in patterns]))
    for pattern, a, b in zip(patterns, low.tolist(), high.tolist(), strict=True):
        found = sorted(index.locate(np.arange(a, b)).tolist())
        assert found == [i for i in range(len(text)) if text[i : i + len(pattern)] == pattern]


@given(st.lists(st.integers(0, 9), max_size=40), st.integers(1, 10))
def test_sliding_minimum(values, width):
    found = sliding_minimum(np.array(values, dtype=np.uint64), width).tolist()
    assert found == [min(values[i : i + width]) for i in range(len(values) - width + 1)]
