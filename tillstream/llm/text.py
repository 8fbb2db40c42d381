"""Words and their hashes, for whole batches of texts at once.

The operators of this package read texts as Arrow batches, cut them into pieces of a few megabytes, and work on the
UTF-8 bytes of all texts of a piece together. A word is known by a 64-bit hash of its bytes; equal words have equal
hashes, and two different words of a corpus of a billion different words share one with a probability of about 3 %. Words of
up to eight bytes and equal length never do; those of more than LONG_WORD bytes have a cryptographic hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are worked on together. A longer text makes a piece of its own.
PIECE_BYTES = 2 << 20

_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[ord("A") : ord("Z") + 1] += 32


def _byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of a word in lower case: all but ``[\x00-\x2F\x3A-\x60\x7B-\x7F]``.
LETTERS = ~_byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: A-Z, for words of texts that are not in lower case.
UPPER = _byte_set((0x41, 0x5A))
#: Bytes of a word between blanks: all but ``[\x20\x09-\x0D]``.
PRINTED = ~_byte_set((0x20, 0x20), (0x09, 0x0D))

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A fixed random number for each byte.
_OF_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept, since every piece needs them, unless a text is huge."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        kept = np.full(max(n, PIECE_BYTES + 1), base, dtype=np.uint64)
        kept[0] = 1
        kept = np.cumprod(kept, dtype=np.uint64)
        if len(kept) <= 2 * PIECE_BYTES:
            _powers[base] = kept
    return kept[:n]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    out = values ^ (values >> np.uint64(32))
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


class StretchHashes:
    """Hashes of any stretches of random numbers, by differences of prefix sums."""

    def __init__(self, values: np.ndarray):
        terms = values * _power(_BASE, len(values))
        self._sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(terms, out=self._sums[1:])
        self._back = _power(_INVERSE, len(values) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._sums[end] - self._sums[start]) * self._back[start] + (end - start).astype(np.uint64))


class ByteHashes(StretchHashes):
    """Hashes of any stretches of a buffer of bytes."""

    def __init__(self, data: np.ndarray):
        super().__init__(_OF_BYTE[data])


#: Bytes of a word that are hashed eight at a time.
LONG_WORD = 32

_STEPS = np.random.Generator(np.random.PCG64(17)).integers(1, 1 << 62, LONG_WORD // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The first k of eight bytes, in the order of memory.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def hashes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each stretch of the bytes."""
    size = end - start
    out = mixed(size.astype(np.uint64))
    if not len(size):
        return out
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    # The eight bytes from any place on, as a number.
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    for step, factor in zip(range(0, LONG_WORD, 8), _STEPS, strict=True):
        some = np.flatnonzero(size > step) if step else slice(None)
        bytes_ = eight[start[some] + step] & _FIRST[np.minimum(size[some] - step, 8)]
        out[some] = mixed((out[some] ^ bytes_) * factor)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        own = hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest()
        out[i] = int.from_bytes(own, "little")
    return out


@dataclass
class Texts:
    """Texts end to end: text i is ``data[offset[i]:offset[i + 1]]``."""

    data: np.ndarray
    offset: np.ndarray

    def __len__(self) -> int:
        return len(self.offset) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offset[i] : self.offset[i + 1]].tobytes()

    def lower(self) -> Texts:
        """The texts with A-Z in lower case."""
        return Texts(_UPPER[self.data], self.offset)


@dataclass
class Words:
    """The words of texts: word j is ``data[start[j]:end[j]]``, and text i has the words ``first[i]:first[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def texts_of(column: pa.Array, lower: bool = False) -> Texts:
    """The UTF-8 bytes of a string column. Null is an empty text. ``lower`` lower-cases A-Z alone."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    offset = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return Texts(np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64))
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer else np.zeros(0, dtype=np.uint8)
    data = data[offset[0] : offset[-1]]
    return Texts(_UPPER[data] if lower else data, offset - offset[0])


def words_of(texts: Texts, letters: np.ndarray, hashed: bool = True) -> Words:
    """Maximal runs of the bytes in ``letters``, within each text."""
    data, offset = texts.data, texts.offset
    inside = letters[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[offset[:-1][offset[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[offset[1:][offset[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    codes = hashes_of(data, start, end) if hashed else np.zeros(0, dtype=np.uint64)
    return Words(start, end, np.searchsorted(start, offset), codes)


#: Odd multipliers for the words of a shingle, by place.
_PLACE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles_of(codes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each ``size`` consecutive words, whatever text they are in."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = codes[:n] * _PLACE[0]
    for place in range(1, size):
        total += codes[place : place + n] * _PLACE[place]
    return mixed(total)


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of about ``limit`` bytes of text; at least one row each, and none lost."""
    for batch in batches:
        sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, cast to the given types. Other columns may have any names, also equal ones."""
    names = [f"_{i}" for i in range(len(df.columns))]
    chosen = [F.col(names[df.columns.index(name)]).cast(kind).alias(name) for name, kind in columns.items()]
    return df.toDF(*names).select(*chosen)


def documents(df: DataFrame) -> DataFrame:
    return pick(df, doc_id="bigint", text="string")


def per_piece(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, limit: int = PIECE_BYTES
) -> DataFrame:
    """``work`` on every piece of the rows; ``df`` has a column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=limit):
            yield work(piece)

    return df.mapInArrow(run, schema)


def by_place(df: DataFrame) -> DataFrame:
    """The same rows with columns named by place, but for ``doc_id``, ``text`` and ``n_chars``.

    So other columns may have any names, also those that an operator uses itself.
    """
    names = [f"_{i}" for i in range(len(df.columns))]
    for known in ("doc_id", "text", "n_chars"):
        if known in df.columns:
            names[df.columns.index(known)] = known
    return df.toDF(*names)


def rewritten(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], limit: int = PIECE_BYTES
) -> DataFrame:
    """``work`` on every piece of the rows with all their columns, named by place, giving rows of the same columns."""
    inner = by_place(df)
    return per_piece(inner, work, inner.schema, limit).toDF(*df.columns)


def with_texts(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
    """The rows with these texts, and with ``n_chars`` counted anew where there is such a column."""
    column = pa.array(texts, pa.binary()).cast(batch.schema.field("text").type)
    columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"text": column}
    if "n_chars" in columns:
        columns["n_chars"] = pc.utf8_length(column).cast(batch.schema.field("n_chars").type)
    return pa.RecordBatch.from_arrays([columns[name] for name in batch.schema.names], schema=batch.schema)


def lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """Lists of ``counts`` values each."""
    offset = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offset), values)
