"""Documents as they travel between tasks: compressed texts, found by id and hashes of the text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm.tables import content_key
from tillstream.llm.text import Texts, documents, per_piece, texts_of

#: From here on are the places of documents without id, in an order of their texts.
NO_ID = 1 << 62

PACKED = "place bigint, code bigint, doc_id bigint, size bigint, packed binary"

#: As Spark's ``xxhash64`` begins, and as it goes on behind the first column of ``tables.content_key``'s second hash.
_SEED = 42
_SECOND = xxhash.xxh64_intdigest(b"content", seed=_SEED)


def document_keys(ids: pa.Array, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Place and code of each document: by the places they are ordered, and the two together tell them apart.

    The place is the id, the code a 64-bit hash of the text. Without id the place is 62 bits of another hash.
    """
    known = np.asarray(ids.is_valid())
    place = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    code = np.empty(len(texts), dtype=np.uint64)
    for i, (a, b) in enumerate(zip(texts.offset[:-1].tolist(), texts.offset[1:].tolist(), strict=True)):
        code[i] = xxhash.xxh64_intdigest(texts.data[a:b], seed=_SEED)
        if not known[i]:
            place[i] = NO_ID | xxhash.xxh64_intdigest(texts.data[a:b], seed=_SECOND) >> 2
    return place, code.view(np.int64)


def placed(docs: DataFrame) -> DataFrame:
    """The rows, with columns ``doc_id`` and ``text``, with their place and code."""
    code, second = content_key(F.coalesce(F.col("text").cast("string"), F.lit("")))
    without = F.shiftrightunsigned(second, 2).bitwiseOR(F.lit(NO_ID))
    return docs.withColumn("place", F.coalesce(F.col("doc_id").cast("bigint"), without)).withColumn("code", code)


def packed(docs: DataFrame, once: bool = False) -> DataFrame:
    """Per row its place and code, its id, the size of its text in bytes, and the text
    compressed. Null is an empty text. With ``once``, rows that repeat id and text are left out within each piece; others may
    stay, so what is done with the rows must not depend on them.

    What is joined with the rows is merged at any size: there may be as much of it as documents, and a task that unpacked the
    rows it has just packed would keep two Python workers.
    """

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(piece.column("text"))
        place, code = document_keys(piece.column("doc_id"), texts)
        at = np.arange(len(texts))
        if once:
            order = np.lexsort((code, place))
            again = (np.diff(place[order]) == 0) & (np.diff(code[order]) == 0)
            at = np.sort(order[np.append([True] * min(1, len(order)), ~again)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(place[at]),
                pa.array(code[at]),
                piece.column("doc_id").take(pa.array(at)),
                pa.array(np.diff(texts.offset)[at]),
                pack(texts.raw(i) for i in at.tolist()),
            ],
            ["place", "code", "doc_id", "size", "packed"],
        )

    return per_piece(documents(docs), work, PACKED)


def pack(values: Iterable[bytes | np.ndarray]) -> pa.Array:
    press = zstandard.ZstdCompressor(level=1, write_checksum=False).compress
    return pa.array([press(value) for value in values], pa.binary())


def unpack(values: Iterable[bytes]) -> Texts:
    press = zstandard.ZstdDecompressor().decompress
    raw = [press(value) for value in values]
    offset = np.concatenate([[0], np.cumsum([len(value) for value in raw])]).astype(np.int64)
    return Texts(np.frombuffer(b"".join(raw), dtype=np.uint8), offset)


def per_unpacked(
    df: DataFrame, work: Callable[[pa.RecordBatch, Texts], pa.RecordBatch], schema: str, limit: int
) -> DataFrame:
    """``work`` on pieces of rows with ``packed`` and ``size`` columns, given the texts too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column("size").to_numpy())
            start = 0
            while start < len(ends):
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
                piece = batch.slice(start, stop - start)
                yield work(piece, unpack(piece.column("packed").to_pylist()))
                start = stop

    return df.mapInArrow(run, schema)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, cut anew so that no group of equal keys is split. A group is held in memory."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(key).to_numpy(zero_copy_only=False) for key in keys]
        same = np.ones(len(batch), dtype=bool)
        for column in columns:
            same &= column == column[-1]
        cut = len(batch) - int(np.argmin(same[::-1])) if not same.all() else 0
        if held and any(held[-1].column(key)[0] != batch.column(key)[0] for key in keys):
            if cut == 0:  # the whole batch is one new group
                yield _joined(held)
                held = [batch]
                continue
        if cut == 0:
            held.append(batch)
            continue
        held.append(batch.slice(0, cut))
        yield _joined(held)
        held = [batch.slice(cut)]
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)

