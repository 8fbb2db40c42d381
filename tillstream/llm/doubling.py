"""Removal of repeated byte strings by distributed prefix doubling.

A position's rank for a length says which of the strings of that length begins there. Ranks of twice the length come
from sorting pairs of ranks: that of a position, and that of the position one length further on. Positions whose string
is unique drop out on the way, and most do so at the first step, without ever being a row:

1. **Anchors.** Of the 24-byte strings in any 100 bytes, the one of the smallest hash is their anchor; it depends on these
   bytes alone, so equal 100-byte strings have equal anchors at equal offsets. Consecutive starts with the same anchor, in
   the same half of the string, make a run. All strings of a run have 62 bytes in common, the core: the anchor and what
   follows it, or what is in front of it. Spark sorts the runs by two ranks, that of the core and that of all bytes of the
   run. A run that equals an earlier one is repeated as a whole. A run whose core no other run has is unique. What is left
   are runs with the same core in different surroundings: the edges of repeated passages.
2. **Positions.** For each start in those, Spark sorts the pair of its ranks at 50 bytes: its own, and that of the start
   50 bytes on. Equal pairs are equal strings of 100 bytes, the threshold; all but the earliest are repeated.

Ranks are 64-bit hashes of the bytes, which takes no sorting; a pair has 128 bits. Each task first merges what its own rows
repeat, so that a string that is in a third of all texts makes one row per few megabytes of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm.packing import document_keys, packed, per_unpacked
from tillstream.llm.ranges import dealt
from tillstream.llm.suffixes import covered, runs
from tillstream.llm.tables import free_shuffles, written
from tillstream.llm.text import ByteHashes, Texts, lists, mixed, texts_of

#: Bytes of a string that may stand once only.
LENGTH = 100
#: Bytes of an anchor.
ANCHOR = 24

_LOW = np.uint64(0xFFFFFFFF)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: ``spot`` has a start and, in its low bits, how many starts of a run there are; none for a stretch that is certain.
_ROWS = "a bigint, b bigint, place bigint, code bigint, spot bigint"
_COUNT_BITS = 16


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values, by minima from both ends of blocks of that width."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    blocks = -(-len(values) // width)
    filled = np.full(blocks * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    filled[: len(values)] = values
    table = filled.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _runs(texts: Texts, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Per run: text, first start, number of starts, and the two ranks."""
    n = len(texts.data)
    if n < length:
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),) * 2
    hashes = ByteHashes(texts.data)
    at = np.arange(n - anchor + 1)
    rank = hashes.of(at, at + anchor)
    # The hash's upper half, then the place: the leftmost of equal ones is the smallest.
    least = sliding_minimum((rank & ~_LOW) | at.astype(np.uint64), length - anchor + 1)
    owner = np.repeat(np.arange(len(texts)), np.maximum(0, np.diff(texts.offset) - length + 1))
    sizes = np.maximum(0, np.diff(texts.offset) - length + 1)
    first = np.repeat(texts.offset[:-1] - (np.cumsum(sizes) - sizes), sizes)
    start = np.arange(len(owner)) + first  # all starts of strings within one text
    place = (least[start] & _LOW).astype(np.int64)
    head = np.ones(len(start), dtype=bool)
    head[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(head)
    count = np.diff(np.append(begin, len(start)))
    start, owner, place = start[begin], owner[begin], place[begin]
    # The two halves of a run, by where the anchor is in the string; either may be empty.
    half = (length - anchor) // 2
    cut = np.clip(place - half, start, start + count)
    parts = []
    for first, last, low, high in (
        (start, cut, place - half - 1, place + anchor),
        (cut, start + count, place, place + length - half),
    ):
        some = np.flatnonzero(last > first)
        first, last = first[some], last[some]
        core = hashes.of(low[some], high[some])
        # The same bytes with the anchor elsewhere in them are another run.
        whole = mixed(hashes.of(first, last - 1 + length) + (place[some] - first).astype(np.uint64) * _BASE)
        parts.append((owner[some], first - texts.offset[owner[some]], last - first, core, whole))
    return tuple(np.concatenate(column) for column in zip(*parts, strict=True))


def _spots(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (start << _COUNT_BITS) | count


def _first_of_each(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by all keys, and for each row in it the index in that order of the first row with its first two."""
    order = np.lexsort(keys[::-1])
    a, b = (key[order] for key in keys[:2])
    head = np.ones(len(order), dtype=bool)
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))


def _merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray, texts: Texts) -> tuple[np.ndarray, ...]:
    """Stretches of texts, those that overlap or touch made one: text, start, end."""
    base = texts.offset[owner]
    mask = covered(base + start, base + end, len(texts.data))
    first, last = runs(mask, texts.offset[:-1])
    owner = np.searchsorted(texts.offset, first, side="right") - 1
    # Empty texts begin where the next one does; the last of equal offsets is the one with bytes.
    return owner, first - texts.offset[owner], last - texts.offset[owner]


def _local(
    texts: Texts, place: np.ndarray, code: np.ndarray, a: np.ndarray, b: np.ndarray, owner: np.ndarray,
    start: np.ndarray, count: np.ndarray, length: int,
) -> pa.RecordBatch:
    """Rows of a piece: the first of each pair of ranks, and what certainly repeats, with no starts and the end as b."""
    a, b = a.view(np.int64), b.view(np.int64)
    order, first = _first_of_each(a, b, place[owner], code[owner], start)
    own = np.arange(len(order))
    head = order[first]
    later = owner[order] != owner[head]
    # Rows that repeat id and text are one document.
    later &= (place[owner[order]] != place[owner[head]]) | (code[owner[order]] != code[owner[head]])
    later |= start[order] != start[head]
    kept = order[first == own]
    again = order[later]
    o, s, e = _merged(owner[again], start[again], start[again] + count[again] - 1 + length, texts)
    # What is certain goes along under a rank of its own.
    tag = mixed(code[o].view(np.uint64) * _BASE + s.astype(np.uint64)).view(np.int64)
    columns = [
        np.concatenate([a[kept], tag]),
        np.concatenate([b[kept], e]),
        np.concatenate([place[owner[kept]], place[o]]),
        np.concatenate([code[owner[kept]], code[o]]),
        np.concatenate([_spots(start[kept], count[kept]), _spots(s, np.zeros(len(o), dtype=np.int64))]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(column) for column in columns], ["a", "b", "place", "code", "spot"])


def _sorted_runs(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(piece.column("text"))
        owner, start, count, a, b = _runs(texts, length, anchor)
        place, code = document_keys(piece.column("doc_id"), texts)
        return _local(texts, place, code, a, b, owner, start, count, length)

    # By ranges of both ranks: a core with very many surroundings is split like all the rest.
    return dealt(docs, work, _ROWS, ("a", "b"), ["a", "b", "place", "code", "spot"])


def _judged(rows: DataFrame, length: int, edges: bool) -> DataFrame:
    """From sorted rows: the stretches that repeat (``end`` set), and, with ``edges``, the runs whose core stands in
    different surroundings (``n`` set).

    A group of equal pairs lies in one partition; its first row is carried from batch to batch. Whether a core has other
    surroundings is not known where its rows are cut off; then the run counts as an edge, which costs a few rows and
    changes no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: tuple[int, ...] | None = None
        names = ["place", "code", "start", "end", "n"]
        for batch in batches:
            if not len(batch):
                continue
            a, b, place, code, spot = (batch.column(i).to_numpy() for i in range(5))
            start, count = spot >> _COUNT_BITS, spot & ((1 << _COUNT_BITS) - 1)
            certain = count == 0
            ends = [(place[certain], code[certain], start[certain], b[certain])]
            a, b, place, code, start, count = (column[~certain] for column in (a, b, place, code, start, count))
            edge = np.zeros(0, dtype=np.int64)
            if len(a):
                head = np.ones(len(a), dtype=bool)
                head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                follows = carried is not None and carried[:2] == (a[0], b[0])
                first = np.maximum.accumulate(np.where(head, np.arange(len(a)), 0))
                of = [column[first] for column in (place, code, start)]
                if follows:
                    for column, value in zip(of, carried[2:], strict=True):
                        column[first == 0] = value
                    head[0] = False
                again = (place != of[0]) | (code != of[1]) | (start != of[2])
                ends.append((place[again], code[again], start[again], (start + count - 1 + length)[again]))
                carried = (a[-1], b[-1], *(column[-1] for column in of))
                if edges:
                    at = np.flatnonzero(head)
                    cores = a[at]
                    alone = np.ones(len(at), dtype=bool)
                    alone[1:] &= cores[1:] != cores[:-1]
                    alone[:-1] &= cores[1:] != cores[:-1]
                    # The cores at either end of the batch may have more rows outside.
                    alone &= (cores != a[0]) & (cores != a[-1])
                    edge = at[~alone]
            stretches = [np.concatenate(columns) for columns in zip(*ends, strict=True)]
            none = pa.nulls(len(stretches[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in stretches), none], names)
            if len(edge):
                none = pa.nulls(len(edge), pa.int64())
                columns = [*(pa.array(column[edge]) for column in (place, code, start)), none, pa.array(count[edge])]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, "place bigint, code bigint, start bigint, end bigint, n bigint")


def _by_document(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows of each document as one list: (start, value) pairs."""
    rows = rows.select("place", "code", F.struct("start", *columns).alias("part"))
    return rows.groupBy("place", "code").agg(F.collect_list("part").alias("parts"))


def _parts(column: pa.Array, field: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and value of the pairs in a column of lists; null is an empty list."""
    counts = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = column.flatten()
    return (
        np.repeat(np.arange(len(column)), counts),
        flat.field("start").to_numpy(zero_copy_only=False),
        flat.field(field).to_numpy(zero_copy_only=False),
    )


def _sorted_positions(docs: DataFrame, edges: DataFrame, length: int) -> DataFrame:
    """Each start of the edge runs with its ranks at half the length, there and half the length further on."""
    half = length // 2

    def work(piece: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        row, start, count = _parts(piece.column("parts"), "n")
        ends = np.cumsum(count)
        start = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + count, count)
        owner = np.repeat(row, count)
        hashes = ByteHashes(texts.data)
        at = start + texts.offset[owner]
        a, b = hashes.of(at, at + half), hashes.of(at + half, at + length)
        one = np.ones(len(start), dtype=np.int64)
        place, code = piece.column("place").to_numpy(), piece.column("code").to_numpy()
        return _local(texts, place, code, a, b, owner, start, one, length)

    texts = packed(docs).join(_by_document(edges, "n").hint("merge"), ["place", "code"])
    rows = per_unpacked(texts.select("place", "code", "size", "packed", "parts"), work, _ROWS, 2 << 20)
    return rows.repartition("a", "b").sortWithinPartitions("a", "b", "place", "code", "spot")


def repeated(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """The stretches to remove, as place, code, start, end; they may overlap."""
    judged = written(_judged(_sorted_runs(docs, length, anchor), length, edges=True))
    free_shuffles(docs.sparkSession)
    edges = judged.filter("n is not null")
    positions = _judged(_sorted_positions(docs, edges, length), length, edges=False)
    found = written(judged.unionAll(positions).filter("end is not null").select("place", "code", "start", "end"))
    free_shuffles(docs.sparkSession)
    return found


def deduplicated(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Per document what is left without the byte strings that stand earlier too: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, spans.

    A byte goes if a ``length``-byte string that covers it begins earlier too: in a document of smaller id, or further to
    the front of the same one. ``spans`` are the removed stretches, in bytes.

    One row per row. Null and empty texts have nothing to remove. A missing id counts as larger than all others (than 2 ** 62
    at least); among texts that share an id or have none, one goes before the other by a hash; rows that repeat id and text are one document, and each
    gets its result. Texts of any length are read whole. An empty table gives an empty one. Other columns are ignored.
    """

    def work(piece: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        row, start, end = _parts(piece.column("parts"), "end")
        owner, start, end = _merged(row, start, end, texts)
        keep = ~covered(texts.offset[owner] + start, texts.offset[owner] + end, len(texts.data))
        sums = np.concatenate([[0], np.cumsum(keep)])[texts.offset]
        data = texts.data[keep].tobytes()
        n = np.bincount(owner, minlength=len(piece))
        spans = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["first_byte", "end_byte"])
        return pa.RecordBatch.from_arrays(
            [
                piece.column("doc_id"),
                piece.column("size"),
                pa.array(np.diff(texts.offset) - np.diff(sums)),
                pa.array(n.astype(np.int64)),
                pa.array([hashlib.sha256(data[i:j]).hexdigest() for i, j in zip(sums[:-1], sums[1:], strict=True)]),
                lists(spans, n),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )

    found = _by_document(repeated(docs, length, anchor), "end")
    rows = packed(docs).join(found.hint("merge"), ["place", "code"], "left").select("doc_id", "size", "packed", "parts")
    schema = (
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string,"
        " spans array<struct<first_byte: bigint, end_byte: bigint>>"
    )
    return per_unpacked(rows, work, schema, 2 << 20)
