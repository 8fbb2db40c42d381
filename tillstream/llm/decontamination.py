"""Benchmark decontamination by an FM-index of each piece of the training texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm.fm_index import FMIndex
from tillstream.llm.suffixes import covered, runs
from tillstream.llm.text import (
    LETTERS,
    Texts,
    Words,
    documents,
    lists,
    per_piece,
    pick,
    rewritten,
    texts_of,
    with_texts,
    words_of,
)

SCHEMA = (
    "doc_id bigint, n_words bigint, n_hit bigint, items array<bigint>,"
    " spans array<struct<first_byte: bigint, end_byte: bigint>>"
)

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text that are searched for together, and the most there may be: the phrases go to every executor.
BLOCK_BYTES = 8 << 20
MAX_BENCHMARK_BYTES = 256 << 20
#: Bytes of training text in one index.
SHARD_BYTES = 4 << 20


@dataclass
class Phrases:
    """A block of test phrases: distinct windows as numbers of words, and the items that each belongs to."""

    vocabulary: np.ndarray
    patterns: np.ndarray
    lengths: np.ndarray
    first_item: np.ndarray
    items: np.ndarray


def _phrases(rows: list[tuple[int | None, str]], window: int) -> Phrases | None:
    words = words_of(texts_of(pa.array([text for _, text in rows], pa.string()), lower=True), LETTERS)
    vocabulary, number = np.unique(words.hash, return_inverse=True)
    found: dict[tuple[int, ...], set[int]] = {}
    for i, (item, _) in enumerate(rows):
        own = number[words.first[i] : words.first[i + 1]] + 1
        for start in range(max(1, len(own) - window + 1) if len(own) else 0):
            found.setdefault(tuple(own[start : start + window].tolist()), set()).update(() if item is None else (item,))
    if not found:
        return None
    patterns = np.zeros((len(found), window), dtype=np.int64)
    for i, values in enumerate(found):
        patterns[i, window - len(values) :] = values
    counts = [len(items) for items in found.values()]
    return Phrases(
        vocabulary,
        patterns,
        np.array([len(values) for values in found]),
        np.concatenate([[0], np.cumsum(counts)]),
        np.array([item for items in found.values() for item in sorted(items)], dtype=np.int64),
    )


def phrase_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[Broadcast]:
    """The benchmark's windows in broadcast blocks of bounded size.

    A benchmark is a stated set of queries. One of more than 256 MB is refused, since it would not fit the executors.
    """
    rows = pick(benchmark, item_id="bigint", text="string").filter(F.col("text").isNotNull())
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > MAX_BENCHMARK_BYTES:
        raise ValueError(f"the benchmark has {size} bytes of text; at most {MAX_BENCHMARK_BYTES} can be searched for")
    blocks: list[list[tuple[int | None, str]]] = [[]]
    filled = 0
    for row in rows.toLocalIterator():
        if filled > block_bytes:
            blocks.append([])
            filled = 0
        blocks[-1].append((row[0], row[1]))
        filled += len(row[1])
    made = [phrases for block in blocks if (phrases := _phrases(block, window)) is not None]
    return [benchmark.sparkSession.sparkContext.broadcast(phrases) for phrases in made]


def _ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for each row, counts[0] numbers and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + counts, counts)


def _search(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last word (exclusive) of each occurrence, and text and item of each item found, repeats included."""
    nothing = (np.zeros(0, dtype=np.int64),) * 4
    place = np.searchsorted(phrases.vocabulary, words.hash)
    place[place == len(phrases.vocabulary)] = 0
    known = phrases.vocabulary[place] == words.hash
    # No phrase has a word from outside the vocabulary: only runs of known words, long enough for one, are indexed.
    start, end = runs(known, words.first[:-1])
    long = end - start >= phrases.lengths.min()
    start, end = start[long], end[long]
    if not len(start):
        return nothing
    size = end - start
    source = _ragged(start, size + 1)  # one more each, for the separator
    values = np.zeros(len(source), dtype=np.int64)
    inner = np.ones(len(source), dtype=bool)
    inner[np.cumsum(size + 1) - 1] = False
    values[inner] = place[source[inner]] + 1
    index = FMIndex(values, len(phrases.vocabulary))
    low, high = index.search(phrases.patterns, phrases.lengths)
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return nothing
    counts = high[hit] - low[hit]
    pattern = np.repeat(hit, counts)
    first = source[index.locate(_ragged(low[hit], counts))]
    owner = np.searchsorted(words.first, first, side="right") - 1
    n_items = phrases.first_item[pattern + 1] - phrases.first_item[pattern]
    item = phrases.items[_ragged(phrases.first_item[pattern], n_items)]
    return first, first + phrases.lengths[pattern], np.repeat(owner, n_items), item


@dataclass
class Found:
    """What the phrases hit in the texts of a piece."""

    n_words: np.ndarray
    n_hit: np.ndarray
    items: list[np.ndarray]
    span_owner: np.ndarray
    span_first: np.ndarray
    span_end: np.ndarray


def find(column: pa.Array, blocks: list[Broadcast]) -> tuple[Texts, Found]:
    texts = texts_of(column, lower=True)
    words = words_of(texts, LETTERS)
    results = [_search(words, block.value) for block in blocks]
    first, end, owner, item = (
        (np.concatenate(parts) for parts in zip(*results, strict=True)) if results else [np.zeros(0, dtype=np.int64)] * 4
    )
    mask = covered(first, end, len(words.start))
    start, stop = runs(mask, words.first[:-1])
    pairs = np.unique(np.stack([owner, item]), axis=1) if len(owner) else np.zeros((2, 0), dtype=np.int64)
    at = np.searchsorted(pairs[0], np.arange(len(texts) + 1))
    hits = np.diff(np.concatenate([[0], np.cumsum(mask)])[words.first])
    span_owner = np.searchsorted(words.first, start, side="right") - 1
    base = texts.offset[span_owner]
    return texts, Found(
        words.counts,
        hits,
        [pairs[1][a:b] for a, b in zip(at[:-1], at[1:], strict=True)],
        span_owner,
        words.start[start] - base,
        words.end[stop - 1] - base,
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document the benchmark items that occur in it, and the stretches of its text that they cover.

    A window is ``window`` consecutive words of an item, or all of them where it has fewer. The texts are cut into
    shards; each gets an FM-index over its words, is searched backwards for all windows at once, and hits are located by
    sampled suffix positions. Overlapping and adjacent hits make one span, given in bytes of the UTF-8 text.

    One row per row. Null and empty texts have no words and no hits; a null doc_id stays null; a null item_id hits
    without being listed; items with equal ids count as one; repeated rows are searched one by one. An empty benchmark
    hits nothing. Other columns are ignored, whatever their names.
    """
    blocks = phrase_blocks(benchmark, window)

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts, found = find(piece.column("text"), blocks)
        spans = pa.StructArray.from_arrays([pa.array(found.span_first), pa.array(found.span_end)], ["first_byte", "end_byte"])
        return pa.RecordBatch.from_arrays(
            [
                piece.column("doc_id"),
                pa.array(found.n_words),
                pa.array(found.n_hit),
                lists(pa.array(np.concatenate([*found.items, np.zeros(0, dtype=np.int64)])), np.array([len(x) for x in found.items])),
                lists(spans, np.bincount(found.span_owner, minlength=len(texts))),
            ],
            ["doc_id", "n_words", "n_hit", "items", "spans"],
        )

    return per_piece(documents(docs), work, SCHEMA, SHARD_BYTES)


def digest(found: DataFrame) -> DataFrame:
    """The items as count and hash."""
    ids = F.array_join(F.sort_array(F.transform("items", lambda item: item.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def removed(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, without the stretches of text that benchmark items cover.

    The words of a span and what stands between them go; ``n_chars`` is counted anew. All rows stay, also where nothing is
    left of a text. Null and empty texts stay as they are; rows that repeat a document are treated alike; ids do not
    matter. An empty benchmark removes nothing, and an empty table gives an empty one. Columns may have any names.
    """
    blocks = phrase_blocks(benchmark, window)

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        column = pc.cast(piece.column("text"), pa.string())
        _, found = find(column, blocks)
        if not len(found.span_owner):
            return piece
        values = column.cast(pa.binary()).to_pylist()
        for i, first, end in reversed(list(zip(found.span_owner, found.span_first, found.span_end, strict=True))):
            values[i] = values[i][:first] + values[i][end:]
        return with_texts(piece, values)

    return rewritten(docs, work, SHARD_BYTES)


