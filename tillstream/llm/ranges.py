"""Rows made of texts, dealt to tasks by ranges of two keys.

Spark finds ranges by making all rows twice. Here the bounds come from the rows of a sample of the documents; they change
which task a row goes to and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm.bundles import BUNDLES, PART_ROWS, bundles
from tillstream.llm.tables import written
from tillstream.llm.text import documents, per_piece

#: One in so many documents is in the sample, and about so many of their rows are taken for each range.
SAMPLE = 32
PER_RANGE = 32


def range_of(bounds: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the bounds, which are in order, are at or below each pair of keys."""
    low, high = (np.searchsorted(bounds[0], a, side=side) for side in ("left", "right"))
    part = low.astype(np.int32)
    # Where bounds have the same first key the second one decides.
    for i in np.unique(low[high > low]).tolist():
        own = np.flatnonzero((low == i) & (high > low))
        part[own] += np.searchsorted(bounds[1][i : high[own[0]]], b[own], side="right").astype(np.int32)
    return part


def dealt(
    docs: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, keys: tuple[str, str], order: list[str]
) -> DataFrame:
    """The rows that ``work`` makes of pieces of the documents, in ranges of the keys and in order within each.

    Rows of equal keys are in one range.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = documents(docs)
    some = per_piece(texts.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0), work, schema)
    # The driver gets a few rows for each range, however large the table is.
    some = written(some.select(*keys), "sample")
    sample = sorted(some.sample(min(1.0, PER_RANGE * n / max(1, some.count())), seed=1).collect())
    if len(sample) < PER_RANGE * n // 4:  # a small table, or none
        rows = per_piece(texts, work, schema).repartitionByRange(n, *keys)
        return rows.sortWithinPartitions(*order)
    at = [len(sample) * i // n for i in range(1, n)]
    bounds = tuple(np.array([sample[i][k] for i in at], dtype=np.int64) for k in (0, 1))

    def placed(piece: pa.RecordBatch) -> pa.RecordBatch:
        rows = work(piece)
        return rows.append_column("range", pa.array(range_of(bounds, *(rows.column(key).to_numpy() for key in keys))))

    rows = per_piece(texts, placed, schema + ", range int").repartitionById(n, "range").drop("range")
    return rows.sortWithinPartitions(*order)


def dealt_bundles(
    docs: DataFrame, work: Callable[[pa.RecordBatch], list[np.ndarray]], keys: tuple[int, int]
) -> DataFrame:
    """The rows that ``work`` makes of pieces of the documents, as columns of 64-bit numbers, in bundles by ranges of two of these.

    Rows of equal keys are in one range.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = documents(docs)

    def keys_of(piece: pa.RecordBatch) -> pa.RecordBatch:
        columns = work(piece)
        return pa.RecordBatch.from_arrays([pa.array(columns[key]) for key in keys], ["a", "b"])

    for some in (texts.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0), texts):
        some = written(per_piece(some, keys_of, "a bigint, b bigint"), "sample")
        rows = some.count() * SAMPLE
        # The driver gets a few rows for each range, however large the table is.
        ranges = max(n, rows // PART_ROWS)
        sample = sorted(some.sample(min(1.0, PER_RANGE * ranges * SAMPLE / max(1, rows)), seed=1).collect())
        if len(sample) >= PER_RANGE * n // 4:
            break
        # A small table, or none: all its rows.
    n = ranges
    at = [len(sample) * i // n for i in range(1, n)] if sample else []
    bounds = tuple(np.array([sample[i][k] for i in at], dtype=np.int64) for k in (0, 1))

    def placed(piece: pa.RecordBatch) -> pa.RecordBatch:
        columns = work(piece)
        return bundles(range_of(bounds, *(columns[key] for key in keys)), columns)

    return per_piece(texts, placed, BUNDLES).repartitionById(n, "part")
