"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillstream.llm.tables import written
from tillstream.llm.text import pick

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A source is taken this many times at most.
MOST_TIMES = 3
#: Words of a block, and of a shard as far as a source has no more than 4096 shards.
BLOCK_WORDS = 64
SHARD_WORDS = 50_000
MAX_SHARDS = 4096
#: The mix is planned on the driver with a few numbers per source; more sources than this are refused.
MAX_SOURCES = 100_000


def apportion(votes: Sequence[float], seats: int) -> list[int]:
    """Seats by highest quotients votes / (2 s + 1), where s is what one has so far; ties go to the first.

    All seats that a divisor somewhat too large gives are handed out at once; the rest, no more than there are
    claimants, one by one.
    """
    given = [0] * len(votes)
    total = math.fsum(votes)
    if total <= 0 or seats <= 0:
        return given
    if 2 * seats > len(votes):
        divisor = total / (seats - len(votes) / 2)
        given = [max(0, math.ceil(v / divisor - 0.5)) for v in votes]
    heap = [(-v / (2 * given[i] + 1), i) for i, v in enumerate(votes) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(given)):
        i = heap[0][1]
        given[i] += 1
        heapq.heapreplace(heap, (-votes[i] / (2 * given[i] + 1), i))
    return given


def targets_of(sizes: Sequence[int], weights: Sequence[float], most_times: int = MOST_TIMES) -> list[float]:
    """What each source is to give of the sum of all sizes: by weight, none more than ``most_times`` its size, and what
    that leaves by weight among the others, until none is above."""
    full = [False] * len(sizes)
    while True:
        left = sum(sizes) - most_times * sum(size for size, own in zip(sizes, full, strict=True) if own)
        open_weight = sum(weight for weight, own in zip(weights, full, strict=True) if not own)
        targets = [
            float(most_times * size) if own else weight * left / open_weight
            for size, weight, own in zip(sizes, weights, full, strict=True)
        ]
        over = [target > most_times * size for target, size in zip(targets, sizes, strict=True)]
        if not any(over):
            return targets
        full = [own or now for own, now in zip(full, over, strict=True)]


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _planned(sizes: DataFrame, weights: Sequence[float], block_words: int, shard_words: int) -> DataFrame:
    """Per source its size, target, blocks and number of shards."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources cannot be planned")
    rows.sort(key=lambda row: (row["source"] is None, row["source"] or ""))  # str compares by code point
    counts = [row["n"] for row in rows]
    targets = targets_of(counts, [weights[i % len(weights)] for i in range(len(rows))]) if rows else []
    blocks = apportion(targets, round(sum(counts) / block_words))
    plan = [
        (number, row["source"], n, target, own, min(MAX_SHARDS, max(1, -(-n // shard_words))))
        for number, (row, n, target, own) in enumerate(zip(rows, counts, targets, blocks, strict=True))
    ]
    schema = "number int, source string, source_size bigint, target double, blocks bigint, n_shards bigint"
    return sizes.sparkSession.createDataFrame(plan, schema)


def _sharded(sizes: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """The rows with their source's plan, a seeded order, and a shard of their source by it."""
    joined = sizes.withColumnRenamed("source", "of_source").join(
        F.broadcast(plan), F.col("of_source").eqNullSafe(F.col("source"))
    )
    place = F.xxhash64(F.lit(seed), "doc_id", "size")
    return joined.drop("of_source").withColumn("place", place).withColumn("shard", F.pmod("place", "n_shards"))


def _shares(sizes: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """How many blocks each shard of each source gives, again by highest quotients. At most 4096 shards a group."""

    def share(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard")
        return group.assign(quota=apportion(group["words"].tolist(), int(group["blocks"].iloc[0])))

    shards = _sharded(sizes, plan, seed).groupBy("number", "shard")
    shards = shards.agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks"))
    schema = "number int, shard bigint, words bigint, blocks bigint, quota bigint"
    return shards.groupBy("number").applyInPandas(share, schema).drop("blocks")


def _taken(rows: DataFrame, shares: DataFrame, block_words: int) -> DataFrame:
    """What is taken of each row: the words of a shard in seeded order, end to end, from the first on and over again,
    until its blocks are full."""
    joined = rows.join(shares, ["number", "shard"])
    order = Window.partitionBy("number", "shard").orderBy("place", "doc_id", "size")
    ahead = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    wanted = F.least(F.col("quota") * block_words, MOST_TIMES * F.col("words"))
    rest = F.col("wanted") % F.col("words")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("ahead")))
    full = F.floor(F.col("wanted") / F.col("words")) * F.col("size")
    taken = F.when(F.col("words") > 0, full + part).otherwise(0).cast("bigint")
    return (
        joined.withColumn("wanted", wanted)
        .withColumn("ahead", ahead)
        .withColumn("taken", taken)
        .drop("number", "place", "shard", "blocks", "n_shards", "words", "quota", "wanted", "ahead")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = 1,
) -> DataFrame:
    """Per document how many of its words the mix takes: doc_id, source, size, source_size, target, taken.

    The mix has as many words as all documents. Its blocks are apportioned to sources by their targets, and a source's
    blocks to its shards by their words; a shard fills its blocks with its documents in a seeded order. So a source's
    words differ from its target by about a block, all documents but the last one of a shard are taken whole, and a
    run on the same rows takes the same.

    One row per row. Null and empty texts have size 0, and nothing is taken of them; null is a source of its own, the
    last one; ids may be null or repeat, rows are dealt by id and size. An empty table gives an empty one. Other columns
    are ignored.
    """
    rows = pick(docs, doc_id="bigint", source="string", text="string")
    sizes = written(rows.select("doc_id", "source", _size(F.col("text")).alias("size")), "sizes")
    plan = _planned(sizes, weights, block_words, shard_words)
    shares = written(_shares(sizes, plan, seed), "shares")
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    return _taken(_sharded(sizes, plan, seed), shares, block_words).select(*columns)


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = 1,
) -> DataFrame:
    """The documents that the mix takes words of: their columns, and size, source_size, target and taken.

    Columns of these names that the documents have already are replaced. Documents that nothing is taken of, null and empty
    texts among them, are left out. A null source is a source of its own; ids may be null or repeat. Ties of seeded places
    go by id and size, so rows that repeat a document may be taken one without the other. An empty table gives an empty one.
    """
    figures = ["size", "source_size", "target", "taken"]
    places = [f"_{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*places)
    by_name = {name: F.col(place) for name, place in zip(reversed(docs.columns), reversed(places), strict=True)}
    others = [(place, name) for place, name in zip(places, docs.columns, strict=True) if name.lower() not in figures]
    rows = inner.select(
        by_name["doc_id"].cast("bigint").alias("doc_id"),
        by_name["source"].cast("string").alias("source"),
        _size(by_name["text"]).alias("size"),
        F.struct(*[place for place, _ in others]).alias("payload"),
    )
    sizes = written(rows.drop("payload"), "sizes")
    plan = _planned(sizes, weights, block_words, shard_words)
    shares = written(_shares(sizes, plan, seed), "shares")
    taken = _taken(_sharded(rows, plan, seed), shares, block_words).filter(F.col("taken") > 0)
    return taken.select("payload.*", *figures).toDF(*[name for _, name in others], *figures)
