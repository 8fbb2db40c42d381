"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm.tables import written


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (or smaller) neighbours are linked with the smallest number the node knows instead.

    The smallest ones are a table of their own, so that the join back to the links of a hub can be split.
    """
    rows = _both_ways(links) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(rows.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    joined = rows.join(least, "a")
    if large:
        new = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        own = least.select("a", F.col("m").alias("b"))
        new = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(own)
    return new.filter(F.col("a") != F.col("b")).distinct()


def _contracted(links: DataFrame) -> DataFrame:
    """The links of each task joined on the spot: every node with the smallest one of its component there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(node: int) -> int:
            above = parent.setdefault(node, node)
            while above != parent[above]:
                parent[node] = above = parent[above]
                node = above
            return above

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
        rows = [(node, root(node)) for node in list(parent)]
        rows = [row for row in rows if row[0] != row[1]]
        for i in range(0, len(rows), 100_000):
            columns = [pa.array(column, pa.int64()) for column in zip(*rows[i : i + 100_000], strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    return links.mapInArrow(run, "a bigint, b bigint")


#: Links that a task joins at a time, about.
LINKS = 250_000


def _is_flat(links: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most, which has none itself."""
    once = links.groupBy("a").agg(F.count("*").alias("n"))
    if not once.filter("n > 1").isEmpty():
        return False
    return links.select("a").join(links.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """Each linked node with the smallest node of its component, as (node, component).

    Each task joins its own links first, and then those of several tasks, up to LINKS. If these are more than one task's,
    large and small stars take turns until each node is linked with the smallest one alone, which takes a number of rounds
    that grows with the logarithm of the nodes. Links (a, b) may repeat and may go either way; a node linked with itself
    alone is left out.
    """
    # Written before they are joined: links often come from Python, and a task would keep two workers busy at a time.
    now = written(links.select("a", "b").filter(F.col("a") != F.col("b")))
    now = written(_contracted(now))
    tasks = max(1, -(-now.count() // LINKS))
    now = written(_contracted(now.coalesce(tasks)))
    while tasks > 1 and not _is_flat(now):
        now = written(_star(written(_star(now, large=True)), large=False))
    linked = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return linked.unionAll(now.select("b", "b").distinct().toDF("node", "component"))
