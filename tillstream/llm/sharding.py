"""Shards by rendezvous hashing.

Every shard draws a number for every record, by a hash of the record's key and the shard's number, and the record goes to
the shard of the best draw. A draw depends on nothing else; so a new shard takes the records for which it draws best, and no
other record moves. With ``-ln(u) / weight`` for a draw ``u`` between 0 and 1, the smallest one wins, and shards get records
in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstream.llm.numbering import numbered
from tillstream.llm.text import pick

#: Shards of equal weight in the registered query.
SHARDS = 40
#: Bytes that a record takes besides its text.
RECORD_BYTES = 16
#: Hex digits of a draw; one digest holds the draws of several shards.
DIGITS = 8
PER_DIGEST = 64 // DIGITS


def key_of(doc_id: Column) -> Column:
    """The stable key of a record: its id in decimal, ``-`` for a missing one."""
    return F.coalesce(doc_id.cast("bigint").cast("string"), F.lit("-"))


def draws(key: Column, weights: Sequence[float]) -> Column:
    """For each shard its draw for a key, as an array; the smallest one wins."""
    if not weights or min(weights) <= 0:
        raise ValueError("there has to be a shard, and every weight has to be above 0")
    digests = F.transform(
        F.sequence(F.lit(0), F.lit((len(weights) - 1) // PER_DIGEST)),
        lambda g: F.sha2(F.concat(key, F.lit(":"), g.cast("string")).cast("binary"), 256),
    )
    numbers = F.flatten(
        F.transform(
            digests,
            lambda d: F.array(*(F.conv(F.substring(d, 1 + DIGITS * k, DIGITS), 16, 10).cast("double") for k in range(PER_DIGEST))),
        )
    )
    among = float(16**DIGITS)
    weighted = F.array(*(F.lit(float(weight)) for weight in weights))
    return F.zip_with(F.slice(numbers, 1, len(weights)), weighted, lambda x, w: -F.ln((x + 0.5) / among) / w)


def winner(drawn: Column) -> Column:
    """The draw and the shard that win, as a struct; the smaller shard where two draw the same."""
    return F.array_min(F.transform(drawn, lambda x, shard: F.struct(x.alias("draw"), shard.alias("shard"))))


def _drawn(rows: DataFrame, key: Column, weights: Sequence[float], more: Sequence[float]) -> DataFrame:
    """The rows with their shard, and their shard among ``more`` shards too: the old ones or one of the new ones."""
    n = len(weights)
    rows = rows.withColumn("_drawn", draws(key, [*weights, *more]))
    rows = rows.withColumn("_won", winner(F.slice("_drawn", 1, n)))
    grown = F.col("_won.shard")
    if more:
        grown = winner(F.concat(F.array("_won.draw"), F.slice("_drawn", n + 1, len(more))))["shard"]
        grown = F.when(grown > 0, grown + (n - 1)).otherwise(F.col("_won.shard"))
    return rows.withColumn("shard", F.col("_won.shard")).withColumn("grown_shard", grown).drop("_drawn", "_won")


def shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, more: Sequence[float] = (1.0,)) -> DataFrame:
    """Per document its shard, its place there, and its shard once there are ``more`` shards: doc_id, size, text_crc32, law,
    shard, slot, grown_shard.

    Shards are numbered from 0 in the order of ``weights``, then of ``more``. A document goes by its id and the weights
    alone; in the grown set it stays or goes to a new shard. ``slot`` counts a shard's documents from 0 in the order of id
    (null first), code and size of the text. ``size`` is the text's bytes and RECORD_BYTES more.

    One row per row. A null text has no bytes, so its code is 0, as an empty one's. Documents without id share one key and
    so a shard; a row that repeats an id goes to the same shard and gets a slot of its own. An empty table gives an empty
    one. Other columns are ignored, whatever their names.
    """
    rows = pick(docs, doc_id="bigint", text="string")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = rows.select("doc_id", (F.octet_length(raw) + F.lit(RECORD_BYTES)).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = _drawn(rows, key_of(F.col("doc_id")), weights, more)
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    rows = numbered(rows, "shard", order, "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, folder: str, weights: Sequence[float] = (1.0,) * SHARDS) -> None:
    """The documents with all their columns as Parquet files, those of a shard in its folder ``shard=<number>``.

    Documents are dealt to the writers by ranges of shard and id, so that a shard of any size has several writers and each
    writes few files. A column of the table that is named ``shard`` itself is written as ``shard_``. Nulls, repeated rows
    and empty tables are as in ``shards``.
    """
    names = [f"_{i}" for i in range(len(docs.columns))]
    at = names[docs.columns.index("doc_id")]
    rows = _drawn(docs.toDF(*names), key_of(F.col(at)), weights, ()).drop("grown_shard")
    rows = rows.repartitionByRange("shard", at, F.monotonically_increasing_id())
    kept = [name if name.lower() != "shard" else f"{name}_" for name in docs.columns]
    rows.toDF(*kept, "shard").write.partitionBy("shard").parquet(folder)
