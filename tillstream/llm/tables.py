"""Small helpers on tables."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream.llm.text import pick
from tillstream.storage import run_folder


def written(df: DataFrame, name: str = "table", folder: str | None = None, **options: str) -> DataFrame:
    """The rows as Parquet files in the cluster's shared folder: lost executors cost nothing that came before.

    ``options`` go to the files' writer as they are. Without ``folder`` it is a new run folder.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{folder or run_folder(spark)}/{name}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs that nothing refers to any more.

    It does so when the driver collects its garbage, which may be long after; the files of all steps of an operator would
    be on disk together. Python's side lets go of Java objects in the background, about once a second, and Spark keeps
    the last query until another one ends.
    """
    gc.collect()
    spark.range(1).collect()
    time.sleep(1.5)
    spark._jvm.System.gc()


def content_key(text: Column) -> list[Column]:
    """128 bits of hashes of a text, as two columns; they tell rows apart that share an id or have none."""
    return [F.xxhash64(text).alias("key_a"), F.xxhash64(F.lit("content"), text).alias("key_b")]


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def sampled_labels(labels: DataFrame, label: str, per_class: int) -> list[tuple[int, int]]:
    """Up to ``per_class`` ids of either label, those of the lowest hash, as (id, label).

    Rows without id or label are left out. An id with both labels has the larger one.
    """
    rows = pick(labels, **{"doc_id": "bigint", label: "int"}).dropna()
    rows = rows.groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = []
    for value in (0, 1):
        order = [F.xxhash64("doc_id", F.lit("sample")), F.col("doc_id")]
        chosen += rows.filter(F.col("label") == value).orderBy(*order).limit(per_class).collect()
    return [(row["doc_id"], row["label"]) for row in chosen]


def sampled_texts(docs: DataFrame, chosen: list[tuple[int, int]]) -> DataFrame:
    """doc_id, text, label of the chosen documents. The list is a bounded sample, so it is broadcast."""
    spark = docs.sparkSession
    rows = spark.createDataFrame(chosen, "doc_id bigint, label int")
    return pick(docs, doc_id="bigint", text="string").join(F.broadcast(rows), "doc_id")


def class_counts(labels: DataFrame, label: str) -> tuple[int, int]:
    """How many rows have label 0 and label 1."""
    counts = dict(pick(labels, **{label: "int"}).dropna().groupBy(label).count().collect())
    return counts.get(0, 0), counts.get(1, 0)
