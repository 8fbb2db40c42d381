"""A pipeline over the documents: each stage reads what the one before has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillstream.llm.decontamination import removed
from tillstream.llm.forest import one_of_each
from tillstream.llm.mixing import mixed_documents
from tillstream.llm.repetition import keep_good
from tillstream.llm.windows import without_passages
from tillstream.storage import removed_after, run_folder

#: Stages take documents with any columns and give rows of the same, but for the last one. Each says what it does with null and
#: empty texts, repeated rows and ties; null ids are allowed, and an empty table gives an empty one.
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules on length and repetition keep.

    Null and empty texts have too few words and go; repeated rows are judged one by one, so they stay or go together.
    """
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group whose sets of five-word shingles are alike to 80 % or more.

    Documents without id, and null and empty texts, are in no group and stay. Of equal ids the smaller key of the text is
    first; rows that repeat id and text are one document and stay together.
    """
    return one_of_each(docs, size=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages that nearly repeat one of an earlier document.

    All rows stay, also those that are left with an empty text; null texts stay null. Documents without id come last, those of
    equal ids in an order of their texts; rows that repeat id and text lose the same.
    """
    return without_passages(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages that benchmark items cover.

    All rows stay; null and empty texts stay as they are; repeated rows lose the same. An empty benchmark covers nothing.
    """
    return removed(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many words of each.

    Null and empty texts have no words and go. A null source is one of its own; ties of seeded places go by id and size.
    """
    return mixed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: Suffix arrays and similarity joins with seeded choices: SQL cannot express the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from the table ``documents`` on, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = run_folder(spark)
    for number, (name, stage) in enumerate(STAGES, 1):
        path = f"{folder}/{number}-{name}"
        with removed_after(spark):  # the tables of the stage's own steps
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
