"""Registered queries against SQL, and every operator on messy and empty tables."""

import hashlib

import pytest

import __spark_entry__ as registered
import corpus_pipeline
from tests.conftest import SF_DIR
from tests.llm.conftest import LONG, MESSY, PROSE, table
from tests.oracle import differences
from tillstream.llm import (
    compression,
    decontamination,
    doubling,
    forest,
    licenses,
    mixing,
    repetition,
    toxicity,
    viterbi,
    windows,
)
from tillstream.llm.queries import ORACLES, QUERIES


def test_all_are_registered():
    assert len(QUERIES) == 13 and QUERIES.items() <= registered.queries().items()
    assert registered.queries()["pipeline"] is corpus_pipeline.run
    assert ORACLES.items() <= registered.oracle_sql().items()
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules",
        "near_dedup",
        "substring_dedup",
        "decontamination",
        "source_mixing",
    ]


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql(spark, name):
    result = QUERIES[name](spark, SF_DIR)
    assert not result.isEmpty()
    assert differences(result, ORACLES[name], SF_DIR) == ({}, {})


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """The messy documents that SQL can judge too: those with an id that no other text has."""
    folder = tmp_path_factory.mktemp("odd")
    ids = [doc_id for doc_id, _ in MESSY]
    rows = [(doc_id, text) for doc_id, text in MESSY if doc_id is not None and ids.count(doc_id) == 1 and text != LONG]
    rows += [(100 + i, text) for i, (_, text) in enumerate(rows)]
    docs = table(spark, rows)
    docs.toDF(*docs.columns[:-1], "other").write.parquet(f"{folder}/documents.parquet")
    items = [(1, PROSE[300:420]), (2, "word"), (3, None), (4, ""), (None, "blanks here"), (11, "Zwei Wörter"), (2, "odd")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ORACLES)
def test_query_on_odd_texts_equals_its_sql(spark, odd_dir, name):
    result = QUERIES[name](spark, odd_dir)
    assert differences(result, ORACLES[name], odd_dir) == ({}, {})


@pytest.mark.parametrize("name", ["op2_token_counts", "op6_source_mixing"])
def test_query_without_sql_on_odd_texts(spark, odd_dir, name):
    ids = sorted(row.doc_id for row in spark.read.parquet(f"{odd_dir}/documents.parquet").collect())
    assert sorted(row.doc_id for row in QUERIES[name](spark, odd_dir).collect()) == ids


def test_passages_of_odd_texts(spark, odd_dir):
    """The second half of the table repeats the first; texts of under 50 words have no passage."""
    rows = QUERIES["op9_substring_dedup"](spark, odd_dir).collect()
    texts = {row.doc_id: row.text or "" for row in spark.read.parquet(f"{odd_dir}/documents.parquet").collect()}
    first = {}
    for doc_id in sorted(texts):
        first.setdefault(texts[doc_id], doc_id)
    long = {doc_id for doc_id, text in texts.items() if len(set(text.split())) >= 50 and first[text] != doc_id}
    assert {row.doc_id for row in rows} >= long and all(row.of_doc < row.doc_id for row in rows)


def _models(spark, docs, labels):
    no_labels = labels.limit(0)
    return {
        "compression": lambda df: compression.quality(df, compression.train(docs, no_labels)),
        "toxicity": lambda df: toxicity.toxicity(df, toxicity.train(docs, no_labels)),
    }


OPERATORS = {
    "contamination": lambda df, items: decontamination.contamination(df, items),
    "token_counts": lambda df, items: viterbi.token_counts(df),
    "repetition": lambda df, items: repetition.repetition(df),
    "license_scan": lambda df, items: licenses.license_scan(df),
    "doubling": lambda df, items: doubling.deduplicated(df),
    "mix": lambda df, items: mixing.mix(df),
    "near_duplicates": lambda df, items: forest.near_duplicates(df),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(messy, benchmark_items, name):
    rows = OPERATORS[name](messy, benchmark_items).collect()
    assert sorted(str(row.doc_id) for row in rows) == sorted(str(doc_id) for doc_id, _ in MESSY)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(empty, benchmark_items, name):
    assert OPERATORS[name](empty, benchmark_items.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["compression", "toxicity"])
def test_models_without_labels(spark, messy, empty, labels, name):
    work = _models(spark, messy, labels)[name]
    rows = work(messy).collect()
    assert len(rows) == len(MESSY) and all(0 <= row.score <= 1 for row in rows)
    assert work(empty).collect() == []


@pytest.mark.parametrize("number", range(5))
def test_stages_on_messy_tables(spark, messy, empty, tmp_path, number):
    _, stage = corpus_pipeline.STAGES[number]
    # Parquet takes no names that differ in case alone.
    docs = messy.toDF(*messy.columns[:-1], "other")
    result = stage(spark, docs, SF_DIR)
    if number < 4:
        assert result.columns == docs.columns and result.schema.simpleString() == docs.schema.simpleString()
    result.write.parquet(str(tmp_path / "stage"))
    rows = spark.read.parquet(str(tmp_path / "stage")).collect()
    assert rows and all(row.a == "x" and row.other == "x" for row in rows)
    assert stage(spark, docs.limit(0), SF_DIR).collect() == []


def test_kept_bytes_of_a_repeated_row(spark):
    rows = doubling.deduplicated(table(spark, MESSY)).collect()
    by_id = {}
    for row in rows:
        by_id.setdefault(row.doc_id, []).append(row)
    assert by_id[1][0].n_removed == 0
    # Both rows of document 2 are copies of document 1, not of each other.
    assert [row.n_removed for row in by_id[2]] == [len(PROSE.encode())] * 2
    assert by_id[3][0].kept_sha256 == by_id[4][0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert by_id[10][0].n_bytes == 250 and by_id[10][0].n_removed == 245
    assert {row.n_removed for row in by_id[None]} == {0, len(PROSE.encode())}
    assert by_id[9][0].n_bytes == len(LONG)


def test_passages_of_messy_rows(messy, empty):
    rows = windows.passages(messy).collect()
    # Document 2 stands twice; 8 has the prose and more; one row has no id. All of them repeat an earlier one.
    assert sorted(str(row.doc_id) for row in rows) == ["2", "2", "8", "None"]
    assert all(row.of_doc == 1 for row in rows if row.doc_id == 2)
    assert all(row.similarity >= 0.8 and row.end_word - row.first_word >= 50 for row in rows)
    assert windows.passages(empty).collect() == []
