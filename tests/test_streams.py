"""The streams: micro-batches, restart, fan-out, refusal of other output modes, failure."""

import json
import os
import time
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from tests.records import HOME_DELIVERY, TAKEAWAY
from tillstream.operators import flatten_line_items, loyalty_points, notification_messages, parse_invoices
from tillstream.plans import start_queries, wait_for_any
from tillstream.plans.catalog import QUERIES
from tillstream.schemas import FLAT_SCHEMA, MESSAGE_SCHEMA
from tillstream.sources import read_topic_files
from tillstream.streaming import write_files

WAIT = 120


class Run:
    """One topic folder and the places of its streams."""

    def __init__(self, spark, topic, folder):
        self.spark, self.topic, self.folder = spark, topic, folder

    def arrive(self, *records, files=1):
        self.topic(*records).repartition(files).write.mode("append").parquet(f"{self.folder}/topic")

    def stream(self, **options):
        return read_topic_files(self.spark, f"{self.folder}/topic", **options)

    def flatten(self, available_now=True, **options):
        rows = flatten_line_items(parse_invoices(self.stream(**options)))
        return write_files(
            rows, f"{self.folder}/output", f"{self.folder}/checkpoints/flatten", available_now=available_now
        )

    def publish(self, available_now=True):
        return lambda messages, checkpoint: write_files(
            messages, f"{self.folder}/messages", checkpoint, "Notification Writer", "parquet", available_now
        )

    def job(self, available_now=True):
        return start_queries(
            self.stream(),
            self.publish(available_now),
            f"{self.folder}/output",
            f"{self.folder}/checkpoints",
            available_now,
        )

    def finish(self, *queries):
        for query in queries:
            assert query.awaitTermination(WAIT)
            assert query.exception() is None

    def rows(self):
        return sorted(tuple(row) for row in self.spark.read.schema(FLAT_SCHEMA).json(f"{self.folder}/output").collect())

    def item_codes(self):
        return sorted((row[0], row[10]) for row in self.rows())

    def keys(self):
        messages = self.spark.read.schema(MESSAGE_SCHEMA).parquet(f"{self.folder}/messages")
        return sorted((row.key or "", row.value) for row in messages.collect())


@pytest.fixture
def run(spark, topic, tmp_path):
    return Run(spark, topic, tmp_path)


def numbered(number):
    return TAKEAWAY | {"InvoiceNumber": str(number)}


def codes(*numbers):
    return sorted((str(number), code) for number in numbers for code in ("11", "12"))


def test_one_micro_batch_per_file(run):
    run.arrive(*map(numbered, range(100, 140)), files=4)
    query = run.flatten(maxFilesPerTrigger="1")
    run.finish(query)
    assert run.item_codes() == codes(*range(100, 140))
    batches = [progress for progress in query.recentProgress if progress.numInputRows]
    assert len(batches) == 4
    assert all(not progress.stateOperators for progress in batches)


def test_restart_takes_in_what_is_new_and_only_that(run):
    run.arrive(numbered(1), numbered(2))
    run.finish(run.flatten())
    run.arrive(numbered(3))
    run.finish(run.flatten())
    run.finish(run.flatten())
    assert run.item_codes() == codes(1, 2, 3)


def test_late_files_are_read(run):
    """Also one that is ten days older than the newest file read before."""
    run.arrive(numbered(1))
    run.finish(run.flatten())
    before = set((run.folder / "topic").glob("*.parquet"))
    run.arrive(numbered(2))
    old = time.time() - 10 * 24 * 3600
    for path in set((run.folder / "topic").glob("*.parquet")) - before:
        os.utime(path, (old, old))
    run.finish(run.flatten())
    assert run.item_codes() == codes(1, 2)


def test_a_smaller_age_is_the_callers_choice(run):
    run.arrive(numbered(1))
    assert run.stream(maxFileAge="1h").isStreaming


def test_restart_after_a_failed_batch(run, spark):
    """A batch that fails is done again from the checkpoint, and leaves no half of its rows behind."""
    run.arrive(numbered(1))
    run.finish(run.flatten())
    run.arrive(numbered(2), numbered(3), files=2)
    broken = flatten_line_items(parse_invoices(run.stream())).withColumn(
        "StoreID", F.when(F.col("InvoiceNumber") == "3", F.raise_error(F.lit("lost"))).otherwise(F.col("StoreID"))
    )
    query = write_files(broken, f"{run.folder}/output", f"{run.folder}/checkpoints/flatten", available_now=True)
    with pytest.raises(StreamingQueryException):
        query.awaitTermination(WAIT)
    assert run.item_codes() == codes(1)
    run.finish(run.flatten())
    assert run.item_codes() == codes(1, 2, 3)


def test_default_trigger_keeps_running(run):
    run.arrive(numbered(1))
    query = run.flatten(available_now=False)
    try:
        query.processAllAvailable()
        run.arrive(numbered(2))
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    assert run.item_codes() == codes(1, 2)


def test_job_feeds_both_sinks(run):
    run.arrive(TAKEAWAY, HOME_DELIVERY, "not json", "", None, TAKEAWAY)
    notify, flatten = run.job()
    run.finish(notify, flatten)
    taken = ("7001", '{"CustomerCardNo":"555001","TotalAmount":2943.0,"EarnedLoyaltyPoints":588.6}')
    brought = ("7002", '{"CustomerCardNo":"555002","TotalAmount":1260.0,"EarnedLoyaltyPoints":252.0}')
    assert run.keys() == [("", "{}")] * 3 + [taken, taken, brought]
    assert run.item_codes() == sorted(codes(7001) * 2 + [("7002", "13")])
    assert (notify.name, flatten.name) == ("Notification Writer", "Flattened Invoice Writer")
    assert notify.id != flatten.id
    assert (run.folder / "checkpoints/notify/metadata").exists()
    assert (run.folder / "checkpoints/flatten/metadata").exists()


def test_queries_of_the_job_restart_by_themselves(run):
    run.arrive(numbered(1))
    run.finish(*run.job())
    run.arrive(numbered(2))
    run.finish(run.flatten())
    assert run.item_codes() == codes(1, 2) and [key for key, _ in run.keys()] == ["1"]
    run.finish(*run.job())
    assert run.item_codes() == codes(1, 2) and [key for key, _ in run.keys()] == ["1", "2"]


def test_waiting_ends_with_the_first_query(run, spark):
    run.arrive(numbered(1))
    spark.streams.resetTerminated()
    notify, flatten = run.job(available_now=False)
    try:
        assert not wait_for_any([notify, flatten], 1)
        notify.stop()
        assert wait_for_any([notify, flatten], WAIT) and spark.streams.awaitAnyTermination(WAIT)
        assert flatten.isActive
    finally:
        notify.stop()
        flatten.stop()
        spark.streams.resetTerminated()


def test_no_query_is_left_behind_when_the_second_does_not_start(run, spark):
    run.arrive(numbered(1))
    blocking = run.flatten(available_now=False)
    try:
        with pytest.raises(Exception, match="Flattened Invoice Writer"):
            start_queries(run.stream(), run.publish(False), f"{run.folder}/o2", f"{run.folder}/c2")
        assert [query.name for query in spark.streams.active] == ["Flattened Invoice Writer"]
    finally:
        blocking.stop()


@pytest.mark.parametrize("mode", ["complete", "update"])
def test_json_files_take_append_only(run, mode):
    run.arrive(numbered(1))
    rows = flatten_line_items(parse_invoices(run.stream()))
    writer = rows.writeStream.format("json").outputMode(mode).option("checkpointLocation", f"{run.folder}/c")
    with pytest.raises(AnalysisException):
        writer.start(f"{run.folder}/output").stop()


def test_files_hold_one_object_per_row_without_nulls(run, spark):
    run.arrive(TAKEAWAY)
    run.finish(run.flatten())
    lines = [json.loads(row.value) for row in spark.read.text(f"{run.folder}/output").collect()]
    assert sorted(line["ItemCode"] for line in lines) == ["11", "12"]
    assert "City" not in lines[0] and lines[0]["CreatedTime"] == 1700000000123


def test_stream_equals_batch(run, spark):
    """The same operators over the same records, as a stream and as a batch."""
    run.arrive(TAKEAWAY, HOME_DELIVERY, "{}", files=2)
    invoices = parse_invoices(spark.read.parquet(f"{run.folder}/topic"))
    run.finish(*run.job())
    assert run.rows() == sorted(tuple(row) for row in flatten_line_items(invoices).collect())
    batch = notification_messages(loyalty_points(invoices)).collect()
    assert run.keys() == sorted((row.key or "", row.value) for row in batch)


@pytest.mark.parametrize("name", ["flatten_stream", "restarted_stream", "invoice_job", "invoice_job_messages"])
def test_line_items_are_written_compressed(spark, name):
    """Flat rows as JSON text would be most of what these queries write."""
    found = QUERIES[name](spark, SF_DIR)
    output = Path(urlparse(found.inputFiles()[0]).path).parents[1] / "output"
    files = [path for path in output.rglob("part-*") if path.is_file()]
    rows = spark.read.schema(FLAT_SCHEMA).json(str(output))
    plain = rows.select(F.sum(F.length(F.to_json(F.struct("*"))) + 1)).first()[0]
    assert files and sum(path.stat().st_size for path in files) < plain / 3
    assert rows.count() == 6000
