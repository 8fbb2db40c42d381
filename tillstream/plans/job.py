"""The job: one parsed stream, two queries."""

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tillstream.operators import flatten_line_items, loyalty_points, notification_messages, parse_invoices
from tillstream.settings import (
    BROKER,
    CHECKPOINT_ROOT,
    FLATTEN_CHECKPOINT,
    NOTIFICATION_CHECKPOINT,
    OUTPUT_PATH,
)
from tillstream.sources import read_topic
from tillstream.storage import checked_place, shared_folder
from tillstream.streaming import write_files, write_topic


def start_queries(
    records: DataFrame,
    publish: Callable[[DataFrame, str], StreamingQuery],
    output: str,
    checkpoints: str,
    available_now: bool = False,
    output_options: Mapping[str, str] | None = None,
) -> list[StreamingQuery]:
    """Start the notification query and the line-item query on one stream of topic records.

    ``publish`` starts the notification sink, given the messages and a checkpoint folder; ``output_options`` go to the
    file sink of the line items. Each query reads the stream by itself and keeps its own checkpoint, so either can be
    stopped and started again without the other.
    """
    invoices = parse_invoices(records)
    messages = notification_messages(loyalty_points(invoices))
    notify = publish(messages, f"{checkpoints}/{NOTIFICATION_CHECKPOINT}")
    try:
        flatten = write_files(
            flatten_line_items(invoices),
            output,
            f"{checkpoints}/{FLATTEN_CHECKPOINT}",
            available_now=available_now,
            **(output_options or {}),
        )
    except Exception:
        notify.stop()
        raise
    return [notify, flatten]


def start_job(
    spark: SparkSession,
    broker: str = BROKER,
    output: str = OUTPUT_PATH,
    checkpoints: str | None = None,
    available_now: bool = False,
    source_options: Mapping[str, str] | None = None,
    sink_options: Mapping[str, str] | None = None,
    output_options: Mapping[str, str] | None = None,
) -> list[StreamingQuery]:
    """Start the job on a Kafka broker, from which it reads and to which it writes.

    ``source_options`` and ``sink_options`` go to Spark's Kafka source and sink as they are; a secured cluster needs its
    client settings in both. ``output_options`` go to the file sink, such as ``compression``, without which the line items
    are plain text. Checkpoints go to the cluster's shared folder unless a folder is given.
    """
    for options in (source_options, sink_options, output_options):
        _refuse_settings(options or {})
    if checkpoints is None:
        checkpoints = "/".join(filter(None, [shared_folder(spark), CHECKPOINT_ROOT]))
    checked_place(spark, checkpoints, "the checkpoint folder")
    checked_place(spark, output, "the output folder")
    return start_queries(
        read_topic(spark, broker, **(source_options or {})),
        lambda messages, checkpoint: write_topic(
            messages, checkpoint, broker, available_now=available_now, **(sink_options or {})
        ),
        output,
        checkpoints,
        available_now,
        output_options,
    )


#: What is set by arguments of the job, and so for both ends alike.
_SETTINGS = {"broker", "output", "checkpoints", "available_now", "name", "topic", "messages", "checkpoint", "spark"}
_SETTINGS |= {"rows", "path", "format"}
_SETTINGS |= {"kafka.bootstrap.servers", "checkpointlocation", "subscribe"}


def _refuse_settings(options: Mapping[str, str]) -> None:
    for name in options:
        if name.lower() in _SETTINGS:
            raise ValueError(f"{name} is a setting of the job, not an option of its source or sink")


def wait_for_any(queries: Sequence[StreamingQuery], seconds: float | None = None) -> bool:
    """Wait until one of these queries ends; the failure of one is raised here. False if ``seconds`` pass first.

    Unlike Spark's wait for any query of the session, it is not ended by other people's queries, nor by earlier ones.
    """
    end = None if seconds is None else time.monotonic() + seconds
    while end is None or time.monotonic() < end:
        for query in queries:
            if query.awaitTermination(0.5):
                return True
    return False


def run_job(spark: SparkSession, **settings) -> None:
    """Start the job and wait until one of its two queries ends, then stop the other; a failure is raised here."""
    queries = start_job(spark, **settings)
    try:
        wait_for_any(queries)
    finally:
        for query in queries:
            query.stop()
