"""Registered queries. Each takes a session and the folder of the tables, and runs over whole tables."""

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillstream.functions import parsed_json
from tillstream.operators import flatten_line_items, loyalty_points, notification_messages, parse_invoices
from tillstream.plans.job import start_queries, wait_for_any
from tillstream.schemas import FLAT_SCHEMA, MESSAGE_SCHEMA
from tillstream.settings import NOTIFICATION_QUERY
from tillstream.sources import order_topic, read_topic_files, text_topic
from tillstream.storage import move_folder, run_folder
from tillstream.streaming import write_files

Query = Callable[[SparkSession, str], DataFrame]

#: Flat rows as JSON text are several times the records they come from, and mostly the names of fields.
COMPRESSED = {"compression": "lz4"}


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar fields of every invoice and of its address."""
    return (
        parse_invoices(order_topic(spark, sf_dir))
        .select("value.*")
        .select("*", "DeliveryAddress.*")
        .drop("DeliveryAddress", "InvoiceLineItems")
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loyalty_points(parse_invoices(order_topic(spark, sf_dir)))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notification_messages(points(spark, sf_dir))


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_line_items(parse_invoices(order_topic(spark, sf_dir)))


def unreadable_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages for records of which half are no invoices: those still give one each, without key and without fields."""
    records = text_topic(spark, sf_dir).withColumnRenamed("offset", "doc_id")
    return notification_messages(loyalty_points(parse_invoices(records, "doc_id"), "doc_id"), "doc_id")


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field of the events' JSON text."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", parsed_json(F.col("props"), "k int")["k"].alias("k"))


def notification_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notification query on a stream of topic files."""
    folder = _topic_folder(spark, sf_dir)
    stream = notification_messages(loyalty_points(parse_invoices(_stream(spark, folder))))
    _finish(_publish(folder)(stream, f"{folder}/checkpoints/notify"))
    return _published(spark, folder)


def flatten_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line-item query on a stream of topic files."""
    folder = _topic_folder(spark, sf_dir)
    _finish(_flatten(spark, folder))
    return _flattened(spark, folder)


def restarted_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line-item query, ended and started again from its checkpoint when later records have arrived.

    The topic is written once, in two halves of its records; a half arrives when its folder is moved into the topic.
    """
    folder = run_folder(spark)
    half = F.pmod(F.xxhash64("value"), F.lit(2)).alias("half")
    order_topic(spark, sf_dir).select("*", half).write.partitionBy("half").parquet(f"{folder}/written")
    for number in range(2):
        move_folder(spark, f"{folder}/written/half={number}", f"{folder}/topic/{number}")
        _finish(_flatten(spark, folder, recursiveFileLookup="true"))
    return _flattened(spark, folder)


def invoice_job(spark: SparkSession, sf_dir: str, result: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """Both queries of the job together on one stream, with the default trigger: they run until they are stopped.

    When all records are taken in, one is stopped; waiting for any of the two then ends, and the other is stopped.
    """
    folder = _topic_folder(spark, sf_dir)
    publish = partial(_write_messages, f"{folder}/messages", available_now=False)
    output, checkpoints = f"{folder}/output", f"{folder}/checkpoints"
    started = start_queries(_stream(spark, folder), publish, output, checkpoints, output_options=COMPRESSED)
    try:
        for query in started:
            query.processAllAvailable()
        started[0].stop()
        wait_for_any(started)
    finally:
        for query in started:
            query.stop()
    return result(spark, folder)


def _topic_folder(spark: SparkSession, sf_dir: str) -> str:
    """A new run folder with the order topic as files."""
    folder = run_folder(spark)
    order_topic(spark, sf_dir).write.parquet(f"{folder}/topic")
    return folder


def _stream(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The topic files as a stream; ``options`` go to the source, such as ``maxFilesPerTrigger``."""
    return read_topic_files(spark, f"{folder}/topic", **options)


def _publish(folder: str) -> Callable[[DataFrame, str], StreamingQuery]:
    """Files in place of the notification topic."""
    return partial(_write_messages, f"{folder}/messages")


def _write_messages(path: str, messages: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    return write_files(messages, path, checkpoint, NOTIFICATION_QUERY, "parquet", available_now)


def _published(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MESSAGE_SCHEMA).parquet(f"{folder}/messages")


def _flatten(spark: SparkSession, folder: str, **options: str) -> StreamingQuery:
    rows = flatten_line_items(parse_invoices(_stream(spark, folder, **options)))
    return write_files(rows, f"{folder}/output", f"{folder}/checkpoints/flatten", available_now=True, **COMPRESSED)


def _flattened(spark: SparkSession, folder: str) -> DataFrame:
    # A declared schema: the files leave null fields out, and inference would order the columns by name.
    return spark.read.schema(FLAT_SCHEMA).json(f"{folder}/output")


def _finish(*queries: StreamingQuery) -> None:
    """Wait until the queries have taken in all that is there; the failure of one is raised here."""
    for query in queries:
        query.awaitTermination()


QUERIES: dict[str, Query] = {
    "parse_invoices": parsed,
    "loyalty_points": points,
    "notification_messages": messages,
    "flatten_line_items": line_items,
    "unreadable_records": unreadable_records,
    "event_props": event_props,
    "notification_stream": notification_stream,
    "flatten_stream": flatten_stream,
    "restarted_stream": restarted_stream,
    "invoice_job": partial(invoice_job, result=_flattened),
    "invoice_job_messages": partial(invoice_job, result=_published),
}
