"""Append-mode streaming sinks. Each takes a query name and a checkpoint folder, and returns the started query."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tillstream.settings import (
    BROKER,
    FILE_FORMAT,
    FLATTEN_QUERY,
    NOTIFICATION_QUERY,
    NOTIFICATION_TOPIC,
    TOPIC_FORMAT,
)


def write_topic(
    messages: DataFrame,
    checkpoint: str,
    broker: str = BROKER,
    topic: str = NOTIFICATION_TOPIC,
    name: str = NOTIFICATION_QUERY,
    available_now: bool = False,
    **options: str,
) -> StreamingQuery:
    """Publish ``key``, ``value`` rows to a Kafka topic, at least once."""
    return (
        _append(messages, name, checkpoint, available_now)
        .format(TOPIC_FORMAT)
        .option("kafka.bootstrap.servers", broker)
        .option("topic", topic)
        .options(**options)
        .start()
    )


def write_files(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    name: str = FLATTEN_QUERY,
    format: str = FILE_FORMAT,
    available_now: bool = False,
    **options: str,
) -> StreamingQuery:
    """Append rows to files under ``path``, exactly once for readers that go by the sink's own file log."""
    return _append(rows, name, checkpoint, available_now).format(format).options(**options).start(path)


def _append(rows: DataFrame, name: str, checkpoint: str, available_now: bool) -> DataStreamWriter:
    writer = rows.writeStream.queryName(name).outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if available_now else writer
