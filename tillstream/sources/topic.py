"""Streaming sources of topic records."""

from pyspark.sql import DataFrame, SparkSession

from tillstream.schemas import TOPIC_SCHEMA
from tillstream.settings import BROKER, INVOICE_TOPIC, STARTING_OFFSETS, TOPIC_FORMAT


#: A hundred years: no file is left out for its age.
ANY_AGE = "36500d"


def read_topic(spark: SparkSession, broker: str = BROKER, topic: str = INVOICE_TOPIC, **options: str) -> DataFrame:
    """A Kafka topic as a stream, from its first record unless a checkpoint or an option says otherwise.

    ``options`` go to Spark's Kafka source as they are. For a large backlog give ``minPartitions`` (cuts a partition
    that holds much of the topic into several tasks) and ``maxOffsetsPerTrigger`` (bounds a micro-batch).
    """
    return (
        spark.readStream.format(TOPIC_FORMAT)
        .option("kafka.bootstrap.servers", broker)
        .option("subscribe", topic)
        .option("startingOffsets", STARTING_OFFSETS)
        .options(**options)
        .load()
    )


def read_topic_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Topic records kept as parquet files, as a stream: each file that arrives in ``path`` is read once.

    Files are read however much older they are than the newest one read. ``options`` go to Spark's file source as they
    are: ``maxFilesPerTrigger`` bounds a micro-batch, and a smaller ``maxFileAge`` bounds the list of files that the source
    remembers, where none arrives later than that.
    """
    return spark.readStream.schema(TOPIC_SCHEMA).options(**{"maxFileAge": ANY_AGE} | options).parquet(path)
