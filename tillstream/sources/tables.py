"""Invoice topic records built from the order tables: each order is one record, the invoice with all its line items."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream.functions import json_text
from tillstream.settings import INVOICE_TOPIC


def order_topic(
    spark: SparkSession, sf_dir: str, keys: Callable[[Column], Column] | None = None
) -> DataFrame:
    """The orders under ``sf_dir`` as topic records, or those whose key meets the condition ``keys``.

    The line items of an order are one group, since they become one document; no job runs before the records are asked
    for. Orders and lines are each shuffled by order key once.
    """
    # A line without order is in no invoice. There may be many of them, and they would all be one group.
    lineitem = _table(spark, sf_dir, "lineitem").filter(F.col("l_orderkey").isNotNull())
    orders = _orders(spark, sf_dir)
    if keys is not None:
        lineitem, orders = lineitem.filter(keys(F.col("l_orderkey"))), orders.filter(keys(F.col("o_orderkey")))
    # Keys as text, so that orders without key can have one of their own: else they would all go to one task.
    no_key = F.concat(F.lit("none "), F.xxhash64("o_custkey", "o_orderdate", "o_totalprice").cast("string"))
    orders = orders.withColumn("order", F.coalesce(F.col("o_orderkey").cast("string"), no_key))
    # The shuffle is written out: rows travel before they are collected into arrays, which shrinks nothing.
    items = (
        _lines(lineitem, _table(spark, sf_dir, "part"))
        .repartition("order")
        .groupBy("order")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    return _records(orders.join(items, "order", "left"))


def text_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two topic records per document: its text, which is prose and so no invoice, and a short invoice about it."""
    invoice = json_text(
        F.col("doc_id").cast("string").alias("InvoiceNumber"),
        F.col("source").alias("CustomerCardNo"),
        F.col("n_chars").cast("double").alias("TotalAmount"),
    )
    return (
        _table(spark, sf_dir, "documents")
        .withColumn("record", F.explode(F.array("text", invoice)))
        .select(
            F.col("doc_id").cast("string").cast("binary").alias("key"),
            F.col("record").cast("binary").alias("value"),
            *_position(F.col("doc_id"), F.lit("1970-01-01 00:00:00")),
        )
    )


def _position(offset: Column, timestamp: Column) -> list[Column]:
    """The columns of a topic record after key and value."""
    return [
        F.lit(INVOICE_TOPIC).alias("topic"),
        F.lit(0).alias("partition"),
        offset.alias("offset"),
        timestamp.cast("timestamp").alias("timestamp"),
        F.lit(0).alias("timestampType"),
    ]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer and the customer's nation and region.

    One chain, so that Spark sees the file sizes of nation and region and broadcasts them by these.
    """
    return (
        _table(spark, sf_dir, "orders")
        .join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    )


def _lines(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Order key, as text, and line item. The field ItemQty is an int: a fraction of a quantity is cut off."""
    return lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").select(
        F.col("l_orderkey").cast("string").alias("order"),
        F.struct(
            "l_linenumber",
            F.col("l_partkey").cast("string").alias("ItemCode"),
            F.col("p_name").alias("ItemDescription"),
            F.col("p_retailprice").alias("ItemPrice"),
            F.col("l_quantity").cast("int").alias("ItemQty"),
            F.col("l_extendedprice").alias("TotalValue"),
        ).alias("item"),
    )


def _records(invoices: DataFrame) -> DataFrame:
    """Orders with their sorted line items to topic records."""
    number = F.col("o_orderkey").cast("string")
    card = F.col("o_custkey").cast("string")
    total = F.col("o_totalprice")
    at_home = F.col("o_orderstatus") == "O"
    # Whole milliseconds since 1970 of a timestamp without time zone, whatever the session's time zone.
    created = F.expr(
        "cast(cast(cast(o_orderdate - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(18, 6))"
        " * 1000 as bigint)"
    )
    document = json_text(
        number.alias("InvoiceNumber"),
        created.alias("CreatedTime"),
        F.concat(F.lit("STR"), F.col("c_nationkey").cast("string")).alias("StoreID"),
        F.concat(F.lit("POS"), (F.col("o_custkey") % 100).cast("string")).alias("PosID"),
        F.concat(F.lit("OAS"), (F.col("o_orderkey") % 50).cast("string")).alias("CashierID"),
        F.when(F.col("c_mktsegment") == "BUILDING", "PRIME").otherwise("NONPRIME").alias("CustomerType"),
        card.alias("CustomerCardNo"),
        total.alias("TotalAmount"),
        F.coalesce(F.array_size("items"), F.lit(0)).alias("NumberOfItems"),
        F.when(F.col("o_orderpriority") < "3", "CARD").otherwise("CASH").alias("PaymentMethod"),
        total.alias("TaxableAmount"),
        (total * 0.025).alias("CGST"),
        (total * 0.025).alias("SGST"),
        (total * 0.00125).alias("CESS"),
        F.when(at_home, "HOME-DELIVERY").otherwise("TAKEAWAY").alias("DeliveryType"),
        F.when(
            at_home,
            F.struct(
                F.col("c_name").alias("AddressLine"),
                F.col("n_name").alias("City"),
                F.col("r_name").alias("State"),
                F.when(number.isNotNull(), F.format_string("%06d", "o_orderkey")).alias("PinCode"),
                card.alias("ContactNumber"),
            ),
        ).alias("DeliveryAddress"),
        F.transform("items", lambda item: item.dropFields("l_linenumber")).alias("InvoiceLineItems"),
    )
    return invoices.select(
        number.cast("binary").alias("key"),
        document.cast("binary").alias("value"),
        *_position(F.col("o_orderkey"), F.col("o_orderdate")),
    )
