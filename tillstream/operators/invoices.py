"""The invoice pipeline as narrow DataFrame operators: no shuffle, no state, no Python rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.functions import earned_points, json_text, parsed_json
from tillstream.schemas import INVOICE_SCHEMA

# The header and address columns of a flat line item, in output order.
HEADER_FIELDS = ("InvoiceNumber", "CreatedTime", "StoreID", "PosID", "CustomerType", "PaymentMethod", "DeliveryType")
ADDRESS_FIELDS = ("City", "State", "PinCode")


def parse_invoices(records: DataFrame, *keep: str) -> DataFrame:
    """Topic records to one struct column ``value``. A record that cannot be parsed stays, with nulls.

    The columns ``keep`` of the records stay next to it; so they do in the next two operators.
    """
    return records.select(*keep, parsed_json(F.col("value"), INVOICE_SCHEMA).alias("value"))


def loyalty_points(invoices: DataFrame, *keep: str) -> DataFrame:
    """Points for every parsed invoice, whatever its customer type."""
    fields = ("value.InvoiceNumber", "value.CustomerCardNo", "value.TotalAmount")
    return invoices.select(*keep, *fields).withColumn("EarnedLoyaltyPoints", earned_points(F.col("TotalAmount")))


def notification_messages(points: DataFrame, *keep: str) -> DataFrame:
    """One keyed message per row of :func:`loyalty_points`."""
    return points.select(
        *keep,
        F.col("InvoiceNumber").alias("key"),
        json_text("CustomerCardNo", "TotalAmount", "EarnedLoyaltyPoints").alias("value"),
    )


def flatten_line_items(invoices: DataFrame) -> DataFrame:
    """One flat row per line item of a parsed invoice, null items included; an invoice without items gives none."""
    header = [F.col("value")[field].alias(field) for field in HEADER_FIELDS]
    address = [F.col("value.DeliveryAddress")[field].alias(field) for field in ADDRESS_FIELDS]
    # Without coalesce, Catalyst would infer a filter on the array and run it below the parse, so that each record is
    # parsed twice.
    items = F.coalesce("value.InvoiceLineItems", F.array())
    return invoices.select(*header, *address, F.inline(items))
