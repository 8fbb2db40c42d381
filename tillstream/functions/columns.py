"""Column functions: parse JSON text, compute points, write JSON text. All of them run inside the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: loyalty points per unit of money.
POINTS_PER_UNIT = 0.2


def parsed_json(payload: Column, schema: str) -> Column:
    """The struct read from JSON text or from its UTF-8 bytes.

    Parsing is permissive: a field of the wrong type is null, text that is no JSON object is a struct of nulls, and a
    null or blank payload is null. No record is lost.
    """
    return F.from_json(payload.cast("string"), schema)


def earned_points(amount: Column) -> Column:
    """Points for an amount, in plain double arithmetic: not rounded, negative for a negative amount."""
    return amount * F.lit(POINTS_PER_UNIT)


def json_text(*fields: Column | str) -> Column:
    """The fields as one JSON object, in the given order. Null fields are left out, so the text may be ``{}``."""
    return F.to_json(F.struct(*fields))
