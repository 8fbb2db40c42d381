"""DataFrame operators. Each holds for a batch and for a stream alike."""

from tillstream.operators.invoices import (
    flatten_line_items,
    loyalty_points,
    notification_messages,
    parse_invoices,
)

__all__ = ["flatten_line_items", "loyalty_points", "notification_messages", "parse_invoices"]
