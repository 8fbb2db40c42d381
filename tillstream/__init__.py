"""Retail invoices from a topic to loyalty notifications and flat line items, with Structured Streaming."""
