"""Declared schemas of the four record kinds, as DDL text.

Fixed values: field names, types and order are the wire contract of the invoice topic, the notification topic and the
line-item files. Every field is nullable.
"""

#: One invoice document. Fields of the text that are not listed here are ignored when parsing.
INVOICE_SCHEMA = """
    InvoiceNumber string,
    CreatedTime bigint,
    StoreID string,
    PosID string,
    CashierID string,
    CustomerType string,
    CustomerCardNo string,
    TotalAmount double,
    NumberOfItems int,
    PaymentMethod string,
    CGST double,
    SGST double,
    CESS double,
    DeliveryType string,
    DeliveryAddress struct<
        AddressLine: string, City: string, State: string, PinCode: string, ContactNumber: string>,
    InvoiceLineItems array<struct<
        ItemCode: string, ItemDescription: string, ItemPrice: double, ItemQty: int, TotalValue: double>>
"""

#: A topic record, as Spark's Kafka source delivers it.
TOPIC_SCHEMA = """
    key binary,
    value binary,
    topic string,
    partition int,
    offset bigint,
    timestamp timestamp,
    timestampType int
"""

#: A notification: the invoice number and the JSON text sent for it.
MESSAGE_SCHEMA = "key string, value string"

#: One line item with the header fields of its invoice.
FLAT_SCHEMA = """
    InvoiceNumber string,
    CreatedTime bigint,
    StoreID string,
    PosID string,
    CustomerType string,
    PaymentMethod string,
    DeliveryType string,
    City string,
    State string,
    PinCode string,
    ItemCode string,
    ItemDescription string,
    ItemPrice double,
    ItemQty int,
    TotalValue double
"""
