"""Names and places of the job.

Fixed values: source and sink formats, topics, query names, default broker, output folder and checkpoint folders.
"""

TOPIC_FORMAT = "kafka"
FILE_FORMAT = "json"

BROKER = "localhost:9092"
INVOICE_TOPIC = "invoices"
NOTIFICATION_TOPIC = "notifications"
STARTING_OFFSETS = "earliest"

NOTIFICATION_QUERY = "Notification Writer"
FLATTEN_QUERY = "Flattened Invoice Writer"

OUTPUT_PATH = "output"
CHECKPOINT_ROOT = "chk-point-dir"
NOTIFICATION_CHECKPOINT = "notify"
FLATTEN_CHECKPOINT = "flatten"
