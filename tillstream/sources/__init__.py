"""Topic sources."""

from tillstream.sources.tables import order_topic, text_topic
from tillstream.sources.topic import read_topic, read_topic_files

__all__ = ["order_topic", "read_topic", "read_topic_files", "text_topic"]
