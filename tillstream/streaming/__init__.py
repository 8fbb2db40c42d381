"""Streaming sinks."""

from tillstream.streaming.sinks import write_files, write_topic

__all__ = ["write_files", "write_topic"]
