"""Row operators on streams."""

from quire.streaming.classify import read_file_stream, stream_decisions, stream_file_blocks

__all__ = ["read_file_stream", "stream_decisions", "stream_file_blocks"]
