"""Structured Streaming over blobs (an extension)."""

from .pack import pack_stream, pattern_counts

__all__ = ["pack_stream", "pattern_counts"]
