"""Arriving fetches as a stream."""

from .updates import fetch_stream, keep_index

__all__ = ["fetch_stream", "keep_index"]
