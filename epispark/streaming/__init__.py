"""Incremental form of the time-series count for arriving extract files."""

from .incremental import read_series, start_time_series_stream, versions

__all__ = ["read_series", "start_time_series_stream", "versions"]
