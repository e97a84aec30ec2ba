"""Parquet sources, fixture views and sinks."""
