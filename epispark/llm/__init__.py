"""Operators of a training-data pipeline. Nothing outside this subpackage
imports it; ``queries.QUERIES`` holds what the driver entry registers."""
