"""Aggregates over recoded frames: DataFrame in, DataFrame out."""
