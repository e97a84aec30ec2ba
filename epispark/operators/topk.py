"""Exact most frequent values of a column with very many.

Counting every value shuffles them all. Here a sketch names some frequent
values; their exact counts give a threshold that the n-th best reaches at
least. A value that reaches it lies in a bucket (of a hash of the values) whose
rows reach it, so only the values of such buckets are counted one by one. Ties
are kept, and the result does not depend on how good the sketch is: a poor one
only leaves more buckets. In a flat column all buckets stay, and the values
are counted as usual.
"""

from __future__ import annotations

from typing import Tuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.recode import WEIGHT, counted
from ..profiles import TOP_CATEGORY_N

#: Buckets of the hash, and values the sketch keeps: the driver sees at most so many numbers and values.
BUCKETS, TRACKED = 1 << 16, 4096


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("categoria"), F.lit(buckets))


def frequent_buckets(df: DataFrame, column: str, n: int, buckets: int = BUCKETS, tracked: int = TRACKED) -> Tuple[DataFrame, int]:
    """(``categoria`` (and weights) of the rows in buckets that may hold one of
    the ``n`` most frequent values, number of such buckets). Runs two small
    aggregates."""
    rows = df.select(F.col(column).cast("string").alias("categoria"), *(c for c in (WEIGHT,) if c in df.columns)).where("categoria is not null")
    named = rows.agg(F.expr(f"approx_top_k(categoria, {min(2 * n, tracked)}, {tracked})").alias("top")).first()["top"] or []
    known = [r["item"] for r in named]
    # one pass: rows of each bucket, and exact counts of the named values
    value = F.when(F.col("categoria").isin(known), F.col("categoria")) if known else F.lit(None).cast("string")
    counts = rows.groupBy(_bucket(buckets).alias("bucket"), value.alias("named")).agg(counted(rows).alias("n"))
    whole = counts.groupBy("bucket").agg(F.sum("n").alias("rows"), F.collect_list(F.when(F.col("named").isNotNull(), F.col("n"))).alias("exact"))
    seen = whole.agg(F.flatten(F.collect_list("exact")).alias("exact"),
                     F.collect_list(F.array(F.col("bucket").cast("long"), "rows")).alias("all")).first()
    exact = sorted(seen["exact"], reverse=True)
    least = exact[n - 1] if len(exact) >= n else 0
    hot = [bucket for bucket, size in seen["all"] if size >= least]
    return rows.where(_bucket(buckets).isin(hot)) if len(hot) < buckets else rows, len(hot)


def top_values(df: DataFrame, column: str, n: int = TOP_CATEGORY_N, buckets: int = BUCKETS, tracked: int = TRACKED) -> DataFrame:
    """``categoria, n``: the ``n`` most frequent non-null values, as
    ``quality.top_category`` gives them, for columns of very many values."""
    rows, _ = frequent_buckets(df, column, n, buckets, tracked)
    return (rows.groupBy("categoria").agg(counted(rows).alias("n"))
            .orderBy(F.desc("n"), F.asc_nulls_last("categoria")).limit(n))
