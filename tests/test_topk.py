"""Most frequent values by buckets equal a plain count."""

import pytest
from pyspark.sql import functions as F

from epispark.operators import quality, topk
from epispark.plans.cube import digest


def both(df, n, **sizes):
    got = [tuple(r) for r in topk.top_values(df, "v", n, **sizes).collect()]
    assert got == [tuple(r) for r in quality.top_category(df, "v", n).collect()]
    return got


def long_tail(spark, frequent=20, rare=30_000):
    """Values of falling frequency among many that occur once or twice, some nulls."""
    some = spark.range(frequent).select(F.explode(F.sequence(F.lit(1), 400 - 7 * F.col("id"))).alias("i"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    many = spark.range(rare).select(F.col("id").alias("i"), F.when(F.col("id") % 50 > 0, F.sha2((F.col("id") / 2).cast("long").cast("string"), 256)).alias("v"))
    return some.select("v").unionByName(many.select("v"))


def test_only_buckets_of_frequent_values_are_counted(spark):
    df = long_tail(spark)
    assert len(both(df, 12, tracked=256)) == 12
    rows, hot = topk.frequent_buckets(df, "v", 12, tracked=256)
    assert hot == 12 and rows.select("categoria").distinct().count() < 40  # of some 15,000 values


@pytest.mark.parametrize("buckets", [1, 64, 4096])
def test_any_number_of_buckets_and_a_poor_sketch(spark, buckets):
    both(long_tail(spark, 8, 3000), 10, buckets=buckets, tracked=10)


def test_ties_flat_columns_nulls_and_no_rows(spark):
    ties = spark.createDataFrame([(x,) for x in "aabbccddeeff" + "ghij"] + [(None,)] * 5 + [("",)] * 2, "v string")
    assert both(ties, 3) == [("", 2), ("a", 2), ("b", 2)]
    both(ties, 50), both(ties.limit(0), 3), both(ties.where("v is null"), 3)
    both(spark.range(500).select(F.col("id").cast("string").alias("v")), 5)


def test_cube_rows_count_for_what_they_stand_for(spark):
    df = long_tail(spark, 8, 500).select(F.col("v").alias("ep_municipio"))
    assert [tuple(r) for r in topk.top_values(digest(df), "ep_municipio", 5).collect()] == [
        tuple(r) for r in quality.top_category(df, "ep_municipio", 5).collect()]
