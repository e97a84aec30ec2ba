"""The streaming time series equals the batch one once all files are in."""

import os

from pyspark.sql import functions as F

from epispark.catalog.queries import register
from epispark.operators import series
from epispark.sources.fixtures import fixture_projection
from epispark.streaming import read_series, start_time_series_stream, versions

from conftest import SF_SMALL


def test_stream_matches_batch(spark, tmp_dir):
    raw = fixture_projection(spark, SF_SMALL, "deaths")
    folder = f"{tmp_dir}/arriving"
    # two deliveries: rows split by key parity, as two extract files
    with_key = raw.withColumn("_k", F.monotonically_increasing_id())
    with_key.where(F.col("_k") % 2 == 0).drop("_k").write.parquet(f"{folder}/part=a")
    with_key.where(F.col("_k") % 2 == 1).drop("_k").write.parquet(f"{folder}/part=b")
    table, checkpoint = f"{tmp_dir}/table", f"{tmp_dir}/checkpoint"
    batch = sorted(tuple(r) for r in series.time_series(register(spark, SF_SMALL, "deaths").filtered(), "month").collect())

    def run_once():
        start_time_series_stream(spark, folder, raw.schema, "SIM", table, checkpoint, available_now=True).awaitTermination(120)
        return sorted(tuple(r) for r in read_series(spark, table).collect())

    assert run_once() == batch
    # started again with its checkpoint it counts only what is new
    raw.limit(0).unionByName(raw.where("DTOBITO is null")).write.parquet(f"{folder}/part=c")
    assert run_once() == batch
    assert len(versions(spark, table)) == 2
    # a version that is being written does not count
    spark.range(1).write.parquet(f"{table}/version=9")
    os.remove(f"{table}/version=9/_SUCCESS")
    assert sorted(tuple(r) for r in read_series(spark, table).collect()) == batch
