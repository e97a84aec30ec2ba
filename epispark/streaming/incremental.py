"""Monthly (or yearly/weekly) counts kept up to date as extract files land.

The registers are published as files that keep arriving (a new month or
year of records). This runs the batch time series (A3) as a Structured
Streaming query over a folder of Parquet files: each new file is recoded
with the same Column expressions and folded into a running count per
period. State holds one row per period (a few hundred per decade), so it
stays small whatever the volume; a query started again with the same
checkpoint folder goes on where it stopped.

A streaming query cannot run the batch filter's EXISTS subquery, so rows
without a valid date are simply not counted, which is what the batch
series does too.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.periods import period_start
from ..plans.recode import DATE, recode
from ..plans.roles import resolve_roles
from ..profiles import PROFILES, SourceProfile


def time_series_stream(spark: SparkSession, folder: str, schema: StructType, profile: SourceProfile | str,
                       freq: str = "month", max_files_per_trigger: Optional[int] = None) -> DataFrame:
    """Streaming ``periodo, n`` over the Parquet files of ``folder``."""
    if isinstance(profile, str):
        profile = PROFILES[profile]
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    raw = reader.parquet(folder)
    rec = recode(raw, resolve_roles(raw, profile))
    return (rec.where(F.col(DATE).isNotNull())
            .groupBy(period_start(F.col(DATE), freq).alias("periodo"))
            .agg(F.count(F.lit(1)).alias("n")))


def start_time_series_stream(spark: SparkSession, folder: str, schema: StructType, profile: SourceProfile | str,
                             table: str, checkpoint: str, freq: str = "month",
                             available_now: bool = False) -> StreamingQuery:
    """Start the query; after each batch the newest version of ``table`` holds
    the whole series (one row per period), for ``read_series``. A version is
    written apart and counts once it is complete, so readers see the last
    series or the one before, never a part; the one before last is removed.
    ``checkpoint`` is a folder of the query's own: started again with it, the
    query goes on where it stopped. ``available_now`` processes the files
    present and stops, which suits scheduled runs."""
    def version(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/version={number}")
        for old in versions(spark, table)[:-2]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/version={old}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    counts = time_series_stream(spark, folder, schema, profile, freq)
    writer = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(version)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def versions(spark: SparkSession, folder: str) -> list:
    """Numbers of the complete versions below a folder, rising."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)


def read_series(spark: SparkSession, table: str) -> Optional[DataFrame]:
    """``periodo, n`` of the newest complete version, None before the first."""
    found = versions(spark, table)
    return spark.read.parquet(f"{table}/version={found[-1]}") if found else None
