"""Time series, seasonality and cross-register comparison.

All inputs are recoded frames (see ``plans.recode``), already filtered.
Every aggregate is a hash aggregate with a map-side partial step, so the
shuffle carries at most (#partitions × #groups) rows whatever the skew.
"""

from __future__ import annotations

from typing import Mapping, Optional

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import code_type
from ..functions.periods import month_of, period_start, year_of
from ..plans.recode import CODE, CODE_TYPE, DATE, counted, rules_of

MONTHS = list(range(1, 13))


def _series_counts(df: DataFrame, freq: str) -> DataFrame:
    # Counting the date drops the rows without one after the aggregate; a
    # filter would parse the date a second time below the projection.
    return (df.groupBy(period_start(F.col(DATE), freq).alias("periodo"))
            .agg(counted(df, DATE).alias("n")).where(F.col("n") > 0))


def _series_counts_by(df: DataFrame, freq: str, category: str) -> DataFrame:
    rules = rules_of(df) if category == CODE_TYPE else None
    key = CODE if rules else category
    counts = (df.groupBy(period_start(F.col(DATE), freq).alias("periodo"), F.col(key).alias("_chave"))
              .agg(counted(df, DATE).alias("n")).where(F.col("n") > 0))
    if not rules:
        return counts.where(F.col("_chave").isNotNull()).select("periodo", F.col("_chave").alias("categoria"), "n")
    # labels from the codes that are left
    return counts.groupBy("periodo", code_type(F.col("_chave"), rules).alias("categoria")).agg(F.sum("n").alias("n"))


def time_series(df: DataFrame, freq: str = "month", by: Optional[str] = None) -> DataFrame:
    """``periodo, n``: rows with a valid date per period start (A3); with
    ``by`` (a canonical column, e.g. the code label) ``periodo, categoria, n``."""
    if by is not None:
        return time_series_by(df, freq, by)
    return _series_counts(df, freq).orderBy("periodo")


def time_series_by(df: DataFrame, freq: str = "month", category: str = CODE_TYPE) -> DataFrame:
    """``periodo, categoria, n`` (A4); rows without a category are dropped."""
    return _series_counts_by(df, freq, category).orderBy("periodo", "categoria")


def month_heatmap(df: DataFrame, pivot: bool = False) -> DataFrame:
    """``ano, mes, n`` long form (A6); ``pivot=True`` gives the month columns."""
    if pivot:
        return heatmap_pivot(df)
    return (df.groupBy(year_of(F.col(DATE)).alias("ano"), month_of(F.col(DATE)).alias("mes"))
            .agg(counted(df, DATE).alias("n")).where(F.col("n") > 0)
            .orderBy("ano", "mes"))


def heatmap_pivot(df: DataFrame) -> DataFrame:
    """``ano`` plus one column per month ``"1"``..``"12"``, missing month = 0
    (A6b). Years without data get no row. The month list is explicit, so
    Spark skips the extra job that would discover the pivot values."""
    long = month_heatmap(df)
    wide = long.groupBy("ano").pivot("mes", MONTHS).agg(F.sum("n"))
    return wide.na.fill(0, [str(m) for m in MONTHS]).orderBy("ano")


def index_base100(df: DataFrame, series: str = "serie", order: str = "periodo",
                  value: str = "valor") -> DataFrame:
    """Divide each series by its first non-null, non-zero value (in
    ``order``) and multiply by 100; a series without one is unchanged (W1).

    Runs on aggregated series only, partitioned by series.
    """
    w = (Window.partitionBy(series).orderBy(F.col(order).asc_nulls_last())
         .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    base = F.first(F.when(F.col(value) != 0, F.col(value)), ignorenulls=True).over(w)
    v = F.col(value).cast("double")
    return df.withColumn(value, F.when(base.isNull(), v).otherwise(v / base.cast("double") * 100.0))


def compare_series(bases: Mapping[str, DataFrame], freq: str = "month", by_type: bool = False,
                   index100: bool = False) -> Optional[DataFrame]:
    """``periodo, valor, base, serie[, categoria]`` over several registers.

    ``bases`` maps a register name to its recoded, filtered frame; bases
    without a date are skipped. With ``by_type`` a base that has codes is
    split by code label (``serie = base — label``). Frames are aligned by
    column name; a base without codes has a NULL ``categoria``. The
    per-base parts are combined unsorted and ordered once (base order, then
    period and category).
    """
    frames = []
    for rank, (name, df) in enumerate(bases.items()):
        if DATE not in df.columns:
            continue
        if by_type and CODE_TYPE in df.columns:
            ts = (_series_counts_by(df, freq, CODE_TYPE)
                  .withColumn("serie", F.concat(F.lit(name + " — "), F.col("categoria"))))
        else:
            ts = _series_counts(df, freq).withColumn("serie", F.lit(name))
        frames.append(ts.withColumnRenamed("n", "valor").withColumn("base", F.lit(name))
                      .withColumn("_rank", F.lit(rank)))
    return _combine(frames, index100)


def _combine(frames, index100: bool) -> Optional[DataFrame]:
    if not frames:
        return None
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    if index100:
        out = index_base100(out)
    has_cat = "categoria" in out.columns
    order = ["_rank", "periodo"] + (["categoria"] if has_cat else [])
    cols = ["periodo", "valor", "base", "serie"] + (["categoria"] if has_cat else [])
    return out.orderBy(*[F.col(c).asc_nulls_last() for c in order]).select(*cols)
