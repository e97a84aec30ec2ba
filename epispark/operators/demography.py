"""Age distribution and age pyramid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.periods import band_label, band_start
from ..plans.recode import AGE, SEX, WEIGHT, counted
from ..profiles import SEX_FEMALE, SEX_MALE


def _banded(df: DataFrame, width: int, *sex: Column) -> DataFrame:
    """Rows reduced to band (null outside of 0 to 120) and, if asked, sex (null
    but for male and female), with ``_vale`` where none is null. Counting that
    drops the other rows after the aggregate; a filter would evaluate age and
    sex a second time below the projection."""
    band = F.when(F.col(AGE).between(0, 120), band_start(F.col(AGE), width)).alias("faixa_ini")
    rows = df.select(*sex, band, *(c for c in (WEIGHT,) if c in df.columns))
    there = F.col("faixa_ini").isNotNull()
    for c in ("sexo",) if sex else ():
        there = there & F.col(c).isNotNull()
    return rows.withColumn("_vale", F.when(there, 1))


def age_distribution(df: DataFrame, width: int = 5) -> DataFrame:
    """``faixa_ini, n, faixa``: counts per five-year band of ages 0–120."""
    rows = _banded(df, width)
    return (rows.groupBy("faixa_ini").agg(counted(rows, "_vale").alias("n")).where(F.col("n") > 0)
            .withColumn("faixa", band_label(F.col("faixa_ini"), width))
            .orderBy("faixa_ini"))


def age_pyramid(df: DataFrame, width: int = 5) -> DataFrame:
    """``sexo, faixa_ini, n, faixa, valor`` for male/female rows; ``valor``
    is negative for males (the left side of the pyramid)."""
    rows = _banded(df, width, F.when(F.col(SEX).isin(SEX_MALE, SEX_FEMALE), F.col(SEX)).alias("sexo"))
    return (rows.groupBy("sexo", "faixa_ini").agg(counted(rows, "_vale").alias("n")).where(F.col("n") > 0)
            .withColumn("faixa", band_label(F.col("faixa_ini"), width))
            .withColumn("valor", F.when(F.col("sexo") == SEX_MALE, -F.col("n")).otherwise(F.col("n")))
            .orderBy("faixa_ini", "sexo"))
