"""Reference tables as DataFrames: the code rules (R1) and the operational
field guide (R2). Both are small constants shown beside a report; they are
built from ``profiles`` so the labels used by the recodes and the table
shown to readers cannot drift apart."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, SparkSession

from ..profiles import CODE_RULES, FIELD_GUIDE


def code_rules(spark: SparkSession) -> DataFrame:
    """``grupo, padrao, rotulo`` in matching order."""
    rows = [(g, pattern, label) for g, _prefix, label, pattern in CODE_RULES]
    return spark.createDataFrame(rows, "grupo string, padrao string, rotulo string")


def field_guide(spark: SparkSession, base: Optional[str] = None) -> DataFrame:
    """``base, campo, uso, leitura, observação`` for one register or all."""
    rows = [(b, *r) for b, entries in FIELD_GUIDE.items() if base in (None, b) for r in entries]
    return spark.createDataFrame(rows, "base string, campo string, uso string, leitura string, `observação` string")
