"""Sinks and consolidation: CSV export (S5), per-year consolidation
and territory cuts (S7)."""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.recode import CODE, CODE_GROUP, DATE, MUNICIPALITY, YEAR, YEAR_MARK
from ..profiles import CODE_RULES

MENINGITIS_GROUPS = tuple(r[0] for r in CODE_RULES)
#: Row groups of a consolidated table, so that sorted rows give many ranges to skip.
ROW_GROUP_BYTES = 16 << 20


def export_csv(df: DataFrame, out_dir: str, mode: str = "overwrite") -> str:
    """Write ``df`` as UTF-8 CSV with a header (S5). One file per task; values
    keep their spaces, and quotes in them are doubled, as spreadsheets and
    other readers expect; no byte-order mark is written."""
    (df.write.mode(mode).option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(out_dir))
    return out_dir


def territory_predicate(code: Optional[str], column: str = MUNICIPALITY) -> Optional[Column]:
    """Municipality codes come with 6 or 7 digits (check digit). A 2-digit
    code selects a state, a 6/7-digit code one municipality (compared on
    its first six digits), None/``""`` selects everything (S7). Any other
    code raises ``ValueError``."""
    code = (code or "").strip()
    if not code:
        return None
    if not code.isdigit() or len(code) not in (2, 6, 7):
        raise ValueError(f"a territory code has 2, 6 or 7 digits: {code!r}")
    if len(code) == 2:
        return F.substring(F.col(column), 1, 2) == code
    return F.substring(F.col(column), 1, 6) == code[:6]


def territory_cut(df: DataFrame, code: Optional[str], column: str = MUNICIPALITY) -> DataFrame:
    pred = territory_predicate(code, column)
    return df if pred is None else df.where(pred)


def with_year(df: DataFrame) -> DataFrame:
    """``ano`` from the parsed date; a raw column of that name (in any case)
    is kept as ``raw_ano``. The date column names ``ano`` in its metadata, so
    that a year filter knows it from a raw column."""
    own = [c for c in df.columns if c.lower() == YEAR]
    df = df.withColumnsRenamed({c: f"raw_{YEAR}" for c in own}).withMetadata(DATE, {**df.schema[DATE].metadata, YEAR_MARK: YEAR})
    return df.withColumn(YEAR, F.year(F.col(DATE)).cast("int"))


def write_years(df: DataFrame, out_dir: str, max_records_per_file: int = 5_000_000, only_years: bool = False,
                row_group_bytes: int = ROW_GROUP_BYTES, indexed: Sequence[str] = ()) -> None:
    """Write rows that have ``ano`` in a folder per year, replacing the whole
    table or, with ``only_years``, just the years that occur.

    A ``rebalance`` on the year lets adaptive execution size the write
    partitions: a year holding a third of all rows is split over several
    tasks, small years are coalesced. Each task sorts its rows by municipality
    and code within the year, so row groups and pages hold narrow ranges of
    both, and a filter on either reads few of them (by statistics, page
    indexes, dictionaries or bloom filters)."""
    keys = [c for c in (MUNICIPALITY, CODE) if c in df.columns]
    writer = (df.hint("rebalance", YEAR).sortWithinPartitions(F.col(YEAR), *keys)
              .write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if only_years else "static")
              .option("maxRecordsPerFile", int(max_records_per_file)).option("parquet.block.size", int(row_group_bytes)))
    for c in [*keys, *indexed]:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.partitionBy(YEAR).parquet(out_dir)


def consolidate_by_year(df: DataFrame, out_dir: str, groups: Sequence[str] = MENINGITIS_GROUPS,
                        territory: Optional[str] = None, max_records_per_file: int = 5_000_000) -> str:
    """Keep rows whose detected code is in ``groups`` (and in the territory),
    and write them as Parquet partitioned by ``ano`` (S6). ``df`` is a
    recoded register with all its raw columns (``keep_all``). A year range of
    ``apply_filters`` prunes the folders when the table is read back.

    The kept rows are a small part of the input, so writing straight from
    the scan tasks would leave thousands of tiny files per year; see
    ``write_years``. Rows without a valid date go to the default (NULL)
    partition; ``max_records_per_file`` caps any single file.
    """
    kept = territory_cut(df.where(F.col(CODE_GROUP).isin(list(groups))), territory)
    write_years(with_year(kept), out_dir, max_records_per_file)
    return out_dir
