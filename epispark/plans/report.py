"""A register report: read -> resolve roles -> recode once -> filter ->
every aggregate of the standard report.

The recode holds the expensive expressions (regexes, date parsing). When
many aggregates run over one register, computing it once pays off; three
strategies are offered:

* ``None`` — each aggregate recomputes only the columns it needs (column
  pruning reaches the Parquet scan); best for one-off questions;
* ``"persist"`` — ``MEMORY_AND_DISK`` cache of the narrow recoded frame
  (role columns only, typically 10–20 instead of 100+); lost blocks are
  recomputed from lineage if an executor dies;
* ``"table"`` — write the recoded frame to Parquet under the shared
  ``spark.checkpoint.dir`` and read it back: lineage is cut, the result
  survives executor loss, and later filters on ``ep_data`` etc. are pushed
  into the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Dict, Mapping, Optional

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..operators import codes as codes_ops
from ..operators import demography, quality, series
from ..profiles import PROFILES, SourceProfile
from ..session import scratch_path
from .recode import (
    AGE,
    CODE,
    DATE,
    DEFAULT_FILTERS,
    DIAGNOSIS,
    MUNICIPALITY,
    OUTCOME,
    SEX,
    WEIGHT,
    Filters,
    apply_filters,
    has_valid_date,
    recode,
)
from .roles import Roles, resolve_roles


@dataclass
class Register:
    name: str
    raw: DataFrame
    roles: Roles
    recoded: DataFrame
    _filtered: Dict[Filters, DataFrame] = field(default_factory=dict, repr=False)
    _has_valid: Optional[bool] = field(default=None, repr=False)

    def has_valid_date(self) -> bool:
        """Whether any row has a valid date — asked once per register (a
        ``LIMIT 1`` probe), like the year slider of a report is set once."""
        if self._has_valid is None:
            self._has_valid = has_valid_date(self.recoded)
        return self._has_valid

    def _known_validity(self, filters: Filters) -> Optional[bool]:
        return self.has_valid_date() if filters.years == "bounds" and DATE in self.recoded.columns else None

    def filtered(self, filters: Filters = DEFAULT_FILTERS) -> DataFrame:
        """The recoded frame under ``filters`` (the lazy plan is built once
        per distinct filter)."""
        try:
            hit = self._filtered.get(filters)
        except TypeError:  # unhashable selections (lists): no memo
            return apply_filters(self.recoded, filters, self._known_validity(filters))
        if hit is None:
            hit = self._filtered[filters] = apply_filters(self.recoded, filters, self._known_validity(filters))
        return hit

    def dated(self, filters: Filters = DEFAULT_FILTERS) -> DataFrame:
        """For operators that leave out rows without a date themselves: the
        default year filter, which only does that too, is dropped."""
        return self.filtered(replace(filters, years=None) if filters.years == "bounds" else filters)


def materialize(df: DataFrame, how: Optional[str], spark: Optional[SparkSession] = None) -> DataFrame:
    if how is None:
        return df
    if how == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if how == "table":
        spark = spark or df.sparkSession
        path = scratch_path(spark, "recoded")
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    raise ValueError(f"unknown materialization {how!r}")


def open_register(raw: DataFrame, profile: SourceProfile | str, materialize_as: Optional[str] = None,
                  roles: Optional[Roles] = None, keep_all: bool = False, **overrides) -> Register:
    """Resolve roles (or take ``roles`` as given), recode, optionally
    materialise. Keyword overrides replace single detected roles;
    ``keep_all`` carries every raw column along."""
    if isinstance(profile, str):
        profile = PROFILES[profile]
    if roles is None:
        roles = resolve_roles(raw, profile, **overrides)
    rec = materialize(recode(raw, roles, keep_all=keep_all), materialize_as, raw.sparkSession)
    return Register(profile.name, raw, roles, rec)


def standard_report(reg: Register, filters: Filters = DEFAULT_FILTERS, freq: str = "month",
                    by_type: bool = False) -> Dict[str, DataFrame]:
    """Every table of one register's report, as lazy DataFrames."""
    rec = reg.recoded
    df = reg.filtered(filters)
    cols = set(df.columns)
    out: Dict[str, DataFrame] = {"dataset_metrics": quality.dataset_metrics(df)}
    opts = quality.filter_options(rec)
    if opts is not None:
        out["filter_options"] = opts
    if DATE in cols:
        out["year_bounds"] = quality.year_bounds(rec)
        dated = reg.dated(filters)
        out["time_series"] = (series.time_series_by(dated, freq) if by_type and CODE in cols
                              else series.time_series(dated, freq))
        out["heatmap_long"] = series.month_heatmap(dated)
        out["heatmap_pivot"] = series.heatmap_pivot(dated)
    if CODE in cols:
        out["type_distribution"] = codes_ops.type_distribution(df)
        out["top_codes"] = codes_ops.top_codes(df)
        out["code_origin"] = codes_ops.code_origin_counts(df)
        if WEIGHT not in cols:  # a cube has no rows of its own
            out["enriched_rows"] = quality.enriched_rows(df, reg.roles)
    if AGE in cols:
        out["age_distribution"] = demography.age_distribution(df)
        if SEX in cols:
            out["age_pyramid"] = demography.age_pyramid(df)
    for key, col in (("top_diagnosis", DIAGNOSIS), ("top_outcome", OUTCOME), ("top_municipality", MUNICIPALITY)):
        if col in cols:
            out[key] = quality.top_category(df, col)
    miss = quality.missingness(df)
    if miss is not None:
        out["missingness"] = miss
    return out


def comparison(registers: Mapping[str, Register], filters: Filters = DEFAULT_FILTERS, freq: str = "month",
               by_type: bool = False, index100: bool = False) -> Dict[str, DataFrame]:
    """Cross-register tables (X1, X2); needs at least two dated registers."""
    dated = {n: r.filtered(filters) for n, r in registers.items() if DATE in r.recoded.columns}
    if len(dated) < 2:
        return {}
    out = {}
    s = series.compare_series({n: registers[n].dated(filters) for n in dated}, freq, by_type, index100)
    if s is not None:
        out["compare_series"] = s
    t = codes_ops.compare_types(dated)
    if t is not None:
        out["compare_types"] = t
    return out
