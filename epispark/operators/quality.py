"""Filter options, metrics, bounds, top categories, completeness and the
enriched row view (A1, A2, A5, A7, A13, A14)."""

from __future__ import annotations

from typing import Mapping, Optional, Tuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import percent, round_half_away
from ..functions.text import named, output_names
from ..plans.recode import (
    AGE,
    AGE_UNIT_TEXT,
    CODE,
    CODE_GROUP,
    CODE_ORIGIN,
    CODE_TYPE,
    DATE,
    DIAGNOSIS,
    MUNICIPALITY,
    OUTCOME,
    SEX,
    SEX_TEXT,
    WEIGHT,
    counted,
)
from ..plans.roles import Roles
from ..profiles import MISSING_LABELS, TOP_CATEGORY_N

# canonical column -> filter name, in report order
_OPTION_COLUMNS = ((SEX, "sexo"), (MUNICIPALITY, "municipio"), (OUTCOME, "desfecho"), (CODE_TYPE, "cid_tipo"))


def filter_options(df: DataFrame, limits: Optional[Mapping[str, int]] = None) -> Optional[DataFrame]:
    """``filtro, valor, n``: the values of each filterable field on
    *unfiltered* data (A1), by field, then count desc, then value; all of
    them, or the ``limits[filtro]`` most frequent.

    One scan: the fields are stacked into (filtro, valor) pairs and counted
    with a partial aggregate; limits cut per field with a row-number window
    (Spark inserts a per-partition group limit below the window shuffle).
    """
    present = [(c, name) for c, name in _OPTION_COLUMNS if c in df.columns]
    if not present:
        return None
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("filtro"), F.col(c).cast("string").alias("valor"))
                                for c, name in present]))
    stacked = df.select(pairs.alias("p"), *(c for c in (WEIGHT,) if c in df.columns)).where(F.col("p.valor").isNotNull())
    counts = stacked.groupBy("p.filtro", "p.valor").agg(counted(df).alias("n"))
    return top_per_field(counts, [name for _, name in present], limits)


def top_per_field(counts: DataFrame, fields, limits: Optional[Mapping[str, int]] = None) -> DataFrame:
    """``filtro, valor, n`` counts in order (count desc, then value), cut to
    the top ``limits[filtro]`` values of each field where limits are given."""
    if not limits:
        return counts.orderBy("filtro", F.desc("n"), F.asc("valor"))
    w = Window.partitionBy("filtro").orderBy(F.desc("n"), F.asc("valor"))
    limit = F.coalesce(*[F.when(F.col("filtro") == name, F.lit(int(limits[name]))) for name in fields])
    top = max(int(limits[name]) for name in fields)
    # the literal bound lets Spark cut each group per partition before the
    # window's shuffle (WindowGroupLimit); the exact per-field cut follows
    return (counts.withColumn("_rank", F.row_number().over(w))
            .where((F.col("_rank") <= top) & (F.col("_rank") <= limit))
            .orderBy("filtro", "_rank")
            .drop("_rank"))


def dataset_metrics(df: DataFrame) -> DataFrame:
    """``n, dt_min, dt_max`` in one aggregate (A2)."""
    aggs = [counted(df).alias("n")]
    if DATE in df.columns:
        aggs += [F.min(DATE).alias("dt_min"), F.max(DATE).alias("dt_max")]
    return df.agg(*aggs)


def year_bounds(df: DataFrame) -> DataFrame:
    """``ano_min, ano_max`` of valid dates on unfiltered data (A5); both
    NULL when there is no valid date."""
    y = F.year(F.col(DATE)).cast("long")
    return df.where(F.col(DATE).isNotNull()).agg(F.min(y).alias("ano_min"), F.max(y).alias("ano_max"))


def year_bounds_values(df: DataFrame) -> Optional[Tuple[int, int]]:
    """Driver-side bounds (two numbers) for building a year filter."""
    if DATE not in df.columns:
        return None
    row = year_bounds(df).first()
    if row is None or row["ano_min"] is None:
        return None
    return int(row["ano_min"]), int(row["ano_max"])


def top_category(df: DataFrame, column: str, n: int = TOP_CATEGORY_N) -> DataFrame:
    """``categoria, n``: the ``n`` most frequent non-null values."""
    return (df.where(F.col(column).isNotNull())
            .groupBy(F.col(column).alias("categoria"))
            .agg(counted(df).alias("n"))
            .orderBy(F.desc("n"), F.asc_nulls_last("categoria"))
            .limit(n))


MISSING_COLUMNS = (DATE, SEX_TEXT, AGE, AGE_UNIT_TEXT, MUNICIPALITY, OUTCOME, DIAGNOSIS, CODE)


def missing_checks(columns) -> list:
    """``(label, canonical column)`` of each configured key field."""
    return [(label, col) for label, col in zip(MISSING_LABELS, MISSING_COLUMNS) if col in columns]


def missing_flag_sums(df: DataFrame, checks) -> list:
    one = F.col(WEIGHT) if WEIGHT in df.columns else F.lit(1)
    return [F.sum(F.when(F.col(col).isNull(), one).otherwise(0)).cast("long").alias(f"_m{i}")
            for i, (_, col) in enumerate(checks)]


def unpivot_missing(one: DataFrame, checks) -> DataFrame:
    """One row with ``_total`` and ``_m<i>`` -> ``campo, faltantes, pct_faltante``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("_ord"), F.lit(label).alias("campo"),
                                         F.col(f"_m{i}").alias("faltantes"))
                                for i, (label, _) in enumerate(checks)]))
    return (one.select("_total", pairs.alias("p"))
            .select("p._ord", "p.campo", "p.faltantes",
                    percent(F.col("p.faltantes"), F.col("_total")).alias("pct_faltante"))
            .orderBy("_ord").drop("_ord"))


def missingness(df: DataFrame) -> Optional[DataFrame]:
    """``campo, faltantes, pct_faltante`` for each configured key field.

    One aggregate computes the row count and every missing count, then the
    one-row result is unpivoted. Sex, unit, municipality, outcome and
    diagnosis are judged on cleaned raw text; date, age and code on their
    converted values (an unconvertible value counts as missing).
    On empty input the counts are NULL and the percentages 0.0.
    """
    checks = missing_checks(df.columns)
    if not checks:
        return None
    one = df.agg(counted(df).alias("_total"), *missing_flag_sums(df, checks))
    return unpivot_missing(one, checks)


def enriched_rows(df: DataFrame, roles: Roles, limit: Optional[int] = None) -> DataFrame:
    """Recoded columns beside the raw role columns (A14). No limit unless
    asked; the raw columns are renamed ``raw_<alias>``, each differently."""
    items = []
    if DATE in df.columns:
        items.append(F.col(DATE).alias("data_analise"))
    if SEX in df.columns:
        items.append(F.col(SEX).alias("sexo_recodificado"))
    if AGE in df.columns:
        items.append(round_half_away(F.col(AGE), 2).alias("idade_anos"))
    if MUNICIPALITY in df.columns:
        items.append(F.col(MUNICIPALITY).alias("municipio"))
    if OUTCOME in df.columns:
        items.append(F.col(OUTCOME).alias("desfecho_classificacao"))
    if CODE in df.columns:
        items += [F.col(CODE).alias("cid_meningite_detectado"), F.col(CODE_GROUP).alias("grupo_cid"),
                  F.col(CODE_TYPE).alias("tipo_agravo_cid10"), F.col(CODE_ORIGIN).alias("coluna_origem_cid")]
    items += [named(c).alias(f"raw_{alias}") for c, alias in output_names(roles.raw_columns()).items()]
    out = df.select(*items) if items else df
    return out.limit(int(limit)) if limit is not None else out
