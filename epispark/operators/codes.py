"""Code-type composition, detected codes and code origin.

The group keys here are the rule groups (≤ 9 values) or detected codes. The
shipped pattern bounds these to a few hundred spellings, and with them the
code list of a group. For a caller's own pattern with very many codes,
``list_codes=False`` leaves the lists out, so that no row grows with the codes,
and ``type_codes`` gives them as rows. The percent-of-total window runs on the
aggregated rows only.
"""

from __future__ import annotations

from typing import Mapping, Optional

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import code_group, code_type
from ..functions.periods import percent
from ..plans.recode import CODE, CODE_GROUP, CODE_ORIGIN, CODE_TYPE, counted, rules_of
from ..profiles import TOP_CODES_N


def _all():
    # whole (already aggregated, tiny) result as one window partition
    return Window.partitionBy()


def _code_counts(df: DataFrame) -> DataFrame:
    """``_cid, n`` with group and label, which are functions of the code: where
    the frame carries its rules only the code is a key, and the labels are
    derived from the few codes left. Elsewhere the keys are those of group,
    label and code that the frame has; a missing one is NULL."""
    rules = rules_of(df)
    if rules:
        counts = df.groupBy(F.col(CODE).alias("_cid")).agg(counted(df).alias("n"))
        return counts.select("_cid", "n", code_group(F.col("_cid"), rules).alias("grupo_cid"),
                             code_type(F.col("_cid"), rules).alias("tipo_agravo_cid10"))
    names = {CODE_GROUP: "grupo_cid", CODE_TYPE: "tipo_agravo_cid10", CODE: "_cid"}
    counts = df.groupBy(*[F.col(c).alias(to) for c, to in names.items() if c in df.columns]).agg(counted(df).alias("n"))
    return counts.withColumns({to: F.lit(None).cast("string") for c, to in names.items() if c not in df.columns})


def _type_counts(df: DataFrame, list_codes: bool = True) -> DataFrame:
    # Folding the counts per code gives the distinct count and the code list
    # exactly, without a distinct aggregate or a collect_set over rows.
    codes = F.nullif(F.array_join(F.array_sort(F.collect_list("_cid")), ", "), F.lit("")).alias("cids_encontrados")
    return (_code_counts(df).groupBy("grupo_cid", "tipo_agravo_cid10")
            .agg(F.sum("n").alias("n"), F.count("_cid").alias("cids_distintos_n"), *([codes] if list_codes else [])))


def type_codes(df: DataFrame) -> DataFrame:
    """``grupo_cid, tipo_agravo_cid10, cid, n``: a row per code that occurs, by
    group and code; what ``type_distribution`` lists, for any number of codes."""
    return (_code_counts(df).where(F.col("_cid").isNotNull())
            .select("grupo_cid", "tipo_agravo_cid10", F.col("_cid").alias("cid"), "n")
            .orderBy(F.asc_nulls_last("grupo_cid"), "cid"))


def type_distribution(df: DataFrame, list_codes: bool = True) -> DataFrame:
    """``grupo_cid, tipo_agravo_cid10, n, cids_distintos_n,
    cids_encontrados, pct`` over all filtered rows (rows without a code
    form their own group). The distinct-code list is sorted (the order is
    otherwise unspecified) and left out without ``list_codes``; ``pct`` is the
    share of all rows."""
    agg = _type_counts(df, list_codes)
    return (agg.withColumn("pct", percent(F.col("n"), F.sum("n").over(_all())))
            .orderBy(F.desc("n"), F.asc_nulls_last("grupo_cid")))


def top_type(df: DataFrame) -> DataFrame:
    """First row of ``type_distribution`` — the most frequent type."""
    return type_distribution(df).limit(1)


def top_codes(df: DataFrame, n: int = TOP_CODES_N) -> DataFrame:
    """``cid_detectado, tipo_agravo_cid10, n, pct_entre_cids_detectados``:
    the ``n`` most frequent codes; the percentage is relative to the rows
    kept, not to all detected codes."""
    top = (_code_counts(df).where(F.col("_cid").isNotNull())
           .select(F.col("_cid").alias("cid_detectado"), "tipo_agravo_cid10", "n")
           .orderBy(F.desc("n"), F.asc_nulls_last("cid_detectado"))
           .limit(n))
    return (top.withColumn("pct_entre_cids_detectados", percent(F.col("n"), F.sum("n").over(_all())))
            .orderBy(F.desc("n"), F.asc_nulls_last("cid_detectado")))


def code_origin_counts(df: DataFrame) -> DataFrame:
    """``coluna_origem_cid, n``: which column supplied the code (A12). At most
    a row per code column. The origin is counted, not filtered: a filter
    would evaluate it a second time below the projection."""
    return (df.groupBy(F.col(CODE_ORIGIN).alias("coluna_origem_cid"))
            .agg(counted(df, CODE_ORIGIN).alias("n")).where(F.col("n") > 0)
            .orderBy(F.desc("n"), F.asc_nulls_last("coluna_origem_cid")))


def compare_types(bases: Mapping[str, DataFrame]) -> Optional[DataFrame]:
    """``type_distribution`` per register with a ``base`` column; ``pct`` is
    within each base (X2). Bases without codes are skipped. The per-base
    counts are combined first; one window partitioned by base computes the
    shares and one sort orders the result."""
    frames = [_type_counts(df).withColumn("base", F.lit(name)).withColumn("_rank", F.lit(rank))
              for rank, (name, df) in enumerate(bases.items()) if CODE in df.columns]
    if not frames:
        return None
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    share = percent(F.col("n"), F.sum("n").over(Window.partitionBy("base")))
    return (out.withColumn("pct", share)
            .orderBy("_rank", F.desc("n"), F.asc_nulls_last("grupo_cid"))
            .select("grupo_cid", "tipo_agravo_cid10", "n", "cids_distintos_n", "cids_encontrados", "pct", "base"))
