"""The whole register report from one scan: a grouping-sets aggregate, or a
lattice of roll-ups.

Each table of the report is a count over some key (period, year×month,
age band, sex×band, code, origin, diagnosis, outcome, municipality, or
nothing for the totals). Instead of one scan and one recode per table,
the recoded frame is read once; ``groupingSets`` expands every row into
one row per key set and a hash aggregate with a map-side partial step
folds them, so the shuffle carries at most (#partitions × #groups) rows
whatever the skew of any key. The analysis filter is not applied as a
row filter: it becomes the boolean key ``k_manter`` present in every set,
so the unfiltered tables (filter options, year bounds) come out of the
same pass. The totals set is also keyed by the missing-value flags of the
key fields (at most 2^8 groups), so missing counts cost no aggregate per
row; the date bounds ride along as min/max.

The aggregated result is bounded by the number of distinct keys (a few
thousand municipalities at most), never by the row count. It is written
once as a table under the shared ``spark.checkpoint.dir`` (lineage cut,
survives executor loss) and every report table is a small slice of it.

``lattice_report`` expands no row: one aggregate counts the rows of each
combination of all keys, and every key set is rolled up from the smallest
table that has its keys, over a few tables in between. It shuffles the
combinations that occur instead of twelve partial sums a row; where most rows
differ in some key there are nearly as many of them as rows, and the grouping
sets are the cheaper way.
"""

from __future__ import annotations

from typing import Dict, List, Optional, Tuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import band_label, band_start, month_of, percent, period_start, year_of
from ..operators.quality import missing_checks, top_per_field, unpivot_missing
from ..operators.series import MONTHS
from ..profiles import SEX_FEMALE, SEX_MALE, TOP_CATEGORY_N, TOP_CODES_N
from .recode import (
    AGE,
    CODE,
    CODE_GROUP,
    CODE_ORIGIN,
    CODE_TYPE,
    DATE,
    DEFAULT_FILTERS,
    DIAGNOSIS,
    MUNICIPALITY,
    OUTCOME,
    SEX,
    Filters,
    counted,
    filter_predicate,
)
from .report import Register, materialize

KEEP = "k_manter"
PERIOD = "k_periodo"
YEAR = "k_ano"
MONTH = "k_mes"
BAND = "k_faixa"
SEX_BIN = "k_sexo_bin"


def _flag(i: int) -> str:
    return f"k_falta{i}"


def key_sets(columns) -> List[Tuple[str, List[str]]]:
    cols = set(columns)
    # totals are grouped by the missing-value flags (at most 2^8 groups), so
    # missing counts need no extra aggregate per expanded row
    flags = [_flag(i) for i in range(len(missing_checks(cols)))]
    sets: List[Tuple[str, List[str]]] = [("total", [KEEP, *flags])]
    if DATE in cols:
        sets += [("period", [KEEP, PERIOD]), ("heat", [KEEP, YEAR, MONTH])]
        if CODE in cols:
            sets.append(("period_type", [KEEP, PERIOD, CODE_TYPE]))
    if AGE in cols:
        sets.append(("band", [KEEP, BAND]))
        if SEX in cols:
            sets.append(("pyramid", [KEEP, SEX_BIN, BAND]))
    if SEX in cols:
        sets.append(("sex", [KEEP, SEX]))
    if CODE in cols:
        sets += [("codes", [KEEP, CODE_GROUP, CODE_TYPE, CODE]), ("origin", [KEEP, CODE_ORIGIN])]
    for name, col in (("diagnosis", DIAGNOSIS), ("outcome", OUTCOME), ("municipality", MUNICIPALITY)):
        if col in cols:
            sets.append((name, [KEEP, col]))
    return sets


def _grouping_ids(order: List[str], sets) -> Dict[str, int]:
    # grouping_id(): bit set for every column *not* in the set, first column
    # most significant
    width = len(order)
    return {name: sum(1 << (width - 1 - i) for i, c in enumerate(order) if c not in members)
            for name, members in sets}


def _keyed(df: DataFrame, filters: Filters, freq: str, has_valid: Optional[bool]):
    """The frame with all key columns, the key sets, the keys in order, the
    aggregates and the missing-value checks."""
    cols = set(df.columns)
    keys = {KEEP: filter_predicate(df, filters, has_valid)}
    if DATE in cols:
        d = F.col(DATE)
        keys.update({PERIOD: period_start(d, freq), YEAR: year_of(d), MONTH: month_of(d)})
    if AGE in cols:
        keys[BAND] = F.when(F.col(AGE).between(0, 120), band_start(F.col(AGE)))
        if SEX in cols:
            keys[SEX_BIN] = F.when(F.col(SEX).isin(SEX_MALE, SEX_FEMALE), F.col(SEX))
    checks = missing_checks(cols)
    keys.update({_flag(i): F.col(col).isNull() for i, (_, col) in enumerate(checks)})
    keyed = df.withColumns(keys)
    sets = key_sets(cols)
    order: List[str] = []
    for _, members in sets:
        for c in members:
            if c not in order:
                order.append(c)
    aggs = [counted(df).alias("n")]
    if DATE in cols:
        aggs += [F.min(DATE).alias("dt_min"), F.max(DATE).alias("dt_max")]
    return keyed, sets, order, aggs, checks


def aggregate_once(df: DataFrame, filters: Filters = DEFAULT_FILTERS, freq: str = "month",
                   has_valid: Optional[bool] = None):
    """The grouping-sets aggregate (lazy), its key order and set ids."""
    keyed, sets, order, aggs, checks = _keyed(df, filters, freq, has_valid)
    agg = keyed.groupingSets([members for _, members in sets], *order).agg(*aggs, F.grouping_id().alias("gid"))
    return agg, _grouping_ids(order, sets), checks


#: Tables between the finest one and the report's, by the sets they serve.
_BETWEEN = (("period", "heat", "period_type", "codes"), ("band", "pyramid", "sex"))


def roll_ups(df: DataFrame, filters: Filters = DEFAULT_FILTERS, freq: str = "month", has_valid: Optional[bool] = None,
             materialize_as: Optional[str] = "table"):
    """Every key set as a table of counts, each from the smallest table above
    it that has its keys; and the missing-value checks."""
    keyed, sets, order, aggs, checks = _keyed(df, filters, freq, has_valid)
    spark = df.sparkSession
    members = dict(sets)
    finest = materialize(keyed.groupBy(*order).agg(*aggs), materialize_as, spark)
    sums = [F.sum("n").alias("n")] + ([F.min("dt_min").alias("dt_min"), F.max("dt_max").alias("dt_max")] if DATE in df.columns else [])
    above = [(order, finest)]
    for names in _BETWEEN:
        keys = [c for c in order if any(c in members.get(name, ()) for name in names)]
        if keys:
            above.append((keys, materialize(finest.groupBy(*keys).agg(*sums), materialize_as, spark)))
    out = {}
    for name, keys in sets:
        _, parent = min(((len(have), i) for i, (have, _) in enumerate(above) if set(keys) <= set(have)))
        out[name] = above[parent][1].groupBy(*keys).agg(*sums)
    return out, checks


def lattice_report(reg: Register, filters: Filters = DEFAULT_FILTERS, freq: str = "month",
                   materialize_as: Optional[str] = "table") -> Dict[str, DataFrame]:
    """The tables of ``one_pass_report`` by rolling up, without expanding rows."""
    parts, checks = roll_ups(reg.recoded, filters, freq, reg._known_validity(filters), materialize_as)
    return _report_tables(parts, checks, set(reg.recoded.columns))


def _top(df: DataFrame, key: str, alias: str, n: Optional[int]) -> DataFrame:
    out = (df.where(F.col(key).isNotNull())
           .select(F.col(key).alias(alias), "n")
           .orderBy(F.desc("n"), F.asc_nulls_last(alias)))
    return out if n is None else out.limit(n)


def _summed(df: DataFrame, *keys: str) -> DataFrame:
    # collapse the filter key: unfiltered counts per key
    return df.groupBy(*keys).agg(F.sum("n").alias("n"))


def one_pass_report(reg: Register, filters: Filters = DEFAULT_FILTERS, freq: str = "month",
                    materialize_as: str = "table") -> Dict[str, DataFrame]:
    """Every aggregate table of ``standard_report`` (plus ``time_series_by``),
    equal to the per-table operators, from one scan of the recoded frame."""
    agg, gid, checks = aggregate_once(reg.recoded, filters, freq, reg._known_validity(filters))
    agg = materialize(agg, materialize_as, reg.recoded.sparkSession)
    return _report_tables({name: agg.where(F.col("gid") == number) for name, number in gid.items()}, checks, set(reg.recoded.columns))


def _report_tables(parts: Dict[str, DataFrame], checks, cols: set) -> Dict[str, DataFrame]:
    """The report from a table of counts per key set."""
    part = parts.__getitem__

    def kept(name: str) -> DataFrame:
        return part(name).where(F.col(KEEP))

    out: Dict[str, DataFrame] = {}
    total = kept("total")
    metrics = [F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")]
    if DATE in cols:
        metrics += [F.min("dt_min").alias("dt_min"), F.max("dt_max").alias("dt_max")]
    out["dataset_metrics"] = total.agg(*metrics)
    if checks:
        one = total.agg(F.sum("n").alias("_total"),
                        *[F.sum(F.when(F.col(_flag(i)), F.col("n")).otherwise(0)).alias(f"_m{i}")
                          for i in range(len(checks))])
        out["missingness"] = unpivot_missing(one, checks)

    option_parts = []
    for set_name, col, field in (("sex", SEX, "sexo"), ("municipality", MUNICIPALITY, "municipio"),
                                 ("outcome", OUTCOME, "desfecho"), ("codes", CODE_TYPE, "cid_tipo")):
        if set_name in parts:
            option_parts.append((field, _summed(part(set_name), col)
                                 .select(F.lit(field).alias("filtro"), F.col(col).alias("valor"), "n")
                                 .where(F.col("valor").isNotNull())))
    if option_parts:
        counts = option_parts[0][1]
        for _, p in option_parts[1:]:
            counts = counts.unionByName(p)
        out["filter_options"] = top_per_field(counts, [f for f, _ in option_parts])

    if "period" in parts:
        heat_all = part("heat").where(F.col(YEAR).isNotNull())
        out["year_bounds"] = heat_all.agg(F.min(YEAR).alias("ano_min"), F.max(YEAR).alias("ano_max"))
        out["time_series"] = (kept("period").where(F.col(PERIOD).isNotNull())
                              .select(F.col(PERIOD).alias("periodo"), "n").orderBy("periodo"))
        heat = (kept("heat").where(F.col(YEAR).isNotNull())
                .select(F.col(YEAR).alias("ano"), F.col(MONTH).alias("mes"), "n"))
        out["heatmap_long"] = heat.orderBy("ano", "mes")
        out["heatmap_pivot"] = (heat.groupBy("ano").pivot("mes", MONTHS).agg(F.sum("n"))
                                .na.fill(0, [str(m) for m in MONTHS]).orderBy("ano"))
    if "period_type" in parts:
        out["time_series_by"] = (kept("period_type")
                                 .where(F.col(PERIOD).isNotNull() & F.col(CODE_TYPE).isNotNull())
                                 .select(F.col(PERIOD).alias("periodo"), F.col(CODE_TYPE).alias("categoria"), "n")
                                 .orderBy("periodo", "categoria"))
    if "band" in parts:
        out["age_distribution"] = (kept("band").where(F.col(BAND).isNotNull())
                                   .select(F.col(BAND).alias("faixa_ini"), "n")
                                   .withColumn("faixa", band_label(F.col("faixa_ini")))
                                   .orderBy("faixa_ini"))
    if "pyramid" in parts:
        out["age_pyramid"] = (kept("pyramid").where(F.col(BAND).isNotNull() & F.col(SEX_BIN).isNotNull())
                              .select(F.col(SEX_BIN).alias("sexo"), F.col(BAND).alias("faixa_ini"), "n")
                              .withColumn("faixa", band_label(F.col("faixa_ini")))
                              .withColumn("valor", F.when(F.col("sexo") == SEX_MALE, -F.col("n"))
                                          .otherwise(F.col("n")))
                              .orderBy("faixa_ini", "sexo"))
    if "codes" in parts:
        codes = kept("codes")
        dist = (codes.groupBy(F.col(CODE_GROUP).alias("grupo_cid"), F.col(CODE_TYPE).alias("tipo_agravo_cid10"))
                .agg(F.sum("n").alias("n"), F.count(CODE).alias("cids_distintos_n"),
                     F.nullif(F.array_join(F.array_sort(F.collect_list(CODE)), ", "), F.lit(""))
                     .alias("cids_encontrados")))
        out["type_distribution"] = (dist.withColumn("pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy())))
                                    .orderBy(F.desc("n"), F.asc_nulls_last("grupo_cid")))
        top = (codes.where(F.col(CODE).isNotNull())
               .select(F.col(CODE).alias("cid_detectado"), F.col(CODE_TYPE).alias("tipo_agravo_cid10"), "n")
               .orderBy(F.desc("n"), F.asc_nulls_last("cid_detectado")).limit(TOP_CODES_N))
        out["top_codes"] = (top.withColumn("pct_entre_cids_detectados",
                                           percent(F.col("n"), F.sum("n").over(Window.partitionBy())))
                            .orderBy(F.desc("n"), F.asc_nulls_last("cid_detectado")))
        out["code_origin"] = _top(kept("origin"), CODE_ORIGIN, "coluna_origem_cid", None)
    for key, set_name, col in (("top_diagnosis", "diagnosis", DIAGNOSIS), ("top_outcome", "outcome", OUTCOME),
                               ("top_municipality", "municipality", MUNICIPALITY)):
        if set_name in parts:
            out[key] = _top(kept(set_name), col, "categoria", TOP_CATEGORY_N)
    return out


def comparison_from_reports(reports: Dict[str, Dict[str, DataFrame]], by_type: bool = False,
                            index100: bool = False) -> Dict[str, DataFrame]:
    """Cross-register tables (X1, X2) assembled from one-pass reports:
    ``{register name: one_pass_report(...)}``. Registers without a date
    are skipped; at least two dated registers are needed. The slices are
    combined unsorted and ordered once."""
    from ..operators.series import _combine

    dated = {n: r for n, r in reports.items() if "time_series" in r}
    if len(dated) < 2:
        return {}
    frames = []
    for rank, (name, r) in enumerate(dated.items()):
        if by_type and "time_series_by" in r:
            ts = r["time_series_by"].withColumn("serie", F.concat(F.lit(name + " — "), F.col("categoria")))
        else:
            ts = r["time_series"].withColumn("serie", F.lit(name))
        frames.append(ts.withColumnRenamed("n", "valor").withColumn("base", F.lit(name))
                      .withColumn("_rank", F.lit(rank)))
    out = {"compare_series": _combine(frames, index100)}
    types = [r["type_distribution"].withColumn("base", F.lit(n)).withColumn("_rank", F.lit(rank))
             for rank, (n, r) in enumerate(dated.items()) if "type_distribution" in r]
    if types:
        t = types[0]
        for f in types[1:]:
            t = t.unionByName(f)
        out["compare_types"] = (t.orderBy("_rank", F.desc("n"), F.asc_nulls_last("grupo_cid"))
                                .drop("_rank"))
    return out
