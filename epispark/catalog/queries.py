"""Registered queries: one per operator of the inventory, each a function
``(spark, sf_dir) -> DataFrame`` over the driver's tables.

Register-shaped inputs are the fixture views of ``sources.fixtures``
(``cases``/``deaths``/``stays`` stand in for SINAN/SIM/CIHA). Roles are
resolved from the view's column names, exactly as for a real extract.
"""

from __future__ import annotations

from typing import Callable, Dict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ages, codes, dates, sex, text
from ..operators import codes as code_ops
from ..operators import demography, quality, series, topk
from ..plans.recode import (
    CODE,
    CODE_GROUP,
    CODE_ORIGIN,
    CODE_TYPE,
    DATE,
    DIAGNOSIS,
    MUNICIPALITY,
    OUTCOME,
    SEX,
    Filters,
    apply_filters,
    recode,
)
from ..plans.report import Register, open_register
from ..plans.roles import Roles
from ..profiles import AGE_MODE_AUTO, AGE_MODE_DIRECT, CODE_RULES, PROFILES
from ..session import scratch_path
from ..sources import consolidation, export, parquet
from ..sources.fixtures import VIEW_PROFILE, fixture_view, view_columns

Query = Callable[[SparkSession, str], DataFrame]

# FIXED VALUES — the selections used by the conjunctive-filter query.
CONJUNCTIVE_FILTER = Filters(
    years=(1994, 1996),
    sexo=("Masculino", "Feminino"),
    municipio=("330001", "330002", "330003", "330010", "330050"),
    desfecho=("R", "A"),
    tipo=(CODE_RULES[6][2], CODE_RULES[2][2]),
)
TERRITORY = "3300457"


# (application id, files of the extract) -> Register. A register is opened
# once and its lazy plan reused by every question, as a report does; nothing
# is cached but the plan objects.
_REGISTERS: Dict[tuple, Register] = {}


def register(spark: SparkSession, sf_dir: str, view: str) -> Register:
    raw = fixture_view(spark, sf_dir, view)
    key = (spark.sparkContext.applicationId, view, tuple(raw.inputFiles()))
    reg = _REGISTERS.get(key)
    if reg is None:
        reg = _REGISTERS[key] = open_register(raw, PROFILES[VIEW_PROFILE[view]])
    return reg


def filtered(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    return register(spark, sf_dir, view).filtered()


def dated(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """For the operators that leave out rows without a date themselves."""
    return register(spark, sf_dir, view).dated()


def _raw(spark, sf_dir, view):
    return fixture_view(spark, sf_dir, view)


# -- scalar recodes -----------------------------------------------------------

def q_clean_text(spark, sf_dir):
    df = _raw(spark, sf_dir, "cases")
    return df.select(F.col("CS_SEXO").alias("bruto"), text.clean_text("CS_SEXO").alias("limpo"),
                     text.clean_text("ID_AGRAVO").alias("agravo_limpo"))


#: Spaces of several kinds, put around raw values.
_SPACES = ["\u00a0", " \u2003", "\u3000", "", "\u202f "]


def q_clean_unicode_spaces(spark, sf_dir):
    """Values between Unicode spaces: cleaned, and recoded as sex."""
    place = F.pmod(F.col("o_orderkey"), F.lit(5)).cast("int")
    space = F.get(F.array(*map(F.lit, _SPACES)), place)
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("id"), F.concat(space, F.get(F.array(*map(F.lit, ["M", "F", "", "X \u00a0Y", "2"])), F.pmod(F.col("o_custkey"), F.lit(5)).cast("int")),
                                                  F.reverse(space)).alias("SEXO"))
    rec = recode(raw, Roles(sex="SEXO"), keep_all=True)
    return rec.select("id", F.col("ep_sexo_txt").alias("texto"), F.col("ep_sexo").alias("sexo"))


def q_parse_dates(spark, sf_dir):
    df = _raw(spark, sf_dir, "cases")
    return df.select(F.col("DT_SIN_PRI").alias("bruto"),
                     dates.parse_date("DT_SIN_PRI", df.schema["DT_SIN_PRI"].dataType).alias("data"))


def q_age_coded(spark, sf_dir):
    return _raw(spark, sf_dir, "cases").select(F.col("NU_IDADE_N").alias("bruto"),
                                               ages.age_coded("NU_IDADE_N").alias("idade"))


def q_age_with_unit(spark, sf_dir):
    return _raw(spark, sf_dir, "stays").select(
        F.col("IDADE").alias("bruto"), F.col("COD_IDADE").alias("unidade"),
        ages.age_with_unit("IDADE", "COD_IDADE").alias("idade"))


def q_age_direct(spark, sf_dir):
    return _raw(spark, sf_dir, "stays").select(F.col("IDADE").alias("bruto"),
                                               ages.age_direct("IDADE").alias("idade"))


def q_age_auto(spark, sf_dir):
    # Automatic mode on a column named like a coded age: coded, else direct.
    return _raw(spark, sf_dir, "cases").select(
        F.col("NU_IDADE_N").alias("bruto"), ages.build_age("NU_IDADE_N", AGE_MODE_AUTO).alias("idade"))


def q_recode_sex(spark, sf_dir):
    return _raw(spark, sf_dir, "cases").select(F.col("CS_SEXO").alias("bruto"),
                                               sex.recode_sex("CS_SEXO").alias("sexo"))


def q_extract_code(spark, sf_dir):
    return _raw(spark, sf_dir, "cases").select(F.col("ID_AGRAVO").alias("bruto"),
                                               codes.extract_code("ID_AGRAVO").alias("cid"))


def q_extract_code_multi(spark, sf_dir):
    cols = ["CAUSABAS", "LINHAA", "LINHAII"]
    return _raw(spark, sf_dir, "deaths").select(*cols, codes.extract_code_multi(cols).alias("cid"))


def q_code_origin_rows(spark, sf_dir):
    cols = ["CAUSABAS", "LINHAA", "LINHAII"]
    return _raw(spark, sf_dir, "deaths").select(
        codes.extract_code_multi(cols).alias("cid"), codes.code_origin(cols).alias("coluna_origem_cid"))


def q_classify_code(spark, sf_dir):
    rec = register(spark, sf_dir, "deaths").recoded
    return rec.select(F.col(CODE).alias("cid"), F.col(CODE_GROUP).alias("grupo_cid"),
                      F.col(CODE_TYPE).alias("tipo_agravo_cid10"))


def q_canonical_projection(spark, sf_dir):
    reg = register(spark, sf_dir, "cases")
    return quality.enriched_rows(reg.recoded, reg.roles)


# -- filters ------------------------------------------------------------------

def q_filter_conjunctive(spark, sf_dir):
    rec = register(spark, sf_dir, "cases").recoded
    return apply_filters(rec, CONJUNCTIVE_FILTER).select(
        F.col(DATE).alias("data_analise"), F.col(SEX).alias("sexo_recodificado"),
        F.col(MUNICIPALITY).alias("municipio"), F.col(OUTCOME).alias("desfecho_classificacao"),
        F.col(CODE_TYPE).alias("tipo_agravo_cid10"))


# -- aggregates over one register ----------------------------------------------

def q_filter_options(spark, sf_dir):
    return quality.filter_options(register(spark, sf_dir, "cases").recoded)


def q_dataset_metrics(spark, sf_dir):
    return quality.dataset_metrics(filtered(spark, sf_dir, "cases"))


def _ts(freq):
    def q(spark, sf_dir):
        return series.time_series(dated(spark, sf_dir, "cases"), freq)
    return q


def q_ts_month_by_type(spark, sf_dir):
    return series.time_series_by(dated(spark, sf_dir, "cases"), "month")


def q_year_bounds(spark, sf_dir):
    return quality.year_bounds(register(spark, sf_dir, "cases").recoded)


def q_heatmap_long(spark, sf_dir):
    return series.month_heatmap(dated(spark, sf_dir, "cases"))


def q_heatmap_pivot(spark, sf_dir):
    return series.heatmap_pivot(dated(spark, sf_dir, "cases"))


def _top(column):
    def q(spark, sf_dir):
        return quality.top_category(filtered(spark, sf_dir, "cases"), column)
    return q


def q_age_distribution(spark, sf_dir):
    return demography.age_distribution(filtered(spark, sf_dir, "cases"))


def q_age_pyramid(spark, sf_dir):
    return demography.age_pyramid(filtered(spark, sf_dir, "cases"))


def q_type_distribution(spark, sf_dir):
    return code_ops.type_distribution(filtered(spark, sf_dir, "deaths"))


def q_top_type(spark, sf_dir):
    return code_ops.top_type(filtered(spark, sf_dir, "deaths"))


def q_top_codes(spark, sf_dir):
    return code_ops.top_codes(filtered(spark, sf_dir, "deaths"))


def q_code_origin(spark, sf_dir):
    return code_ops.code_origin_counts(filtered(spark, sf_dir, "deaths"))


def q_missingness(spark, sf_dir):
    return quality.missingness(filtered(spark, sf_dir, "cases"))


def q_missingness_stays(spark, sf_dir):
    return quality.missingness(filtered(spark, sf_dir, "stays"))


def q_enriched_rows(spark, sf_dir):
    reg = register(spark, sf_dir, "stays")
    return quality.enriched_rows(reg.filtered(), reg.roles)


# -- comparison across registers -------------------------------------------------

BASES = (("SINAN", "cases"), ("SIM", "deaths"), ("CIHA", "stays"))


def _bases(spark, sf_dir, frame=filtered):
    return {name: frame(spark, sf_dir, view) for name, view in BASES}


def q_compare_series(spark, sf_dir):
    return series.compare_series(_bases(spark, sf_dir, dated), "month")


def q_compare_series_by_type(spark, sf_dir):
    return series.compare_series(_bases(spark, sf_dir, dated), "month", by_type=True)


def q_index_base100(spark, sf_dir):
    return series.compare_series(_bases(spark, sf_dir, dated), "year", index100=True)


def q_compare_types(spark, sf_dir):
    return code_ops.compare_types(_bases(spark, sf_dir))


# -- sources and sinks ---------------------------------------------------------------

def q_schema_describe(spark, sf_dir):
    return parquet.schema_describe(spark, parquet.read_base(spark, f"{sf_dir}/lineitem.parquet"))


def q_preview_rows(spark, sf_dir):
    return parquet.preview_rows(parquet.read_base(spark, f"{sf_dir}/lineitem.parquet"), 10,
                                ("l_orderkey", "l_linenumber"))


def drift_parts():
    """Three yearly layouts of the death register: ``id`` is INT, then text
    (spelled ``ID``), then BIGINT; ``sexo`` and ``idade`` appear in one
    layout each. Expressions are over the ``deaths`` view."""
    return [
        ("o_orderkey % 3 = 0", ["CAST(o_orderkey AS INT) AS id", "SEXO AS sexo"]),
        ("o_orderkey % 3 = 1", ["CAST(o_orderkey AS STRING) AS ID", "idade_num AS idade"]),
        ("o_orderkey % 3 = 2", ["o_orderkey AS id"]),
    ]


def q_scan_union_by_name(spark, sf_dir):
    table, cols = view_columns("deaths")
    deaths = (spark.read.parquet(f"{sf_dir}/{table}.parquet")
              .selectExpr("o_orderkey", *[f"{e} AS {c}" for c, e in cols])
              .withColumn("idade_num", ages.age_coded("IDADE")))
    root = scratch_path(spark, "drift")
    paths = []
    for i, (cond, exprs) in enumerate(drift_parts()):
        p = f"{root}/part{i}"
        deaths.where(cond).selectExpr(*exprs).write.mode("overwrite").parquet(p)
        paths.append(p)
    return parquet.read_base(spark, paths)


def consolidated(spark, sf_dir):
    """The stays with a code, all raw columns kept, written by year and read back."""
    reg = open_register(fixture_view(spark, sf_dir, "stays"), PROFILES["CIHA"], keep_all=True)
    return parquet.read_base(spark, export.consolidate_by_year(reg.recoded, scratch_path(spark, "consolidated")))


def q_consolidate_by_year(spark, sf_dir):
    back = consolidated(spark, sf_dir)
    return back.groupBy(F.col("ano").cast("long").alias("ano")).agg(F.count(F.lit(1)).alias("n")).orderBy("ano")


def q_consolidate_full_rows(spark, sf_dir):
    """Every raw column of the kept rows, for a range of years."""
    back = apply_filters(consolidated(spark, sf_dir), Filters(years=(1994, 1996)))
    names = [c for c, _ in view_columns("stays")[1]]
    return back.select(*names, F.col("ano").cast("long").alias("ano"), F.col(CODE).alias("cid"))


def q_consolidate_incremental(spark, sf_dir):
    """Three deliveries of stays: two are consolidated, then a third arrives
    and the first is replaced by a part of it."""
    root = scratch_path(spark, "deliveries")
    raw, last = fixture_view(spark, sf_dir, "stays"), F.substring("MUNIC_RES", -1, 1)

    def deliver(name, digits):
        raw.where(last.isin(digits)).write.mode("overwrite").parquet(f"{root}/in/{name}")

    deliver("a", list("0123"))
    deliver("b", list("456"))
    consolidation.consolidate_files(spark, f"{root}/in/*", f"{root}/table", "CIHA")
    deliver("a", list("01"))
    deliver("c", list("789"))
    consolidation.consolidate_files(spark, f"{root}/in/*", f"{root}/table", "CIHA")
    names = [c for c, _ in view_columns("stays")[1]]
    return parquet.read_base(spark, f"{root}/table").select(*names, F.col("ano").cast("long").alias("ano"), F.col(CODE).alias("cid"))


_CUBES: Dict[tuple, str] = {}


def stays_cube(spark, sf_dir):
    """A cube of stays from three deliveries, one of them replaced by a whole
    one; made once per application and state of the table, like the view."""
    raw, last = fixture_view(spark, sf_dir, "stays"), F.substring("MUNIC_RES", -1, 1)
    made = (spark.sparkContext.applicationId, *sorted(raw.inputFiles())[:1])
    if made not in _CUBES:
        root = scratch_path(spark, "cube")
        for step in ({"a": "01", "b": "456"}, {"a": "0123", "c": "789"}):
            for name, digits in step.items():
                raw.where(last.isin(list(digits))).write.mode("overwrite").parquet(f"{root}/in/{name}")
            consolidation.update_cube(spark, f"{root}/in/*", f"{root}/cube", "CIHA")
        _CUBES[made] = f"{root}/cube"
    return consolidation.open_cube(spark, _CUBES[made], "CIHA")


#: A filter asked of the cube after it was made.
CUBE_FILTER = Filters(sexo=("Feminino",))


def q_cube_ts_month(spark, sf_dir):
    return series.time_series(stays_cube(spark, sf_dir).dated(CUBE_FILTER), "month")


def q_cube_type_distribution(spark, sf_dir):
    return code_ops.type_distribution(stays_cube(spark, sf_dir).filtered(CUBE_FILTER))


def q_cube_missingness(spark, sf_dir):
    return quality.missingness(stays_cube(spark, sf_dir).filtered())


def q_scan_numeric_drift(spark, sf_dir):
    """Decimals of two widths, a boolean beside an integer, a partitioned
    folder, a leftover of a failed write and a success mark, by one glob."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    root = scratch_path(spark, "numeric-drift")
    (orders.where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS id", "CAST(o_totalprice AS DECIMAL(10,2)) AS valor", "o_orderkey % 4 = 0 AS marca",
                                                   "o_orderstatus AS situacao").write.partitionBy("situacao").parquet(f"{root}/a"))
    (orders.where("o_orderkey % 2 = 1").selectExpr("o_orderkey AS id", "CAST(o_totalprice AS DECIMAL(12,2)) AS valor",
                                                   "CAST(o_orderkey % 7 AS INT) AS marca").write.parquet(f"{root}/b"))
    orders.limit(5).selectExpr("o_orderkey AS id").write.parquet(f"{root}/b/_temporary/0/task_1")
    orders.limit(0).selectExpr("o_orderkey AS id").write.parquet(f"{root}/_SUCCESS")
    return parquet.read_base(spark, f"{root}/*").select("id", F.col("valor").cast("double").alias("valor"), "marca", "situacao")


def partition_folders(spark, sf_dir):
    """Orders in folders by year and status, the status of one year's rows
    null, beside a leftover of a failed write."""
    root = scratch_path(spark, "partition-folders")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "o_orderkey AS id", "o_custkey AS cliente", "year(o_orderdate) AS ano",
        "CASE WHEN year(o_orderdate) <> 1995 THEN o_orderstatus END AS situacao")
    orders.write.partitionBy("ano", "situacao").parquet(root)
    orders.limit(5).select("id").write.parquet(f"{root}/_temporary/0/ano=1990")
    return root


def _of_years(df):
    return df.where("ano between 1994 and 1996").select("id", "cliente", F.col("ano").cast("int").alias("ano"), "situacao")


def q_scan_folder_glob(spark, sf_dir):
    return _of_years(parquet.read_base(spark, f"{partition_folders(spark, sf_dir)}/*"))


def q_scan_file_glob(spark, sf_dir):
    return _of_years(parquet.read_base(spark, f"{partition_folders(spark, sf_dir)}/*/*/*.parquet"))


def q_scan_folder_list(spark, sf_dir):
    """Two partition folders, one of them by its files."""
    root = partition_folders(spark, sf_dir)
    return _of_years(parquet.read_base(spark, [f"{root}/ano=1994", f"{root}/ano=1995/*/*.parquet", f"{root}/ano=1997"]))


def q_top_values(spark, sf_dir):
    """The most frequent of a column that is nearly unique but for a few values."""
    rare = F.concat_ws("-", F.lit("item"), "l_orderkey", "l_linenumber")
    value = F.when(F.col("l_orderkey") % 4 == 0, F.concat("l_returnflag", "l_linestatus", (F.col("l_partkey") % 7).cast("string"))).otherwise(rare)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(value.alias("valor"))
    return topk.top_values(rows, "valor", 12)


def q_territory_cut(spark, sf_dir):
    df = export.territory_cut(filtered(spark, sf_dir, "stays"), TERRITORY)
    return series.time_series(df, "year")


# -- the same operators on unmodified tables (typed columns) -------------------

def _table_register(spark, sf_dir, table, roles):
    raw = parquet.read_base(spark, f"{sf_dir}/{table}.parquet")
    return open_register(raw, "SINAN", roles=roles)


def q_ts_orders_month(spark, sf_dir):
    # a TIMESTAMP column takes the native branch of the date parse
    reg = _table_register(spark, sf_dir, "orders", Roles(date="o_orderdate", outcome="o_orderstatus"))
    return series.time_series(reg.filtered(), "month")


def q_ts_events_week(spark, sf_dir):
    reg = _table_register(spark, sf_dir, "events", Roles(date="ts"))
    return series.time_series(reg.filtered(), "week")


def q_top_part_type(spark, sf_dir):
    reg = _table_register(spark, sf_dir, "part", Roles(diagnosis="p_type"))
    return quality.top_category(reg.filtered(), DIAGNOSIS)


def q_top_event_type(spark, sf_dir):
    reg = _table_register(spark, sf_dir, "events", Roles(date="ts", outcome="event_type"))
    return quality.top_category(reg.filtered(), OUTCOME)


def q_age_distribution_part_size(spark, sf_dir):
    # an INTEGER column read as ages in years
    reg = _table_register(spark, sf_dir, "part", Roles(age="p_size", age_mode=AGE_MODE_DIRECT))
    return demography.age_distribution(reg.filtered())


# -- the death register at its full width: nine code columns --------------------

WIDE_FILTER = Filters(tipo=(CODE_RULES[2][2], CODE_RULES[6][2]))


def q_wide_codes(spark, sf_dir):
    rec = register(spark, sf_dir, "deaths_wide").recoded
    return rec.select(F.col(CODE).alias("cid"), F.col(CODE_ORIGIN).alias("coluna_origem_cid"), F.col(CODE_TYPE).alias("tipo_agravo_cid10"))


def q_wide_type_distribution(spark, sf_dir):
    return code_ops.type_distribution(filtered(spark, sf_dir, "deaths_wide"))


def q_wide_top_codes(spark, sf_dir):
    return code_ops.top_codes(filtered(spark, sf_dir, "deaths_wide"))


def q_wide_code_origin(spark, sf_dir):
    return code_ops.code_origin_counts(filtered(spark, sf_dir, "deaths_wide"))


def q_wide_enriched_label_filter(spark, sf_dir):
    reg = register(spark, sf_dir, "deaths_wide")
    return quality.enriched_rows(reg.filtered(WIDE_FILTER), reg.roles)


def q_wide_ts_label_filter(spark, sf_dir):
    return series.time_series(register(spark, sf_dir, "deaths_wide").dated(WIDE_FILTER), "month")


QUERIES: Dict[str, Query] = {
    "clean_text": q_clean_text,
    "clean_unicode_spaces": q_clean_unicode_spaces,
    "parse_dates": q_parse_dates,
    "age_coded": q_age_coded,
    "age_with_unit": q_age_with_unit,
    "age_direct": q_age_direct,
    "age_auto": q_age_auto,
    "recode_sex": q_recode_sex,
    "extract_code": q_extract_code,
    "extract_code_multi": q_extract_code_multi,
    "code_origin_rows": q_code_origin_rows,
    "classify_code": q_classify_code,
    "canonical_projection": q_canonical_projection,
    "filter_conjunctive": q_filter_conjunctive,
    "filter_options": q_filter_options,
    "dataset_metrics": q_dataset_metrics,
    "ts_year": _ts("year"),
    "ts_month": _ts("month"),
    "ts_week": _ts("week"),
    "ts_month_by_type": q_ts_month_by_type,
    "year_bounds": q_year_bounds,
    "heatmap_long": q_heatmap_long,
    "heatmap_pivot": q_heatmap_pivot,
    "top_diagnosis": _top(DIAGNOSIS),
    "top_outcome": _top(OUTCOME),
    "top_municipality": _top(MUNICIPALITY),
    "age_distribution": q_age_distribution,
    "age_pyramid": q_age_pyramid,
    "type_distribution": q_type_distribution,
    "top_type": q_top_type,
    "top_codes": q_top_codes,
    "code_origin": q_code_origin,
    "missingness": q_missingness,
    "missingness_stays": q_missingness_stays,
    "enriched_rows": q_enriched_rows,
    "compare_series": q_compare_series,
    "compare_series_by_type": q_compare_series_by_type,
    "index_base100": q_index_base100,
    "compare_types": q_compare_types,
    "schema_describe": q_schema_describe,
    "preview_rows": q_preview_rows,
    "scan_union_by_name": q_scan_union_by_name,
    "consolidate_by_year": q_consolidate_by_year,
    "consolidate_full_rows": q_consolidate_full_rows,
    "consolidate_incremental": q_consolidate_incremental,
    "cube_ts_month": q_cube_ts_month,
    "cube_type_distribution": q_cube_type_distribution,
    "cube_missingness": q_cube_missingness,
    "scan_numeric_drift": q_scan_numeric_drift,
    "scan_folder_glob": q_scan_folder_glob,
    "scan_file_glob": q_scan_file_glob,
    "scan_folder_list": q_scan_folder_list,
    "top_values": q_top_values,
    "territory_cut": q_territory_cut,
    "wide_codes": q_wide_codes,
    "wide_type_distribution": q_wide_type_distribution,
    "wide_top_codes": q_wide_top_codes,
    "wide_code_origin": q_wide_code_origin,
    "wide_enriched_label_filter": q_wide_enriched_label_filter,
    "wide_ts_label_filter": q_wide_ts_label_filter,
    "ts_orders_month": q_ts_orders_month,
    "ts_events_week": q_ts_events_week,
    "top_part_type": q_top_part_type,
    "top_event_type": q_top_event_type,
    "age_distribution_part_size": q_age_distribution_part_size,
}
