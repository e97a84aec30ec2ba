"""Operator semantics and cross-query properties on the sf0.001 fixtures."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from epispark.catalog.queries import QUERIES, filtered, register
from epispark.operators import codes as code_ops
from epispark.operators import demography, quality, series
from epispark.plans.recode import DATE, Filters, apply_filters

from conftest import SF_SMALL


def collect(df):
    return [r.asDict() for r in df.collect()]


def test_index_base100_golden(spark):
    rows = [("a", 1, 4), ("a", 2, 6), ("b", 1, 0), ("b", 2, 4), ("b", 3, 6), ("c", 1, 0), ("c", 2, 0)]
    df = spark.createDataFrame(rows, "serie string, periodo int, valor long")
    got = {(r.serie, r.periodo): r.valor for r in series.index_base100(df).collect()}
    assert got[("a", 1)] == 100.0 and got[("a", 2)] == 150.0
    assert (got[("b", 1)], got[("b", 2)], got[("b", 3)]) == (0.0, 100.0, 150.0)
    assert (got[("c", 1)], got[("c", 2)]) == (0.0, 0.0)


def test_top_codes_percent_among_kept(spark):
    df = spark.createDataFrame([("A87", "t")] * 6 + [("G00", "t")] * 3 + [("G01", "t")],
                               "ep_cid string, ep_cid_tipo string")
    got = collect(code_ops.top_codes(df, 2))
    assert [(r["cid_detectado"], r["n"], r["pct_entre_cids_detectados"]) for r in got] == [
        ("A87", 6, 66.67), ("G00", 3, 33.33)]


def test_type_distribution_without_group(spark):
    df = spark.createDataFrame([("A87", "t"), ("G00", "t"), (None, None)], "ep_cid string, ep_cid_tipo string")
    assert [tuple(r.values()) for r in collect(code_ops.type_distribution(df))] == [
        (None, "t", 2, 2, "A87, G00", 66.67), (None, None, 1, 0, None, 33.33)]


def test_types_of_very_many_codes(spark):
    """A pattern of any code: no row grows with their number."""
    df = (spark.range(60_000).select(F.concat(F.lit("Z"), (F.col("id") % 20_000).cast("string")).alias("ep_cid"))
          .withColumn("ep_cid_grupo", F.substring("ep_cid", 1, 2)).withColumn("ep_cid_tipo", F.lit("t")))
    got = collect(code_ops.type_distribution(df, list_codes=False))
    assert sum(r["cids_distintos_n"] for r in got) == 20_000 and sum(r["n"] for r in got) == 60_000 and "cids_encontrados" not in got[0]
    assert "collect_list" not in code_ops.type_distribution(df, list_codes=False)._jdf.queryExecution().optimizedPlan().toString()
    rows = code_ops.type_codes(df)
    assert rows.count() == 20_000 and rows.where("n <> 3").count() == 0


def test_pyramid_sign(spark):
    df = spark.createDataFrame([(30.0, "Masculino")] * 7 + [(31.0, "Feminino")] * 7 + [(31.0, "X")],
                               "ep_idade double, ep_sexo string")
    got = {r["sexo"]: (r["n"], r["valor"], r["faixa"]) for r in collect(demography.age_pyramid(df))}
    assert got == {"Masculino": (7, -7, "30–34"), "Feminino": (7, 7, "30–34")}


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "ep_data date, ep_sexo_txt string, ep_cid string, ep_cid_grupo string, "
                                      "ep_cid_tipo string")
    miss = collect(quality.missingness(empty))
    assert all(r["faltantes"] is None and r["pct_faltante"] == 0.0 for r in miss)
    assert collect(code_ops.type_distribution(empty)) == []
    assert quality.year_bounds_values(empty) is None


def test_no_valid_date_keeps_all_rows(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b")], "ep_data date, x string")
    assert apply_filters(df).count() == 2
    df2 = spark.createDataFrame([(dt.date(2020, 1, 1), "a"), (None, "b")], "ep_data date, x string")
    assert apply_filters(df2).count() == 1
    assert apply_filters(df2, Filters(years=None)).count() == 2
    assert apply_filters(df2, Filters(years=(2021, 2022))).count() == 0


def test_series_properties(spark):
    f = filtered(spark, SF_SMALL, "cases")
    valid = f.where(F.col(DATE).isNotNull()).count()
    for freq in ("year", "month", "week"):
        assert sum(r["n"] for r in series.time_series(f, freq).collect()) == valid
    by_type = series.time_series_by(f, "month").groupBy("periodo").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, by_type.collect())) == sorted(map(tuple, series.time_series(f, "month").collect()))
    heat = series.month_heatmap(f).groupBy("ano").agg(F.sum("n").alias("n"))
    years = {r["periodo"].year: r["n"] for r in series.time_series(f, "year").collect()}
    assert {r["ano"]: r["n"] for r in heat.collect()} == years
    pivot = series.heatmap_pivot(f)
    assert pivot.columns == ["ano"] + [str(m) for m in range(1, 13)]
    for r in pivot.collect():
        assert sum(r[str(m)] for m in range(1, 13)) == years[r["ano"]]
    ts = series.time_series(f, "week").collect()
    assert all(r["periodo"].weekday() == 0 for r in ts)  # Monday weeks


def test_demography_and_codes_properties(spark):
    f = filtered(spark, SF_SMALL, "cases")
    dist = {r["faixa_ini"]: r["n"] for r in demography.age_distribution(f).collect()}
    pyr = demography.age_pyramid(f).groupBy("faixa_ini").agg(F.sum("n").alias("n")).collect()
    assert all(dist[r["faixa_ini"]] >= r["n"] for r in pyr)
    d = filtered(spark, SF_SMALL, "deaths")
    td = collect(code_ops.type_distribution(d))
    assert sum(r["n"] for r in td) == d.count()
    assert abs(sum(r["pct"] for r in td) - 100.0) < 0.05
    assert td == sorted(td, key=lambda r: (-r["n"], r["grupo_cid"]))
    origin = sum(r["n"] for r in code_ops.code_origin_counts(d).collect())
    assert origin == d.where(F.col("ep_cid").isNotNull()).count()
    miss = {r["campo"]: r["faltantes"] for r in quality.missingness(f).collect()}
    assert miss["Data"] == 0  # the default year filter drops rows without a date


def test_filter_options_limits(spark):
    rec = register(spark, SF_SMALL, "cases").recoded
    opts = collect(quality.filter_options(rec))
    by = {}
    for r in opts:
        by.setdefault(r["filtro"], []).append(r)
    n_muni = rec.select("ep_municipio").where(F.col("ep_municipio").isNotNull()).distinct().count()
    assert len(by["municipio"]) == min(40, n_muni) and len(by["sexo"]) <= 10
    for rows in by.values():
        assert rows == sorted(rows, key=lambda r: (-r["n"], r["valor"]))


def test_comparison_shapes(spark):
    s = QUERIES["compare_series"](spark, SF_SMALL)
    assert s.columns == ["periodo", "valor", "base", "serie"]
    st = QUERIES["compare_series_by_type"](spark, SF_SMALL)
    assert st.columns == ["periodo", "valor", "base", "serie", "categoria"]
    assert st.where(~F.col("serie").startswith(F.col("base"))).count() == 0
    idx = QUERIES["index_base100"](spark, SF_SMALL).orderBy("serie", "periodo").collect()
    first = {}
    for r in idx:
        first.setdefault(r["serie"], r["valor"])
    assert all(v == 100.0 for v in first.values())
    types = QUERIES["compare_types"](spark, SF_SMALL)
    for r in types.groupBy("base").agg(F.sum("pct").alias("p")).collect():
        assert abs(r["p"] - 100.0) < 0.05


def test_public_surface_options(spark):
    f = filtered(spark, SF_SMALL, "cases")
    assert series.time_series(f, "month", by="ep_cid_tipo").columns == ["periodo", "categoria", "n"]
    assert series.month_heatmap(f, pivot=True).columns[0] == "ano"
    assert len(series.month_heatmap(f, pivot=True).columns) == 13


@pytest.mark.parametrize("name", ["ts_month", "ts_week", "dataset_metrics", "parse_dates", "ts_orders_month"])
def test_results_do_not_depend_on_session_zone(spark, name):
    from epispark.catalog.queries import QUERIES

    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        utc = sorted(map(tuple, QUERIES[name](spark, SF_SMALL).collect()), key=repr)
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        other = sorted(map(tuple, QUERIES[name](spark, SF_SMALL).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert utc == other
