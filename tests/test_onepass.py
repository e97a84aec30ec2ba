"""The one-pass report equals the per-table operators, table by table."""

import pytest

from epispark.catalog.queries import register
from epispark.operators import codes as code_ops
from epispark.operators import demography, quality, series
from epispark.plans.onepass import lattice_report, one_pass_report, roll_ups
from epispark.plans.recode import DIAGNOSIS, MUNICIPALITY, OUTCOME, Filters

from conftest import SF_SMALL


def rows(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=repr)


def expected(reg, filters):
    f = reg.filtered(filters)
    out = {
        "dataset_metrics": quality.dataset_metrics(f),
        "missingness": quality.missingness(f),
        "filter_options": quality.filter_options(reg.recoded),
        "year_bounds": quality.year_bounds(reg.recoded),
        "time_series": series.time_series(f, "month"),
        "time_series_by": series.time_series_by(f, "month"),
        "heatmap_long": series.month_heatmap(f),
        "heatmap_pivot": series.heatmap_pivot(f),
        "top_diagnosis": quality.top_category(f, DIAGNOSIS),
        "top_outcome": quality.top_category(f, OUTCOME),
        "top_municipality": quality.top_category(f, MUNICIPALITY),
        "age_distribution": demography.age_distribution(f),
        "age_pyramid": demography.age_pyramid(f),
        "type_distribution": code_ops.type_distribution(f),
        "top_codes": code_ops.top_codes(f),
        "code_origin": code_ops.code_origin_counts(f),
    }
    return out


@pytest.mark.parametrize("view", ["cases", "deaths", "stays"])
@pytest.mark.parametrize("filters", [Filters(), Filters(years=(1995, 1997), sexo=("Masculino",))],
                         ids=["default", "narrow"])
def test_one_pass_equals_operators(spark, view, filters):
    reg = register(spark, SF_SMALL, view)
    got = one_pass_report(reg, filters)
    want = expected(reg, filters)
    assert set(got) == set(want)
    for name, df in want.items():
        assert got[name].columns == df.columns, name
        assert rows(got[name]) == rows(df), name


def test_lattice_equals_one_pass_and_expands_nothing(spark):
    for view in ("cases", "stays"):
        reg = register(spark, SF_SMALL, view)
        filters = Filters(years=(1995, 1997), sexo=("Masculino",))
        got, want = lattice_report(reg, filters), one_pass_report(reg, filters)
        assert list(got) == list(want)
        for name, df in want.items():
            assert got[name].columns == df.columns and rows(got[name]) == rows(df), name
    parts, _ = roll_ups(reg.recoded, filters, materialize_as=None)
    for name, df in parts.items():
        assert "Expand" not in df._jdf.queryExecution().executedPlan().toString(), name


def test_comparison_from_reports(spark):
    from epispark.catalog.queries import QUERIES
    from epispark.plans.onepass import comparison_from_reports

    reports = {name: one_pass_report(register(spark, SF_SMALL, view))
               for name, view in (("SINAN", "cases"), ("SIM", "deaths"), ("CIHA", "stays"))}
    for by_type, index100, q in ((False, False, "compare_series"), (True, False, "compare_series_by_type")):
        got = comparison_from_reports(reports, by_type, index100)["compare_series"]
        assert rows(got) == rows(QUERIES[q](spark, SF_SMALL))
    got = comparison_from_reports(reports)["compare_types"]
    assert rows(got) == rows(QUERIES["compare_types"](spark, SF_SMALL))
