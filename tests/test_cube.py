"""The cube answers every table under any filter as the register does."""

import pytest
from pyspark.sql import functions as F

from epispark.catalog.queries import register
from epispark.plans.cube import digest
from epispark.plans.onepass import one_pass_report
from epispark.plans.recode import Filters
from epispark.plans.report import Register, open_register, standard_report
from epispark.profiles import CODE_RULES
from epispark.sources import parquet
from epispark.sources.consolidation import Consolidation, open_cube, update_cube
from epispark.sources.fixtures import VIEW_PROFILE, fixture_projection

from conftest import SF_SMALL

FILTERS = {"cases": [Filters(years=(1995, 1997), sexo=("Masculino",)), Filters(municipio=("330045",), desfecho=("1",))],
           "deaths_wide": [Filters(years=None, tipo=(CODE_RULES[2][2],))]}


def tables(report):
    return {name: (df.columns, sorted((tuple(r) for r in df.collect()), key=repr)) for name, df in report.items() if name != "enriched_rows"}


@pytest.mark.parametrize("view", ["cases", "deaths_wide"])
def test_cube_equals_register_under_filters(spark, view):
    reg = register(spark, SF_SMALL, view)
    rec = digest(reg.recoded)
    cube = Register(reg.name, rec, reg.roles, rec.persist())
    for filters in FILTERS[view]:
        assert tables(standard_report(cube, filters)) == tables(standard_report(reg, filters)), filters
    assert "enriched_rows" not in standard_report(cube)


def test_files_are_added_replaced_and_taken_away(spark, tmp_dir):
    raw = fixture_projection(spark, SF_SMALL, "stays")
    part = F.substring("MUNIC_RES", -1, 1)
    source, cube_dir = f"{tmp_dir}/in", f"{tmp_dir}/cube"

    def deliver(name, digits):
        raw.where(part.isin(list(digits))).coalesce(1).write.mode("overwrite").parquet(f"{source}/{name}")

    def same(filters=Filters()):
        reg = open_register(parquet.read_base(spark, f"{source}/*"), VIEW_PROFILE["stays"])
        got = open_cube(spark, cube_dir, "CIHA")
        assert got.roles == reg.roles
        assert tables(standard_report(got, filters)) == tables(standard_report(reg, filters))
        return got

    assert open_cube(spark, cube_dir, "CIHA") is None
    deliver("a", "012"), deliver("b", "345")
    assert len(update_cube(spark, f"{source}/*", cube_dir, "CIHA").taken) == 2
    same()
    assert update_cube(spark, f"{source}/*", cube_dir, "CIHA") == Consolidation()
    deliver("c", "6789"), deliver("a", "01")
    done = update_cube(spark, f"{source}/*", cube_dir, "CIHA")
    assert (len(done.taken), len(done.removed)) == (2, 1) and len(done.years) <= 3
    got = same(Filters(years=(1994, 1996)))
    # a report under another filter scans the cube alone
    plan = standard_report(got, Filters(sexo=("Feminino",)))["type_distribution"]._jdf.queryExecution().executedPlan().toString()
    assert cube_dir in plan and source not in plan and "regexp" not in plan.lower()
    one = one_pass_report(got, Filters(years=(1994, 1996)))
    whole = standard_report(got, Filters(years=(1994, 1996)))
    assert all(tables({k: one[k]}) == tables({k: whole[k]}) for k in whole if k in one)


def test_ages_outside_the_bands_are_not_missing(spark):
    df = spark.createDataFrame([(34.9,), (30.0,), (120.0,), (120.5,), (-1.0,), (None,), (float("nan"),)], "ep_idade double")
    got = {r.ep_idade: r.ep_n for r in digest(df).collect()}
    assert got == {30.0: 2, 120.0: 1, 121.0: 3, None: 1}
