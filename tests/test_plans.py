"""Plan checks: everything stays in the JVM, scans are pruned, windows only
run on aggregated rows, the filter-options cut is a per-group limit."""

import pytest

from epispark.catalog.queries import QUERIES, register
from epispark.operators import quality

from conftest import SF_SMALL

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"preview_rows"}))
def test_no_python_in_plan(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    assert not any(n in p for n in PY_NODES), name


def test_scan_is_pruned(spark):
    p = plan(QUERIES["ts_month"](spark, SF_SMALL))
    # only the date column is read for a time series
    assert "ReadSchema: struct<DT_SIN_PRI:string>" in p


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"preview_rows"}))
def test_windows_only_after_aggregation(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    for below in p.split("+- Window ")[1:]:
        # the first operator under the window's input that is not an
        # exchange/sort/project must be an aggregate or a top-k
        assert "Aggregate" in below.split("Scan")[0] or "TakeOrderedAndProject" in below.split("Scan")[0], name


def test_filter_options(spark):
    """All values without limits; with limits a group limit below the window."""
    rec = register(spark, SF_SMALL, "cases").recoded
    every = quality.filter_options(rec)
    assert "Window" not in every._jdf.queryExecution().optimizedPlan().toString()
    wide = spark.range(6000).selectExpr("cast(id % 5570 as string) as ep_municipio")
    assert quality.filter_options(wide).count() == 5570
    cut = quality.filter_options(rec, {"sexo": 2, "municipio": 3, "desfecho": 1, "cid_tipo": 4})
    assert "WindowGroupLimit" in cut._jdf.queryExecution().optimizedPlan().toString()
    assert cut.groupBy("filtro").count().rdd.collectAsMap() == {"sexo": 2, "municipio": 3, "desfecho": 1, "cid_tipo": 4}


def generated(spark, df):
    """Sizes of the largest generated method of each fused stage; -1 where
    the code did not compile."""
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    it, out = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan()).iterator(), []
    while it.hasNext():
        out.append(it.next()._3().maxMethodCodeSize())
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_generated_code_compiles(spark, name):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that all stages show
    try:
        sizes = generated(spark, QUERIES[name](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert all(0 <= size < 64_000 for size in sizes), sizes


@pytest.mark.parametrize("name", ["wide_enriched_label_filter", "wide_ts_label_filter", "wide_type_distribution"])
def test_one_code_regex_for_nine_columns(spark, name):
    p = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("A17[") <= 3  # in the filter, twice for its blank test, and in the projection


@pytest.mark.parametrize("name", ["ts_month", "heatmap_pivot", "ts_month_by_type"])
def test_date_is_parsed_once(spark, name):
    p = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("^\\d{8}") + p.count("^\\\\d{8}") <= 1, p


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"preview_rows"}))
def test_no_joins_or_unbounded_single_partition(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastHashJoin", "SortMergeJoin"):
        assert bad not in p, (name, bad)
    # a SinglePartition exchange is allowed only above an aggregate (tiny rows)
    for chunk in p.split("Exchange SinglePartition")[1:]:
        assert "HashAggregate" in chunk.split("Scan")[0] or "TakeOrderedAndProject" in p, name


def test_library_never_collects_rows():
    """But for names of files, which Spark's own file index holds as well, and
    the years of a consolidation."""
    import pathlib
    lists = ('select("path").collect()', '"path", "left_anti").collect()', 'drop("size", "modified").collect()', "select(key).distinct().collect()")
    root = pathlib.Path(__file__).resolve().parents[1] / "epispark"
    offenders = []
    for f in (f for f in root.rglob("*.py") if "llm" not in f.parts):
        text = f.read_text()
        for fine in lists if f.parent.name == "sources" else ():
            text = text.replace(fine, "")
        for bad in (".collect()", ".toPandas()", "localCheckpoint"):
            if bad in text:
                offenders.append((f.name, bad))
    assert offenders == []


def _subtrees(plan_text, marker):
    lines = plan_text.splitlines()
    for i, line in enumerate(lines):
        if marker in line:
            indent = len(line) - len(line.lstrip(" :+-"))
            sub = []
            for nxt in lines[i + 1:]:
                if len(nxt) - len(nxt.lstrip(" :+-")) <= indent:
                    break
                sub.append(nxt)
            yield line, sub


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"preview_rows"}))
def test_every_shuffle_is_pre_aggregated(spark, name):
    """Whatever the skew of a key, a shuffle only carries rows that an
    aggregate (partial or final), a group limit or a top-k already reduced."""
    p = plan(QUERIES[name](spark, SF_SMALL))
    for line, sub in _subtrees(p, "Exchange "):
        if "Subquery" in line:
            continue
        upto_scan = []
        for s in sub:
            if "Scan" in s or "Subquery" in s:
                break
            upto_scan.append(s)
        text = "\n".join(upto_scan)
        assert any(k in text for k in ("Aggregate", "WindowGroupLimit", "TakeOrderedAndProject")), (name, line)
