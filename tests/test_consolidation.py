"""A consolidated table follows its files, rewriting only what they touch."""

import glob
import os
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from epispark.plans.report import open_register
from epispark.sources import consolidation, export, parquet
from epispark.sources.consolidation import consolidate_files, manifest

CODES = ["G039", "A87", "G00", "B99", None]


def month(path, year, m, n=6, **more):
    rows = {"NUM": [year * 10000 + m * 100 + i for i in range(n)], "DT_ATEND": [f"{year}-{m:02d}-{i + 1:02d}" if i % 5 else "" for i in range(n)],
            "DIAG_PRINC": [CODES[i % 5] for i in range(n)], "MUNIC_RES": [f"{330000 + i % 3}" for i in range(n)], **more}
    pq.write_table(pa.table(rows), path)


def rows_of(df):
    return sorted((r.NUM, r.ano, r.ep_cid, r.ep_municipio, str(r.ep_data)) for r in df.select("NUM", "ano", "ep_cid", "ep_municipio", "ep_data").collect())


def anew(spark, tmp_dir, source):
    reg = open_register(parquet.read_base(spark, source), "CIHA", keep_all=True)
    out = export.consolidate_by_year(reg.recoded, f"{tmp_dir}/anew-{len(os.listdir(tmp_dir))}")
    return rows_of(parquet.read_base(spark, out))


def state(table):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{table}/ano=*/*.parquet")}


def years_changed(before, after):
    return {p.split("ano=")[1].split("/")[0] for p in before.keys() ^ after.keys() | {p for p in before.keys() & after.keys() if before[p] != after[p]}}


def test_table_follows_its_files(spark, tmp_dir):
    source, table = f"{tmp_dir}/in", f"{tmp_dir}/table"
    os.makedirs(source)
    for year in (2019, 2020, 2021):
        for m in (1, 2):
            month(f"{source}/ciha {year}+{m}.parquet", year, m)

    def run():
        before = state(table)
        done = consolidate_files(spark, f"{source}/*", table, "CIHA")
        if os.listdir(source):
            assert rows_of(parquet.read_base(spark, table)) == anew(spark, tmp_dir, source)
        return done, years_changed(before, state(table))

    null = "__HIVE_DEFAULT_PARTITION__"
    done, years = run()
    assert len(done.taken) == 6 and years == {"2019", "2020", "2021", null}
    # a repeated run writes nothing, the manifest included
    versions = os.listdir(f"{table}/_manifest")
    assert run() == (consolidation.Consolidation(), set()) and os.listdir(f"{table}/_manifest") == versions
    # one more month: its year, and the rows without a date
    month(f"{source}/ciha 2020+3.parquet", 2020, 3)
    done, years = run()
    assert done.years == (2020, None) and years == {"2020", null} and len(done.taken) == 1
    # a replaced file, now of another year: the rows it gave before go
    month(f"{source}/ciha 2019+2.parquet", 2021, 7, n=9)
    done, years = run()
    assert done.years == (2019, 2021, None) and years == {"2019", "2021", null}
    # a file that is gone
    os.remove(f"{source}/ciha 2019+1.parquet")
    done, years = run()
    assert len(done.removed) == 1 and not glob.glob(f"{table}/ano=2019")
    assert manifest(spark, table).count() == 6 and len(os.listdir(f"{table}/_manifest")) == 2


def test_a_run_that_broke_off_is_repeated(spark, tmp_dir):
    source, table = f"{tmp_dir}/in", f"{tmp_dir}/table"
    os.makedirs(source)
    month(f"{source}/a.parquet", 2019, 1)
    month(f"{source}/b.parquet", 2020, 1)
    consolidate_files(spark, source, table, "CIHA")
    first = rows_of(parquet.read_base(spark, table))
    shutil.rmtree(f"{table}/_manifest")  # the rows were written, the manifest was not
    os.rename(f"{source}/b.parquet", f"{source}/c.parquet")
    assert len(consolidate_files(spark, source, table, "CIHA").taken) == 2
    assert rows_of(parquet.read_base(spark, table)) == first == anew(spark, tmp_dir, source)


def test_layout_and_roles_may_change(spark, tmp_dir):
    """A later file has text where numbers were, a new column, and a better
    date column: all files are taken in again where roles change."""
    source, table = f"{tmp_dir}/in", f"{tmp_dir}/table"
    os.makedirs(source)
    month(f"{source}/a.parquet", 2019, 1)
    consolidate_files(spark, source, table, "CIHA")
    month(f"{source}/b.parquet", 2020, 1, NUM=[f"x{i}" for i in range(6)], OUTRA=list(range(6)))
    assert len(consolidate_files(spark, source, table, "CIHA").taken) == 1
    back = parquet.read_base(spark, table)
    assert "OUTRA" in back.columns and rows_of(back) == anew(spark, tmp_dir, source)
    month(f"{source}/c.parquet", 2021, 1, DIAG_SECUN=["A390"] * 6, NUM=[f"y{i}" for i in range(6)])
    assert len(consolidate_files(spark, source, table, "CIHA").taken) == 3
    assert rows_of(parquet.read_base(spark, table)) == anew(spark, tmp_dir, source)


def test_empty_sources_and_foreign_tables(spark, tmp_dir):
    assert consolidate_files(spark, f"{tmp_dir}/none*", f"{tmp_dir}/t", "CIHA") == consolidation.Consolidation()
    spark.range(3).withColumn("ano", F.lit(1)).write.partitionBy("ano").parquet(f"{tmp_dir}/foreign")
    month(f"{tmp_dir}/a.parquet", 2019, 1)
    with pytest.raises(ValueError):
        consolidate_files(spark, f"{tmp_dir}/a.parquet", f"{tmp_dir}/foreign", "CIHA")


def scanned(df):
    """Rows that the Parquet scan hands on, after row groups and pages were
    skipped by statistics, indexes, dictionaries and bloom filters."""
    query = df._jdf.queryExecution()
    list(map(len, df.collect()))
    plan, found = query.executedPlan(), []

    def walk(node):
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())

    walk(plan)
    return sum(found)


def test_a_filter_reads_a_small_share_of_the_rows(spark, tmp_dir):
    """Sorted by municipality and code within a year: a filter on one of 200
    municipalities reads under a tenth of the rows, of an unsorted table all."""
    n = 200_000
    raw = spark.range(n).select(
        F.col("id").alias("NUM"), F.concat(F.lit("20"), F.lpad((10 + F.col("id") % 2).cast("string"), 2, "0"), F.lit("-03-01")).alias("DT_ATEND"),
        F.concat(F.lit("A"), F.when(F.col("id") % 97 == 0, "87").otherwise("390")).alias("DIAG_PRINC"),
        (330000 + F.xxhash64("id") % 100).cast("string").alias("MUNIC_RES"), F.sha2(F.col("id").cast("string"), 256).alias("OUTRA"))
    reg = open_register(raw, "CIHA", keep_all=True)
    kept = export.with_year(reg.recoded)
    export.write_years(kept, f"{tmp_dir}/sorted", row_group_bytes=1 << 20)
    kept.write.option("parquet.block.size", 1 << 20).partitionBy("ano").parquet(f"{tmp_dir}/plain")
    for name, most in (("sorted", 0.1), ("plain", 1.0)):
        df = spark.read.parquet(f"{tmp_dir}/{name}")
        one = df.where("ep_municipio = '330007'").select("NUM", "OUTRA")
        share = scanned(one) / n
        assert share <= most and (most < 1 or share > 0.9), (name, share)
    assert spark.read.parquet(f"{tmp_dir}/sorted").where("ep_municipio = '330007'").count() == kept.where("ep_municipio = '330007'").count()
    groups = pq.ParquetFile(sorted(glob.glob(f"{tmp_dir}/sorted/ano=2010/*.parquet"))[0]).metadata
    at = [i for i in range(groups.num_columns) if groups.row_group(0).column(i).path_in_schema == "ep_municipio"][0]
    ranges = [groups.row_group(i).column(at).statistics for i in range(groups.num_row_groups)]
    hit = sum(s.min <= "330007" <= s.max for s in ranges)
    assert len(ranges) >= 5 and hit <= 0.4 * len(ranges)
