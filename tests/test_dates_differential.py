"""The date parse against DuckDB's casts on generated date-like text.

Values are compared as day numbers since 1970-01-01, so years 0 and above
9999 (spelled differently by the two engines) compare exactly too.
"""

import itertools
import random

import duckdb
from pyspark.sql import functions as F

from epispark.catalog.oracle import date_sql
from epispark.functions import parse_date


def generated(n=4000, seed=11):
    years = ["2020", "1899", "1900", "2099", "2100", "0001", "202", "20201", "7"]
    months = ["1", "01", "12", "13", "00", "02"]
    days = ["5", "05", "29", "30", "31", "00", "32"]
    seps = ["-", "/", " ", "\\", ".", ""]
    times = ["", " 10:00:00", "T10:00:00", " 1:00", "T10:00:00Z", " 10:00:00.123", " abc", "Z", " 25:00:00",
             " 10:60", " 10:00:00+03:00", " 10:00:00 UTC", " 10", " 10:00:00,1", " 24:00:00"]
    vals = set()
    for y, m, d, s, t in itertools.product(years, months, days, seps, times):
        vals.add(f"{y}{s}{m}{s}{d}{t}")
        vals.add(f"{d}{s}{m}{s}{y}{t}")
    rnd = random.Random(seed)
    sample = rnd.sample(sorted(vals), n)
    extra = ["\t2020-01-05", "2020-01-05\n", " 2020-01-05 ", "2020-01/05", "2020/01-05", "20200105", "05012020",
             "202001", "2020", "31022020", "05/01/2020", "5/1/2020", "05-01-2020", "", "   ", "2020-01-05 10:00 abc"]
    return sample + extra


def test_parse_date_matches_duckdb_casts(spark):
    vals = generated()
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    days = F.datediff(parse_date("v", df.schema["v"].dataType), F.lit("1970-01-01").cast("date"))
    got = {r[0]: r[1] for r in df.select("v", days).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t(v VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(v,) for v in vals])
    want = {r[0]: r[1] for r in con.execute(
        f"SELECT v, ({date_sql('v')}) - DATE '1970-01-01' FROM t").fetchall()}
    bad = [(v, got[v], want[v]) for v in vals if got[v] != want[v]]
    assert bad == []
