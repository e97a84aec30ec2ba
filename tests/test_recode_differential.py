"""Ages, sex and code extraction against the SQL oracle's expressions on
generated text (number spellings, units, code variants)."""

import math

import duckdb
import pytest

from epispark.catalog.oracle import age_coded_sql, age_direct_sql, age_unit_sql, code_sql, sex_sql
from epispark.functions.text import SPACES
from epispark.functions import age_coded, age_direct, age_with_unit, extract_code, recode_sex

NUMS = ["0", "00", "000", "0000", "1", "7", "45", "99", "100", "120", "121", "999", "4018", "3006", "2365", "5005",
        "6001", "12345", "4018.0", "3,5", "3.5", ".5", "5.", "1.", "1.e2", "1e3", "1E3", "+5", "-5", " 12", "1_000",
        "1__0", "1_.5", "1e1_0", "12f", "12d", "NaN", "+nan", "inf", "-Infinity", "1.234,5", "0x10", "abc", "", " ",
        "4 018", "0045", "045", "5", "05", "005", "9999", "١٢"]
UNITS = ["0", "1", "2", "3", "4", "5", "9", "", None, " 3 ", "03", "x"]
SEXES = ["M", "m", " m ", "F", "f", "1", "2", "3", "0", "9", "I", "i", "IGN", "ign", "X", "x", "10", "1.0", "", " ",
         None, "Masculino", "é"]
CODES = sorted({p + s + t for p in ["", "*", " ", "Z", "1", "A419/"]
                for s in ["A17", "A39", "A87", "G00", "G01", "G02", "G03", "B99", "a87", "g03"]
                for t in ["", "0", ".0", "9", ".9", "X", ".X", "01", "..0", ". 0", "x", "/G009", " G009", "-1"]})


def _same(g, w):
    if isinstance(g, float) and isinstance(w, float):
        return (math.isnan(g) and math.isnan(w)) or g == w
    return g == w


CASES = [
    ("age_coded", [(v,) for v in NUMS], lambda: age_coded("a"), lambda: age_coded_sql("a")),
    ("age_direct", [(v,) for v in NUMS], lambda: age_direct("a"), lambda: age_direct_sql("a")),
    ("age_unit", [(v, u) for v in NUMS for u in UNITS], lambda: age_with_unit("a", "b"), lambda: age_unit_sql("a", "b")),
    ("sex", [(v,) for v in SEXES], lambda: recode_sex("a"), lambda: sex_sql("a")),
    ("code", [(v,) for v in CODES + ["", None, "A1701", "A87G009"]], lambda: extract_code("a"), lambda: code_sql("a")),
]


@pytest.mark.parametrize("name,rows,spark_expr,sql_expr", CASES, ids=[c[0] for c in CASES])
def test_recode_matches_sql(spark, name, rows, spark_expr, sql_expr):
    names = ["a", "b"][:len(rows[0])]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    got = [r[0] for r in df.select(spark_expr()).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE TABLE t({', '.join(n + ' VARCHAR' for n in names)})")
    con.executemany(f"INSERT INTO t VALUES ({', '.join('?' for _ in names)})", rows)
    want = [r[0] for r in con.execute(f"SELECT {sql_expr()} FROM t").fetchall()]
    bad = [(row, g, w) for row, g, w in zip(rows, got, want) if not _same(g, w)]
    assert bad == []


def test_clean_text_matches_sql_trim(spark):
    from epispark.catalog.oracle import txt
    from epispark.functions import clean_text

    # ASCII space, tab, line breaks and zero-width characters; the Unicode
    # space separators (no-break space ...) are a documented deviation
    pads = ["", " ", "\t", "\n", "\u200b", "\u2028", "\u0085", "   "]
    rows = [(p + core + q,) for p in pads for q in pads for core in ["a", "", "a b", " x"]] + [(None,)]
    df = spark.createDataFrame(rows, "a string")
    got = [r[0] for r in df.select(clean_text("a")).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t(a VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", rows)
    want = [r[0] for r in con.execute(f"SELECT {txt('a')} FROM t").fetchall()]
    assert [(r, g, w) for r, g, w in zip(rows, got, want) if g != w] == []


def test_unicode_spaces_are_trimmed_like_sql(spark):
    """Every code point of the space separators, and some that only look like
    one, around and inside of values: as in SQL, through a whole recode."""
    import unicodedata

    from epispark.plans.recode import recode
    from epispark.plans.roles import Roles

    points = sorted({*SPACES, *"\t\n\u200b\ufeff\u2028\u0085\u180e", *(chr(c) for c in range(0x2000, 0x2070))})
    assert {c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Zs"} == set(SPACES)
    rows = [(pattern.replace("_", c), "x") for c in points for pattern in ("_M", "M_", "_ M__", "_", "", "M_F", "_é_", "2020-01-05_", "_A87.9")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [tuple(r) for r in recode(df, Roles(sex="a", municipality="a", codes=("a", "b"), age="a"))
           .select("ep_sexo", "ep_sexo_txt", "ep_municipio", "ep_cid").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t(a VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(a,) for a, _ in rows])
    want = con.execute(f"SELECT {sex_sql('a')}, nullif(trim(a), ''), nullif(trim(a), ''), {code_sql('a')} FROM t").fetchall()
    assert [(a, g, w) for (a, _), g, w in zip(rows, got, want) if g != w] == []
