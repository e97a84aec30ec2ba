"""Register-shaped fixture views derived from the driver's tables.

The raw registers (case notifications, deaths, hospital stays) are not
available, so three views with their layouts are derived from ``lineitem``
and ``orders``. Each column is one SQL expression that Spark
(``selectExpr``) and DuckDB evaluate identically (only ``CAST``, ``LPAD``,
``SUBSTR``, ``%``, ``||`` and ``CASE``), so the Spark query and the SQL
oracle read exactly the same rows. Blank, NULL, invalid and mixed-format
values occur by construction. The views grow with the tables: every row of
``lineitem`` / ``orders`` becomes one register row.
"""

from __future__ import annotations

from typing import Dict, List, Optional, Sequence, Tuple

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

# FIXED VALUES — value lists the fixture columns cycle through.
SEX_VALUES = ("M", "F", "1", "2", "3", "I", "0", "9", "IGN", " m ", "X", "", None)
CODE_VALUES = ("G039", "*G039", "G03.9", "A419/G009", "A17.0", "a390", "A87", "A87.9",
               "G00", "G01X", "G02", "B99", "", None)
DEATH_CAUSES = ("B99", None, "", "G009", "R99")
STAY_SEX = ("1", "3")
STAY_AGES = ("12", "3,5", "40", "", "abc", None, "7")
STAY_AGE_UNITS = ("0", "1", "2", "3", "4", "5", "9", None)


def _lit(v: Optional[str]) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def pick(k: str, values: Sequence[Optional[str]]) -> str:
    """``values[k mod len(values)]`` as a CASE expression."""
    arms = " ".join(f"WHEN {i} THEN {_lit(v)}" for i, v in enumerate(values))
    return f"CASE ({k}) % {len(values)} {arms} END"


def _part(d: str, start: int, length: int) -> str:
    return f"SUBSTR(CAST(CAST({d} AS DATE) AS STRING), {start}, {length})"


def mixed_date(d: str, k: str) -> str:
    """Date ``d`` spelled in one of seven layouts chosen by ``k``, with an
    impossible date, a blank and a NULL mixed in."""
    y, m, dd = _part(d, 1, 4), _part(d, 6, 2), _part(d, 9, 2)
    layouts = [
        f"{y} || '-' || {m} || '-' || {dd}",
        f"{y} || {m} || {dd}",
        f"{dd} || {m} || {y}",
        f"{y} || {m}",
        f"{y}",
        f"{dd} || '/' || {m} || '/' || {y}",
        f"{dd} || '-' || {m} || '-' || {y}",
    ]
    by_layout = " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(layouts[:-1]))
    return (f"CASE WHEN ({k}) % 24 = 7 THEN '31022020' WHEN ({k}) % 24 = 15 THEN '' "
            f"WHEN ({k}) % 24 = 23 THEN NULL "
            f"ELSE CASE ({k}) % 8 {by_layout} ELSE {layouts[-1]} END END")


def _padded(expr: str, width: int) -> str:
    return f"LPAD(CAST({expr} AS STRING), {width}, '0')"


def _cases() -> Tuple[str, List[Tuple[str, str]]]:
    k = "l_orderkey * 7 + l_linenumber"
    age = (f"CASE WHEN ({k}) % 9 = 8 THEN NULL "
           f"WHEN ({k}) % 9 = 7 THEN CAST(({k}) % 100 AS STRING) "
           f"WHEN ({k}) % 9 = 6 THEN CAST(({k}) % 6 AS STRING) || {_padded(f'({k}) % 60', 2)} "
           f"ELSE CAST(({k}) % 6 AS STRING) || {_padded(f'({k}) % 110', 3)} END")
    return "lineitem", [
        ("DT_SIN_PRI", mixed_date("l_shipdate", k)),
        ("CS_SEXO", pick(k, SEX_VALUES)),
        ("NU_IDADE_N", age),
        ("ID_MN_RESI", f"'33' || {_padded('l_suppkey % 97', 4)}"),
        ("EVOLUCAO", "l_returnflag"),
        ("ID_AGRAVO", pick(k, CODE_VALUES)),
    ]


def _deaths() -> Tuple[str, List[Tuple[str, str]]]:
    k = "o_orderkey"
    return "orders", [
        ("DTOBITO", mixed_date("o_orderdate", k)),
        ("SEXO", pick(k, SEX_VALUES)),
        ("IDADE", f"CAST({k} % 6 AS STRING) || {_padded(f'{k} % 100', 2)}"),
        ("CODMUNRES", f"'33' || {_padded('o_custkey % 89', 4)}"),
        ("LOCOCOR", "o_orderstatus"),
        ("CAUSABAS", pick(k, DEATH_CAUSES)),
        ("LINHAA", pick(k, CODE_VALUES)),
        ("LINHAII", pick(f"{k} + 5", CODE_VALUES)),
    ]


def _stays() -> Tuple[str, List[Tuple[str, str]]]:
    k = "o_orderkey"
    return "orders", [
        ("DT_ATEND", mixed_date("o_orderdate", f"{k} + 3")),
        ("SEXO", pick(f"{k} + 1", STAY_SEX)),
        ("IDADE", pick(k, STAY_AGES)),
        ("COD_IDADE", pick(k, STAY_AGE_UNITS)),
        ("MUNIC_RES", f"'33' || {_padded('o_custkey % 89', 4)}"),
        ("MODALIDADE", "o_orderpriority"),
        ("DIAG_PRINC", pick(f"{k} + 2", CODE_VALUES)),
        ("DIAG_SECUN", pick(f"{k} + 9", CODE_VALUES)),
    ]


#: The nine code columns of the death register, in priority order.
DEATH_CODE_COLUMNS = ("CAUSABAS", "CAUSABAS_O", "LINHAA", "LINHAB", "LINHAC", "LINHAD", "LINHAII", "ATESTADO", "CB_PRE")


def _deaths_wide() -> Tuple[str, List[Tuple[str, str]]]:
    """The death register at its full width: nine code columns, few of which
    hold a code, at a different place from row to row."""
    k = "o_orderkey"
    table, cols = _deaths()
    own = [(c, f"CASE WHEN ({k} + {i}) % 5 = 0 THEN {pick(f'{k} * 3 + {i}', CODE_VALUES)} "
               f"ELSE {pick(f'{k} + {i}', DEATH_CAUSES[:3])} END") for i, c in enumerate(DEATH_CODE_COLUMNS)]
    return table, [c for c in cols if c[0] not in DEATH_CODE_COLUMNS] + own


VIEWS = {"cases": _cases, "deaths": _deaths, "stays": _stays, "deaths_wide": _deaths_wide}
# Register each view stands in for.
VIEW_PROFILE = {"cases": "SINAN", "deaths": "SIM", "stays": "CIHA", "deaths_wide": "SIM"}


def view_columns(name: str) -> Tuple[str, List[Tuple[str, str]]]:
    return VIEWS[name]()


def view_select_sql(name: str) -> str:
    """``SELECT ... FROM <table>`` text of a view (used by the SQL oracle)."""
    table, cols = view_columns(name)
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in cols) + f" FROM {table}"


# (application id, view, state of the table's files) -> Parquet path of the written view
_WRITTEN: Dict[tuple, str] = {}


def table_state(spark: SparkSession, path: str) -> tuple:
    """What tells one state of a table's files from another: path, size and
    time of each."""
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    it = hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(hp, True)
    out = []
    while it.hasNext():
        f = it.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def fixture_projection(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a lazy Spark projection over the table's Parquet file."""
    table, cols = view_columns(name)
    src = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    return src.selectExpr(*[f"{e} AS {c}" for c, e in cols])


def fixture_view(spark: SparkSession, sf_dir: str, name: str, rows_per_file: int = 50_000) -> DataFrame:
    """The view as a register extract: written once per application and state
    of the table's files as Parquet under the shared checkpoint folder, then
    read like any real extract. Reading it back keeps the recode plans
    identical to those on real files (a raw column is a plain column, not a
    CASE expression that Catalyst would inline into every reference). The
    scan tasks write it straight away, without a shuffle, in files of
    ``rows_per_file`` rows, which later scans read in parallel."""
    table, _ = view_columns(name)
    key = (spark.sparkContext.applicationId, name, table_state(spark, f"{sf_dir.rstrip('/')}/{table}.parquet"))
    path = _WRITTEN.get(key)
    if path is None:
        path = scratch_path(spark, f"fixture-{name}")
        fixture_projection(spark, sf_dir, name).write.option("maxRecordsPerFile", rows_per_file).parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(path)


def fixture_views(spark: SparkSession, sf_dir: str) -> Dict[str, DataFrame]:
    return {n: fixture_view(spark, sf_dir, n) for n in VIEWS}
