"""Hand-derived golden rows for the scalar recodes and name rules."""

import datetime as dt
import random

from pyspark.sql import functions as F

from epispark.functions import (
    age_coded,
    age_direct,
    age_with_unit,
    build_age,
    clean_text,
    code_group,
    code_origin,
    code_type,
    extract_code,
    extract_code_multi,
    normalize_name,
    parse_date,
    recode_sex,
    safe_alias,
)
from epispark.functions.text import output_names
from epispark.functions.periods import band_label, round_half_away, round_half_even
from epispark.functions.codes import joinable, label_predicate
from epispark.operators.quality import enriched_rows
from epispark.plans.recode import recode
from epispark.plans.roles import choose_candidate, choose_candidates, detect_roles
from epispark.profiles import (
    AGE_MODE_AUTO,
    AGE_MODE_CODED,
    AGE_MODE_UNIT,
    CIHA,
    CODE_PATTERN,
    CODE_RULES,
    NO_CODE_LABEL,
    OTHER_CODE_LABEL,
    SIM,
    SINAN,
)

D = dt.date


def run(spark, values, expr_fn, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr_fn("v", df)).collect()]


DATES = [
    ("2020-01-05", D(2020, 1, 5)), ("2020-1-5", D(2020, 1, 5)), ("2020/01/05", D(2020, 1, 5)),
    ("2020-01-05 10:00:00", D(2020, 1, 5)), ("2020-01-05T10:00:00", D(2020, 1, 5)),
    ("20200105", D(2020, 1, 5)), (" 20200105 ", D(2020, 1, 5)), ("05012020", D(2020, 1, 5)),
    ("19122015", D(2015, 12, 19)), ("20012005", D(2005, 1, 20)), ("202001", D(2020, 1, 1)),
    ("010203", None), ("2020", D(2020, 1, 1)), ("1899", None), ("2100", None),
    ("05/01/2020", D(2020, 1, 5)), ("5/1/2020", None), ("05-01-2020", D(2020, 1, 5)),
    ("31022020", None), ("5012020", None), ("20200105.0", None), ("2020-01", None),
    ("today", None), ("2020-01-05 abc", None), ("", None), (None, None), ("2020\n", None),
]


def test_parse_date_golden(spark):
    got = run(spark, [v for v, _ in DATES], lambda c, df: parse_date(c, df.schema[c].dataType))
    assert got == [e for _, e in DATES]


def test_parse_date_typed_columns(spark):
    df = spark.createDataFrame([(D(2020, 1, 5), 20200105, dt.datetime(2020, 1, 5, 10))],
                               "d date, i int, t timestamp")
    row = df.select(*[parse_date(c, df.schema[c].dataType).alias(c) for c in df.columns]).first()
    assert row["d"] == D(2020, 1, 5)
    assert row["i"] == D(2020, 1, 5)  # integers go through their text form
    assert row["t"] == D(2020, 1, 5)


AGES = [("4018", 18.0), ("3006", 0.5), ("2365", 365 / 365.25), ("1012", 12 / 8766), ("0024", 24 / 8766),
        ("5005", 5.0), ("418", 18.0), ("505", 5.0), ("100", 0.0), ("120", 20 / 8766), ("045", 45 / 8766),
        ("45", 45.0), ("7", 7.0), ("999", None), ("6001", None), ("12345", None), ("4018.0", None),
        ("abc", None), ("", None), (None, None)]


def test_age_coded_golden(spark):
    assert run(spark, [v for v, _ in AGES], lambda c, df: age_coded(c)) == [e for _, e in AGES]


def test_age_with_unit_golden(spark):
    rows = [("40", "4", 40.0), ("40", None, 40.0), ("3,5", "3", 3.5 / 12), ("12", "2", 12 / 365.25),
            ("12", "0", 12 / 8766), ("12", "1", 12 / 8766), ("7", "9", 7.0), ("5", "5", 5.0),
            ("abc", "4", None), (None, "4", None)]
    df = spark.createDataFrame([(a, u) for a, u, _ in rows], "a string, u string")
    got = [r[0] for r in df.select(age_with_unit("a", "u")).collect()]
    assert got == [e for _, _, e in rows]


def test_age_direct_and_auto(spark):
    assert run(spark, ["3,5", "1.234,5", "12f", "1e3"], lambda c, df: age_direct(c)) == [3.5, None, None, 1000.0]
    df = spark.createDataFrame([("999",), ("120",), ("3,5",)], "IDADE string")
    got = [r[0] for r in df.select(build_age("IDADE", AGE_MODE_AUTO)).collect()]
    assert got == [999.0, 20 / 8766, 3.5]


SEXES = [("M", "Masculino"), (" m ", "Masculino"), ("1", "Masculino"), ("f", "Feminino"), ("2", "Feminino"),
         ("3", "Feminino"), ("I", "Ignorado/Outro"), ("0", "Ignorado/Outro"), ("9", "Ignorado/Outro"),
         ("ign", "Ignorado/Outro"), ("", "Ignorado/Outro"), (None, "Ignorado/Outro"), ("X", "X"), ("x", "x"),
         ("10", "10"), ("1.0", "1.0")]


def test_sex_golden(spark):
    assert run(spark, [v for v, _ in SEXES], lambda c, df: recode_sex(c)) == [e for _, e in SEXES]


CODES = [("G039", "G039"), ("*G03.9", "G039"), ("A419/G009", "G009"), ("A17.0", "A170"), ("a390", "A390"),
         ("A87", "A87"), ("A87.", "A87"), ("A87.9", "A879"), ("G00X", "G00X"), ("A1701", "A170"),
         ("A170 G009", "A170"), ("G03/A170", "G03"), ("A87G009", "A87G"), ("ZG039", "G039"), ("A17", None),
         ("A39.1", None), ("B99", None), ("", None), (None, None)]


def test_extract_code_golden(spark):
    assert run(spark, [v for v, _ in CODES], lambda c, df: extract_code(c)) == [e for _, e in CODES]


def test_multi_column_code_and_origin(spark):
    df = spark.createDataFrame([("B99", "A87", "G00"), (None, None, "G03.9"), ("x", "y", "z")],
                               "CAUSABAS string, LINHAA string, LINHAII string")
    cols = ["CAUSABAS", "LINHAA", "LINHAII"]
    got = [tuple(r) for r in df.select(extract_code_multi(cols), code_origin(cols)).collect()]
    assert got == [("A87", "LINHAA"), ("G039", "LINHAII"), (None, None)]
    assert extract_code_multi([]) is None and code_origin([]) is None


def test_classification_golden(spark):
    df = spark.createDataFrame([("A170",), ("A879",), (None,)], "c string")
    got = [tuple(r) for r in df.select(code_group(F.col("c")), code_type(F.col("c"))).collect()]
    assert got == [("A170", "A170 — Meningite tuberculosa"), ("A87", "A87 — Meningite viral"),
                   ("Sem CID-10 meningite detectado", "Sem CID-10 meningite detectado")]
    custom = [("Z", "Z", "Z label", "Z*")]
    df2 = spark.createDataFrame([("Z99",), ("A170",)], "c string")
    got2 = [r[0] for r in df2.select(code_group(F.col("c"), custom)).collect()]
    assert got2 == ["Z", "Outro CID capturado"]


def test_clean_text(spark):
    assert run(spark, ["  a ", "", "   ", None, "\tb"], lambda c, df: clean_text(c)) == ["a", None, None, None, "\tb"]


def test_names():
    assert normalize_name("Município") == "MUNICIPIO"
    assert normalize_name(" cod-idade ") == "CODIDADE"
    assert normalize_name("ID_MN_RESI") == "IDMNRESI"
    assert normalize_name("---") == ""
    assert safe_alias("ID_AGRAVO") == "idagravo"
    assert safe_alias("1X") == "c_1x"
    assert safe_alias("--") == "campo"
    assert safe_alias("A" * 80) == "a" * 80
    assert output_names(["ID_AGRAVO", "IDAGRAVO", "id agravo", "--", "?"]) == {
        "ID_AGRAVO": "idagravo", "IDAGRAVO": "idagravo_2", "id agravo": "idagravo_3", "--": "campo", "?": "campo_2"}


def test_candidates():
    assert choose_candidate(["IDADE_DO_PACIENTE"], SIM.age) == "IDADE_DO_PACIENTE"
    assert choose_candidates(["CIDADE", "ID_AGRAVO"], SINAN.codes) == ["ID_AGRAVO", "CIDADE"]
    assert choose_candidate([], SIM.age) is None
    assert choose_candidate(["X"], ()) is None
    # twelve code columns are twelve code columns
    many = [f"CID{i}" for i in range(12)]
    assert choose_candidates(many, SIM.codes + ("CID",)) == many
    # exact match wins over column order; a cap only on request
    assert choose_candidate(["SEXO", "CS_SEXO"], SINAN.sex) == "CS_SEXO"
    assert choose_candidates(["CAUSABAS", "LINHAA", "LINHAII"], SIM.codes, max_items=2) == ["CAUSABAS", "LINHAA"]


def test_detect_roles():
    r = detect_roles(["DT_SIN_PRI", "CS_SEXO", "NU_IDADE_N", "ID_MN_RESI", "EVOLUCAO", "ID_AGRAVO"], SINAN)
    assert (r.date, r.sex, r.age, r.age_unit, r.municipality, r.outcome, r.diagnosis) == (
        "DT_SIN_PRI", "CS_SEXO", "NU_IDADE_N", None, "ID_MN_RESI", "EVOLUCAO", "ID_AGRAVO")
    assert r.codes == ("ID_AGRAVO",) and r.age_mode == AGE_MODE_CODED
    c = detect_roles(["DT_ATEND", "SEXO", "IDADE", "COD_IDADE", "MUNIC_RES", "MODALIDADE", "DIAG_PRINC",
                      "DIAG_SECUN"], CIHA)
    assert c.age_unit == "COD_IDADE" and c.age_mode == AGE_MODE_UNIT
    assert c.codes == ("DIAG_PRINC", "DIAG_SECUN")
    # deaths fall back to birth dates
    assert detect_roles(["DTNASC", "SEXO"], SIM).date == "DTNASC"


def test_rounding_and_labels(spark):
    df = spark.createDataFrame([(1.005,), (0.125,), (2.675,), (-1.005,), (66.66666,)], "x double")
    got = [tuple(r) for r in df.select(round_half_away(F.col("x")), round_half_even(F.col("x"))).collect()]
    assert got[0] == (1.0, 1.0)  # 1.005 is 1.00499.. in binary
    assert got[1] == (0.13, 0.12)
    assert got[4] == (66.67, 66.67)
    df2 = spark.createDataFrame([(0.0,), (120.0,)], "a double")
    assert [r[0] for r in df2.select(band_label(F.col("a"))).collect()] == ["0–4", "120–124"]


def test_joined_code_equals_column_by_column(spark):
    """One regex over the joined texts gives the first column's first match,
    and the column it lies in."""
    values = ["G039", "*G03.9", "A419/G009", "A17.0", "a390 ", "A17", "0", "", None, "B99", "A", "87", "G0", "G00"]
    rng = random.Random(3)
    rows = [tuple(rng.choice(values) for _ in range(9)) for _ in range(3000)]
    cols = list(SIM.codes)
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    one_by_one = F.coalesce(*[extract_code(c) for c in cols])
    origin = F.coalesce(*[F.when(extract_code(c).isNotNull(), F.lit(c)) for c in cols])
    wrong = df.where(~extract_code_multi(cols).eqNullSafe(one_by_one) | ~code_origin(cols).eqNullSafe(origin))
    assert wrong.count() == 0


def test_patterns_that_must_not_be_joined(spark):
    assert joinable(CODE_PATTERN) and not any(map(joinable, ["^(A87)", "(A87)$", "(A.7)", "([^B]87)", r"(\bA87)", "(A)(87)", "A(87)"]))
    df = spark.createDataFrame([("xB1", "B2")], "a string, b string")
    assert df.select(extract_code_multi(["a", "b"], "^(B[0-9])"), code_origin(["a", "b"], "^(B[0-9])")).first()[:] == ("B2", "b")


def test_label_predicate_equals_label(spark):
    labels = [r[2] for r in CODE_RULES] + [NO_CODE_LABEL, OTHER_CODE_LABEL]
    df = spark.createDataFrame([("A170",), ("A87",), ("A879",), ("G00",), ("B99",), ("A8",), (None,)], "c string")
    for some in ([labels[0]], labels[2:5], [NO_CODE_LABEL], [OTHER_CODE_LABEL, labels[1]], labels, ["nowhere"]):
        test = label_predicate(F.col("c"), some, CODE_RULES)
        assert df.where(test.isNull() | (test != code_type(F.col("c")).isin(some))).count() == 0, some
    assert label_predicate(F.col("c"), labels, [("A", "A8", "x", ""), ("B", "A87", "y", "")]) is None  # the first rule decides


def test_names_with_dots_spaces_and_quotes(spark):
    df = spark.createDataFrame([("05/01/2020", " m ", "G03.9")], "`DT.OBITO` string, `SEXO ` string, `CAUSA``BAS` string")
    roles = detect_roles(df.columns, SIM)
    assert (roles.date, roles.sex, roles.codes) == ("DT.OBITO", "SEXO ", ("CAUSA`BAS",))
    row = enriched_rows(recode(df, roles), roles).first()
    assert (row.data_analise, row.sexo_recodificado, row.cid_meningite_detectado, row.coluna_origem_cid) == (
        D(2020, 1, 5), "Masculino", "G039", "CAUSA`BAS")
    assert row.raw_dtobito == "05/01/2020"
