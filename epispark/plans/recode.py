"""Recode a register into canonical columns, and the analysis filter (F1).

``recode`` adds one Column expression per configured role; nothing is
evaluated here. Canonical names carry an ``ep_`` prefix so they never
collide (case-insensitively) with raw register columns such as ``SEXO``.
A role that is not configured has no canonical column; operators test for
the column's presence.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Mapping, Optional, Sequence, Tuple, Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ages import build_age
from ..functions.codes import (
    as_code,
    code_group,
    code_origin,
    code_type,
    extract_code_multi,
    found_code,
    joinable,
    joined_codes,
    label_predicate,
    origin_of,
)
from ..functions.dates import parse_date
from ..functions.sex import recode_sex
from ..functions.text import Cleaned, Source, clean_text, named
from ..profiles import CODE_PATTERN, CODE_RULES
from .roles import Roles

DATE = "ep_data"
SEX = "ep_sexo"
SEX_TEXT = "ep_sexo_txt"
AGE = "ep_idade"
AGE_UNIT_TEXT = "ep_unidade_txt"
MUNICIPALITY = "ep_municipio"
OUTCOME = "ep_desfecho"
DIAGNOSIS = "ep_diagnostico"
CODE = "ep_cid"
CODE_GROUP = "ep_cid_grupo"
CODE_TYPE = "ep_cid_tipo"
CODE_ORIGIN = "ep_cid_origem"
YEAR = "ano"  # partition column of a consolidated register
#: Key in the metadata of the date column, kept in the Parquet footers of a
#: consolidated register: names the column that holds the date's own year.
YEAR_MARK = "year_column"
#: How many rows a row of a cube stands for (see ``plans.cube``).
WEIGHT = "ep_n"
CANONICAL = (DATE, SEX, SEX_TEXT, AGE, AGE_UNIT_TEXT, MUNICIPALITY, OUTCOME, DIAGNOSIS,
             CODE, CODE_GROUP, CODE_TYPE, CODE_ORIGIN)


def counted(df: DataFrame, column: Optional[str] = None) -> Column:
    """An aggregate: the rows of a register, or those where ``column`` is not
    null. A row of a cube counts for all rows it stands for."""
    if WEIGHT not in df.columns:
        return F.count(F.lit(1) if column is None else column)
    weight = F.col(WEIGHT) if column is None else F.when(F.col(column).isNotNull(), F.col(WEIGHT))
    return F.coalesce(F.sum(weight), F.lit(0).cast("long"))


def canonical_columns(df: DataFrame, roles: Roles, rules=CODE_RULES, pattern: str = CODE_PATTERN,
                      sources: Mapping[str, Source] = MappingProxyType({})) -> dict:
    """name -> Column for every configured role. ``sources`` gives role columns
    whose text an earlier projection has cleaned."""
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    of = lambda c: sources.get(c, c)
    out = {}
    if roles.date:
        out[DATE] = parse_date(of(roles.date), dtypes.get(roles.date))
    if roles.sex:
        out[SEX] = recode_sex(of(roles.sex))
        out[SEX_TEXT] = clean_text(of(roles.sex))
    age = build_age(roles.age, roles.age_mode, roles.age_unit, sources)
    if age is not None:
        out[AGE] = age
    if roles.age_unit:
        out[AGE_UNIT_TEXT] = clean_text(of(roles.age_unit))
    if roles.municipality:
        out[MUNICIPALITY] = clean_text(of(roles.municipality))
    if roles.outcome:
        out[OUTCOME] = clean_text(of(roles.outcome))
    if roles.diagnosis:
        out[DIAGNOSIS] = clean_text(of(roles.diagnosis))
    code = extract_code_multi(roles.codes, pattern)
    if code is not None:
        out[CODE] = code
        out[CODE_GROUP] = code_group(F.col(CODE), rules)
        out[CODE_TYPE] = code_type(F.col(CODE), rules)
        out[CODE_ORIGIN] = code_origin(roles.codes, pattern)
    return out


def rules_of(df: DataFrame):
    """The classification rules a recoded frame carries in the metadata of its
    label column, so that later steps can work on the code alone."""
    if CODE_TYPE not in df.columns or CODE not in df.columns:
        return None
    kept = df.schema[CODE_TYPE].metadata.get("rules")
    return tuple(tuple(r) for r in json.loads(kept)) if kept else None


def recode(df: DataFrame, roles: Roles, rules=CODE_RULES, pattern: str = CODE_PATTERN,
           keep_raw: bool = True, keep_all: bool = False) -> DataFrame:
    """Raw columns (those with a role, or every one with ``keep_all``) plus
    the canonical columns.

    Codes are found in stages, so that one regex runs once per row: the texts
    of all code columns are joined, the leftmost match is taken from them, and
    code, origin, group and label are derived from the match. Texts are
    cleaned in a stage of their own for the same reason. Catalyst does not
    collapse the stages where a value is used more than once.
    """
    once = dict.fromkeys(c for c in (roles.date, roles.sex, roles.age, roles.age_unit) if c)
    sources = {c: Cleaned(named(c), F.col(f"_texto_{i}")) for i, c in enumerate(once)}
    cols = canonical_columns(df, roles, rules, pattern, sources)
    df = df.select("*", *[clean_text(c).alias(f"_texto_{i}") for i, c in enumerate(once)])
    later = (CODE, CODE_GROUP, CODE_TYPE, CODE_ORIGIN)
    first = {k: v for k, v in cols.items() if k not in later}
    raw = [named(c) for c in (df.columns[:len(df.columns) - len(once)] if keep_all else roles.raw_columns() if keep_raw else ())]
    codes = [c for c in roles.codes if c]
    if not codes:
        return df.select(*raw, *[v.alias(k) for k, v in first.items()])
    staged = {}
    if len(codes) > 1 and joinable(pattern):
        staged = {"_textos": joined_codes(codes)}
    out = df.select(*raw, *[v.alias(k) for k, v in first.items()], *[v.alias(k) for k, v in staged.items()],
                    *([] if staged else [cols[CODE].alias(CODE), cols[CODE_ORIGIN].alias(CODE_ORIGIN)]))
    if staged:
        out = out.withColumn("_achado", found_code(F.col("_textos"), pattern))
        out = out.withColumns({CODE: as_code(F.col("_achado")),
                               CODE_ORIGIN: origin_of(F.col("_textos"), F.col("_achado"), codes)}).drop("_textos", "_achado")
    kept = {"rules": json.dumps([list(r) for r in rules])}
    return out.withColumn(CODE_GROUP, cols[CODE_GROUP]).select("*", cols[CODE_TYPE].alias(CODE_TYPE, metadata=kept))


@dataclass(frozen=True)
class Filters:
    """Conjunctive analysis filter. ``years``: ``"bounds"`` (default, the
    full range of valid years — drops rows without a valid date as soon
    as one exists), ``None`` (no year predicate) or ``(first, last)``.
    Empty lists add no predicate."""

    years: Union[str, Tuple[int, int], None] = "bounds"
    sexo: Sequence[str] = field(default_factory=tuple)
    municipio: Sequence[str] = field(default_factory=tuple)
    desfecho: Sequence[str] = field(default_factory=tuple)
    tipo: Sequence[str] = field(default_factory=tuple)


DEFAULT_FILTERS = Filters()


def year_predicate(df: DataFrame, years, has_valid: Optional[bool] = None) -> Optional[Column]:
    """``has_valid`` — whether the register has any valid date, when the
    caller already knows it (a ``Register`` asks once); unknown -> a lazy
    uncorrelated EXISTS that Spark runs as a ``LIMIT 1`` scalar subquery."""
    if DATE not in df.columns or years is None:
        return None
    if years == "bounds":
        # year(d) BETWEEN min(year) AND max(year) holds for every valid d, so
        # the bounds never need computing: keep valid dates, or everything
        # when the register has none.
        if has_valid is True:
            return F.col(DATE).isNotNull()
        if has_valid is False:
            return None
        any_valid = df.select(DATE).where(F.col(DATE).isNotNull()).exists()
        return F.col(DATE).isNotNull() | ~any_valid
    lo, hi = years
    inside = F.year(F.col(DATE)).between(int(lo), int(hi))
    # a consolidated register is partitioned by year: prune its folders too; a
    # register's own column of that name may hold another year
    year = df.schema[DATE].metadata.get(YEAR_MARK)
    return F.col(year).between(int(lo), int(hi)) & inside if year in df.columns else inside


def has_valid_date(df: DataFrame) -> bool:
    """One ``LIMIT 1`` probe: Spark scans partitions incrementally and stops
    at the first valid date."""
    if DATE not in df.columns:
        return False
    return len(df.select(DATE).where(F.col(DATE).isNotNull()).limit(1).take(1)) > 0


def filter_predicates(df: DataFrame, filters: Filters = DEFAULT_FILTERS,
                      has_valid: Optional[bool] = None) -> list:
    # Cheapest first: Spark evaluates the conjunction in this order and
    # stops at the first false, and Catalyst does not reorder by cost.
    # Trimmed-text lists, then the sex recode, then the date parse, then
    # the code (a regex over the texts of all code columns).
    def isin(col, values):
        return F.col(col).isin(list(values)) if values and col in df.columns else None

    # A label is a function of the code: one test of the code does.
    rules = rules_of(df)
    label = label_predicate(F.col(CODE), filters.tipo, rules) if filters.tipo and rules else None
    preds = [isin(MUNICIPALITY, filters.municipio), isin(OUTCOME, filters.desfecho), isin(SEX, filters.sexo),
             year_predicate(df, filters.years, has_valid), isin(CODE_TYPE, filters.tipo) if label is None else label]
    return [p for p in preds if p is not None]


def filter_predicate(df: DataFrame, filters: Filters = DEFAULT_FILTERS,
                     has_valid: Optional[bool] = None) -> Column:
    """The whole filter as one boolean column (NULL counts as false)."""
    out = F.lit(True)
    for p in filter_predicates(df, filters, has_valid):
        out = out & F.coalesce(p, F.lit(False))
    return out


def apply_filters(df: DataFrame, filters: Filters = DEFAULT_FILTERS,
                  has_valid: Optional[bool] = None) -> DataFrame:
    for p in filter_predicates(df, filters, has_valid):
        df = df.where(p)
    return df
