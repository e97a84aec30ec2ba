"""ICD-10 code extraction and classification."""

from __future__ import annotations

import re
from typing import Optional, Sequence, Tuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profiles import CODE_PATTERN, CODE_RULES, NO_CODE_LABEL, OTHER_CODE_LABEL
from .text import Source, clean_text

Rule = Tuple[str, str, str, str]


def extract_code(c: Source, pattern: str = CODE_PATTERN) -> Column:
    """First match of the code pattern anywhere in the upper-cased text,
    dots removed; no match -> NULL."""
    found = F.regexp_extract(F.upper(clean_text(c)), pattern, 1)
    return F.nullif(F.regexp_replace(found, r"\.", ""), F.lit(""))


SEPARATOR = "\u0001"  # between the texts of several columns; no code holds it


def joinable(pattern: str) -> bool:
    """Whether no match can depend on, or reach over, a text's ends: one group
    around everything, no anchors, look-arounds, free dots or negations."""
    whole = pattern.startswith("(") and pattern.endswith(")") and pattern.count("(") == 1
    return whole and not re.search(r"\(\?|\[\^|[$^]|\\[^.]|(?<![\[\\])\.", pattern)


def joined_codes(cols: Sequence[Source]) -> Column:
    """The upper-cased texts of all columns as one, in priority order."""
    return F.concat_ws(SEPARATOR, *[F.coalesce(F.upper(clean_text(c)), F.lit("")) for c in cols])


def found_code(joined: Column, pattern: str = CODE_PATTERN) -> Column:
    """The leftmost match in the joined texts as it stands there, or blank:
    the first column's first match."""
    return F.regexp_extract(joined, pattern, 1)


def as_code(found: Column) -> Column:
    return F.nullif(F.replace(found, F.lit("."), F.lit("")), F.lit(""))


def origin_of(joined: Column, found: Column, cols: Sequence[str]) -> Column:
    """The column a match lies in, by the separators before it."""
    before = F.substring(joined, F.lit(1), F.instr(joined, found) - 1)
    place = F.length(before) - F.length(F.replace(before, F.lit(SEPARATOR), F.lit("")))
    return F.when(found != "", F.element_at(F.array(*[F.lit(c) for c in cols]), place + 1))


def extract_code_multi(cols: Sequence[str], pattern: str = CODE_PATTERN) -> Optional[Column]:
    """First column, in priority order, that yields a code."""
    names = [c for c in cols if c]
    if not names:
        return None
    if len(names) > 1 and joinable(pattern):
        return as_code(found_code(joined_codes(names), pattern))
    exprs = [extract_code(c, pattern) for c in names]
    return exprs[0] if len(exprs) == 1 else F.coalesce(*exprs)


def code_origin(cols: Sequence[str], pattern: str = CODE_PATTERN) -> Optional[Column]:
    """Name of the column that supplied the code."""
    names = [c for c in cols if c]
    if not names:
        return None
    if len(names) > 1 and joinable(pattern):
        joined = joined_codes(names)
        at = F.regexp_instr(joined, F.lit(pattern))
        before = F.substring(joined, F.lit(1), at - 1)
        # no condition around the place: what is always evaluated is evaluated once
        place = F.length(before) - F.length(F.replace(before, F.lit(SEPARATOR), F.lit("")))
        return F.get(F.array(*[F.lit(c) for c in names]), place - F.when(at == 0, 1).otherwise(0))
    return F.coalesce(*[F.when(extract_code(c, pattern).isNotNull(), F.lit(c)) for c in names])


def _by_prefix(code: Column, rules: Sequence[Rule], pick: int) -> Column:
    expr = F.when(code.isNull(), F.lit(NO_CODE_LABEL))
    for rule in rules:
        expr = expr.when(code.startswith(rule[1]), F.lit(rule[pick]))
    return expr.otherwise(F.lit(OTHER_CODE_LABEL))


def code_group(code: Column, rules: Sequence[Rule] = CODE_RULES) -> Column:
    """Code -> rule group."""
    return _by_prefix(code, rules, 0)


def code_type(code: Column, rules: Sequence[Rule] = CODE_RULES) -> Column:
    """Code -> long label."""
    return _by_prefix(code, rules, 2)


def label_predicate(code: Column, labels: Sequence[str], rules: Sequence[Rule]) -> Optional[Column]:
    """Codes whose label is one of ``labels`` as a single test of the code, or
    None where prefixes overlap, as then the first rule decides."""
    prefixes = [r[1] for r in rules]
    if any(a != b and a.startswith(b) for a in prefixes for b in prefixes) or len(set(prefixes)) < len(prefixes):
        return None
    any_of = lambda some: "^(?:" + "|".join(re.escape(p) for p in some) + ")"
    chosen = [r[1] for r in rules if r[2] in labels]
    tests = [code.rlike(any_of(chosen))] if chosen else []
    if OTHER_CODE_LABEL in labels:
        tests.append(~code.rlike(any_of(prefixes)))
    if NO_CODE_LABEL in labels:
        tests.append(code.isNull())
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out
