"""Sex recode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profiles import SEX_CODES, SEX_OTHER
from .text import Source, clean_text


def recode_sex(c: Source) -> Column:
    """Known codes -> label; unknown text passes through trimmed (original
    case); NULL/blank -> ``Ignorado/Outro``."""
    txt = clean_text(c)
    upper = F.upper(txt)
    expr = None
    for code, label in SEX_CODES:
        expr = (F.when if expr is None else expr.when)(upper == code, F.lit(label))
    return expr.otherwise(F.coalesce(txt, F.lit(SEX_OTHER)))
