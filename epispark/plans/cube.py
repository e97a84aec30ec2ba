"""A cube of counts that answers the report under any filter.

``digest`` counts the rows of each combination of what the report looks at:
day, sex, age band, municipality, outcome, diagnosis, code and its origin, and
which fields are missing. The dates, ages and codes of the raw text are
parsed once, when a file arrives. The operators (A1 to A13, X1, X2) take a
cube in place of a register: a row counts for the rows it stands for. As
filters test the same columns, a changed filter reads no raw rows; and as
counts add up, cubes of several files lie side by side without being merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.periods import band_start
from .recode import AGE, AGE_UNIT_TEXT, CANONICAL, SEX_TEXT, WEIGHT, counted

#: Stands for ages outside of 0 to 120: not missing, in no band.
NO_BAND = 121.0


def digest(df: DataFrame, *keys: str, width: int = 5) -> DataFrame:
    """The canonical columns of a recoded frame (and ``keys``) with ``ep_n``.

    An age becomes the start of its band of ``width`` years, which is the
    smallest band the cube can be asked for; the texts of sex and age unit,
    of which the report only asks whether they are there, become empty."""
    cols = [c for c in CANONICAL if c in df.columns]
    reduced = {AGE: F.when(F.col(AGE).between(0, 120), band_start(F.col(AGE), width).cast("double")).when(F.col(AGE).isNotNull(), NO_BAND),
               **{c: F.when(F.col(c).isNotNull(), F.lit("")) for c in (SEX_TEXT, AGE_UNIT_TEXT)}}
    rows = df.select(*keys, *[reduced[c].alias(c) if c in reduced else F.col(c) for c in cols])
    return rows.groupBy(*keys, *cols).agg(counted(rows).alias(WEIGHT))
