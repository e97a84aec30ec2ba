"""Parquet sources: multi-file scan with name-based union (S1/S2), schema
description (S3) and raw preview (S4).

Register extracts change layout from year to year: a column may be INT in
one file and text in the next, or missing. ``layouts`` tells which files have
which layout. Layouts whose common columns have equal types are scanned as one
relation, where Parquet fills missing columns; relations whose types differ
are cast to common types and combined by name. Names match
case-insensitively; the first spelling seen is kept. Each relation is an
ordinary Parquet scan, with column pruning, filter pushdown and partition
columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Dict, Iterable, List, Optional, Sequence, Tuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import named
from .layouts import DataFile, Paths, _escaped, data_files, listed, partition_type, roots

_NUMERIC_RANK = {T.BooleanType: 0.5, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 3, T.LongType: 4,
                 T.FloatType: 5, T.DoubleType: 6}
# digits an integer type can hold, for its union with a decimal
_INTEGER_DIGITS = {T.BooleanType: 1, T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def list_files(spark: SparkSession, paths: Paths) -> List[str]:
    """The data files that paths, globs and folders stand for."""
    found = roots(spark, paths)
    return sorted(r.path for r in listed(spark, found).select("path").collect()) if found else []


def _common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    ra, rb = _NUMERIC_RANK.get(type(a)), _NUMERIC_RANK.get(type(b))
    if ra and rb:
        if {type(a), type(b)} == {T.FloatType, T.LongType}:
            return T.DoubleType()
        return a if ra >= rb else b
    if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
        if isinstance(a, (T.FloatType, T.DoubleType)) or isinstance(b, (T.FloatType, T.DoubleType)):
            return T.DoubleType()
        parts = [(d.precision - d.scale, d.scale) if isinstance(d, T.DecimalType) else (_INTEGER_DIGITS.get(type(d)), 0) for d in (a, b)]
        if all(whole is not None for whole, _ in parts):
            whole, scale = (max(x) for x in zip(*parts))
            return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.DoubleType()
    dt_kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, dt_kinds) and isinstance(b, dt_kinds):
        if isinstance(a, T.TimestampType) or isinstance(b, T.TimestampType):
            return T.TimestampType()
        return T.TimestampNTZType()
    return T.StringType()


def unified_schema(schemas: Iterable[T.StructType]) -> T.StructType:
    """Columns in first-seen order, types promoted pairwise."""
    order: List[str] = []
    names: Dict[str, str] = {}
    types: Dict[str, T.DataType] = {}
    for s in schemas:
        for f in s.fields:
            key = f.name.lower()
            if key not in names:
                names[key] = f.name
                types[key] = f.dataType
                order.append(key)
            else:
                types[key] = _common_type(types[key], f.dataType)
    return T.StructType([T.StructField(names[k], types[k], True) for k in order])


@dataclass
class _Relation:
    """Files of one base folder and its partition keys, whose common columns
    have equal types."""

    base: Optional[str]
    keys: Tuple[str, ...]
    fields: Dict[str, T.StructField] = field(default_factory=dict)
    paths: List[str] = field(default_factory=list)

    def fits(self, schema: T.StructType) -> bool:
        return all(self.fields[f.name.lower()].dataType.simpleString() == f.dataType.simpleString()
                   for f in schema.fields if f.name.lower() in self.fields)

    def add(self, schema: T.StructType) -> None:
        own = {k.lower() for k in self.keys}
        for f in schema.fields:
            if f.name.lower() not in own:
                self.fields.setdefault(f.name.lower(), T.StructField(f.name, f.dataType, True, f.metadata))


def _relations(files: Sequence[DataFile], schemas: Dict[str, T.StructType]) -> List[_Relation]:
    """Files in order, in as few relations as their types allow."""
    out: Dict[tuple, List[_Relation]] = {}
    placed: Dict[tuple, _Relation] = {}
    for f in files:
        group = (f.base, tuple(k for k, _ in f.values))
        if (*group, f.layout) not in placed:
            schema = schemas[f.layout]
            some = out.setdefault(group, [])
            relation = next((r for r in some if r.fits(schema)), None)
            if relation is None:
                relation = _Relation(*group)
                some.append(relation)
            relation.add(schema)
            placed[(*group, f.layout)] = relation
        placed[(*group, f.layout)].paths.append(f.path)
    return [r for some in out.values() for r in some]


def _short_paths(relation: _Relation, folders: Sequence[str], owners: Dict[str, int]) -> List[str]:
    """The relation's files, or the root folder in place of all files below it
    where Spark reads just these from it: no other relation has files there
    and every folder between is a partition folder."""
    rest, whole = list(relation.paths), []
    for folder in folders:
        below = [p for p in rest if p.startswith(folder + "/")]
        if below and owners[folder] == 1 and all("=" in part for p in below for part in p[len(folder) + 1:].split("/")[:-1]):
            whole.append(folder)
            rest = [p for p in rest if not p.startswith(folder + "/")]
    return whole + rest


def row_file() -> Column:
    """The file of a row, spelled as the catalogue spells it."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(path, "^file:/+", "file:/")


def union_schema(files: Sequence[DataFile], schemas: Dict[str, T.StructType]) -> T.StructType:
    """Columns and common types of files, partition keys of each layout after
    its own columns."""
    relations = _relations(files, schemas)
    types = _partition_types(files)
    return unified_schema([T.StructType([*r.fields.values(), *[T.StructField(k, types[k.lower()]) for k in r.keys]]) for r in relations])


def _partition_types(files: Sequence[DataFile]) -> Dict[str, T.DataType]:
    values: Dict[str, List[Optional[str]]] = {}
    for f in files:
        for k, v in f.values:
            values.setdefault(k.lower(), []).append(v)
    return {k: partition_type(v) for k, v in values.items()}


def read_files(spark: SparkSession, files: Sequence[DataFile], schemas: Dict[str, T.StructType], folders: Sequence[str] = (),
               target: Optional[T.StructType] = None, file_column: Optional[str] = None) -> DataFrame:
    """One DataFrame over catalogued files, in the columns and types of
    ``target`` (or of the files alone). ``folders`` may stand for all files
    below them; ``file_column`` adds the file of each row."""
    types = _partition_types(files)
    relations = _relations(files, schemas)
    folders = [p.rstrip("/") for p in folders]
    owners = {folder: sum(any(p.startswith(folder + "/") for p in r.paths) for r in relations) for folder in folders}
    frames = []
    for r in relations:
        partitions = [T.StructField(k, types[k.lower()], True) for k in r.keys]
        reader = spark.read.schema(T.StructType([*r.fields.values(), *partitions]))
        if r.base is not None:
            reader = reader.option("basePath", r.base or "/")
        df = reader.parquet(*map(_escaped, _short_paths(r, folders, owners)))
        frames.append(df.withColumn(file_column, row_file()) if file_column else df)
    if target is None and len(frames) == 1:
        return frames[0]
    target = target or unified_schema([df.schema for df in frames])
    if file_column and file_column not in target.names:
        target = T.StructType([*target.fields, T.StructField(file_column, T.StringType())])
    out = None
    for df in frames:
        have = {f.name.lower(): f.name for f in df.schema.fields}
        part = df.select(*[(named(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name)
                           for f in target.fields])
        out = part if out is None else out.unionByName(part)
    return out


def read_base(spark: SparkSession, paths: Paths) -> Optional[DataFrame]:
    """One DataFrame over all files, columns unioned by name (S1/S2). Returns
    None when nothing matches.

    ``key=value`` folders become columns wherever they lie: below a folder,
    behind a glob, or in a list of partition folders. Their types are unified
    over all roots, and filters on them prune files. A file that is no Parquet
    raises ValueError with its name; one of no bytes has no rows."""
    files, schemas = data_files(spark, paths)
    if not files:
        return None
    return read_files(spark, files, schemas, [p for p, is_folder in roots(spark, paths) if is_folder])


def sql_type_name(dt: T.DataType) -> str:
    """SQL spelling of a Spark type, in the vocabulary of the original
    report (``VARCHAR``, ``BIGINT``, ``TIMESTAMP`` ...)."""
    simple = {
        T.StringType: "VARCHAR", T.BooleanType: "BOOLEAN", T.ByteType: "TINYINT",
        T.ShortType: "SMALLINT", T.IntegerType: "INTEGER", T.LongType: "BIGINT",
        T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.DateType: "DATE",
        T.TimestampNTZType: "TIMESTAMP", T.TimestampType: "TIMESTAMP WITH TIME ZONE",
        T.BinaryType: "BLOB", T.NullType: "NULL",
    }
    if isinstance(dt, T.DecimalType):
        return f"DECIMAL({dt.precision},{dt.scale})"
    for k, v in simple.items():
        if isinstance(dt, k):
            return v
    return dt.simpleString().upper()


def schema_describe(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``coluna, tipo`` for each column, in column order (S3)."""
    rows = [(f.name, sql_type_name(f.dataType)) for f in df.schema.fields]
    return spark.createDataFrame(rows, "coluna string, tipo string")


def preview_rows(df: DataFrame, limit: int = 10, order: Sequence[str] = ()) -> DataFrame:
    """``limit`` raw rows, filters ignored (S4): the first by ``order``, or any."""
    return (df.orderBy(*[named(c) for c in order]) if order else df).limit(int(limit))
