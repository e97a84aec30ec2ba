"""Incremental consolidation (S6): a yearly table, or a cube of counts, kept
equal to its files.

Extracts arrive as monthly files, and published files are replaced. A manifest
beside the table lists the files that are in it (path, size, time of change).
A run compares it with the files there are, recodes only new and changed
files, and rewrites only the years (or buckets) that these, or the rows they
replace, fall into. The rows tell the file they come from, so what a file gave before is
known from the table itself, also after a run that broke off.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from typing import Callable, Dict, List, Optional, Sequence, Tuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.cube import digest
from ..plans.recode import (
    AGE,
    AGE_UNIT_TEXT,
    CANONICAL,
    CODE,
    CODE_GROUP,
    CODE_ORIGIN,
    CODE_TYPE,
    DATE,
    DIAGNOSIS,
    MUNICIPALITY,
    OUTCOME,
    SEX,
    SEX_TEXT,
    YEAR,
    recode,
)
from ..plans.report import Register
from ..plans.roles import Roles, detect_roles
from ..profiles import PROFILES, SourceProfile
from ..session import scratch_path
from .export import MENINGITIS_GROUPS, territory_cut, with_year, write_years
from .layouts import NULL_FOLDER, DataFile, Paths, data_files, listed, roots
from .parquet import read_base, read_files, union_schema

SOURCE_FILE = "ep_arquivo"
#: Below the table's folder; the underscore hides it from readers of the table.
MANIFEST = "_manifest"


@dataclass(frozen=True)
class Consolidation:
    """What a run did: files taken in, files whose rows went, years (of a
    cube: buckets) rewritten; None stands for rows without a valid date."""

    taken: Tuple[str, ...] = ()
    removed: Tuple[str, ...] = ()
    years: Tuple[Optional[int], ...] = ()


def _folder(spark: SparkSession, path: str):
    hp = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hp, hp.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, out_dir: str) -> list:
    """Numbers of the complete manifests, rising."""
    hp, fs = _folder(spark, f"{out_dir}/{MANIFEST}/version=*/_SUCCESS")
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in fs.globStatus(hp) or [])


def manifest(spark: SparkSession, out_dir: str) -> Optional[DataFrame]:
    """``path, size, modified, settings`` of the files in a table, or None."""
    found = _versions(spark, out_dir)
    return spark.read.parquet(f"{out_dir}/{MANIFEST}/version={found[-1]}") if found else None


@dataclass
class _Pending:
    """What a table lacks: its settings, the files there are, changed and gone ones."""

    files: List[DataFile]
    schemas: Dict[str, T.StructType]
    schema: T.StructType
    roles: Roles
    now: DataFrame
    table: Optional[DataFrame]
    changed: List[str]
    removed: List[str]

    def rows(self, spark: SparkSession) -> Optional[DataFrame]:
        """The raw rows of changed files in the columns of all files."""
        some = set(self.changed)
        return read_files(spark, [f for f in self.files if f.path in some], self.schemas, target=self.schema, file_column=SOURCE_FILE) if some else None


def _pending(spark: SparkSession, paths: Paths, out_dir: str, profile: SourceProfile, roles: Optional[Roles], options: list) -> Optional[_Pending]:
    """None where the manifest agrees with the files."""
    found = roots(spark, paths)
    before = manifest(spark, out_dir)
    files, schemas = data_files(spark, paths) if found else ([], {})
    schema = union_schema(files, schemas)
    roles = roles or detect_roles(schema.names, profile)
    settings = json.dumps([asdict(roles), *options])
    now = (listed(spark, found) if found else spark.createDataFrame([], "path string, size long, modified timestamp"))
    now = now.withColumn("settings", F.lit(settings))
    table = read_base(spark, out_dir)
    if table is not None and SOURCE_FILE not in table.columns:
        raise ValueError(f"{out_dir} holds rows that do not tell their files")
    if before is None:  # a table all the same: what a broken first run left
        changed = [f.path for f in files]
        had = table.select(F.col(SOURCE_FILE).alias("path")).distinct() if table is not None else now.select("path")
        removed = [r.path for r in had.join(now, "path", "left_anti").collect()]
    else:
        keys = ["path", "size", "modified", "settings"]
        changed = [r.path for r in now.join(before, keys, "left_anti").select("path").collect()]
        removed = [r.path for r in before.join(now, "path", "left_anti").select("path").collect()]
    if not changed and not removed:
        return None
    return _Pending(files, schemas, schema, roles, now, table, changed, removed)


def _taken_in(spark: SparkSession, out_dir: str, p: _Pending, new: Optional[DataFrame], key: str,
              write: Callable[[DataFrame], None]) -> Consolidation:
    """Replace the rows of changed and gone files by ``new`` ones, rewriting
    only the partitions (values of ``key``) that either fall into."""
    stale = spark.createDataFrame([(f,) for f in {*p.changed, *p.removed}], f"{SOURCE_FILE} string")

    def values(df: DataFrame) -> set:
        return {r[0] for r in df.select(key).distinct().collect()}

    parts, touched = [], set()
    if p.table is not None:
        touched |= values(p.table.join(stale, SOURCE_FILE, "left_semi"))
    if new is not None:
        scratch = scratch_path(spark, "new-rows")
        new.write.parquet(scratch)
        parts.append(spark.read.parquet(scratch))
        touched |= values(parts[0])
    if p.table is not None and touched:
        known = [v for v in touched if v is not None]
        there = (F.col(key).isin(known) if known else F.lit(False)) | (F.col(key).isNull() if None in touched else F.lit(False))
        parts.append(p.table.where(there).join(stale, SOURCE_FILE, "left_anti"))
    if touched:
        rows = parts[0] if len(parts) == 1 else _united(parts)
        # these partitions are read from the table they replace: written apart first
        scratch = scratch_path(spark, "partitions")
        rows.write.parquet(scratch)
        rows = spark.read.parquet(scratch)
        write(rows)
        for gone in touched - values(rows):
            hp, fs = _folder(spark, f"{out_dir}/{key}={NULL_FOLDER if gone is None else gone}")
            fs.delete(hp, True)
    versions = _versions(spark, out_dir)
    p.now.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/{MANIFEST}/version={(versions or [0])[-1] + 1}")
    for old in versions[:-1]:
        hp, fs = _folder(spark, f"{out_dir}/{MANIFEST}/version={old}")
        fs.delete(hp, True)
    return Consolidation(tuple(sorted(p.changed)), tuple(sorted(p.removed)), tuple(sorted(touched, key=lambda y: (y is None, y))))


def consolidate_files(spark: SparkSession, paths: Paths, out_dir: str, profile: SourceProfile | str,
                      groups: Sequence[str] = MENINGITIS_GROUPS, territory: Optional[str] = None,
                      roles: Optional[Roles] = None) -> Consolidation:
    """Bring the table at ``out_dir`` up to date with the files that ``paths``
    name: the rows whose code is in ``groups`` (and in the territory), with
    all raw columns, the canonical ones, ``ano`` and the file of each row.

    The result equals consolidating all files anew. A run without changes
    writes nothing. Files that are gone take their rows along. A change of
    profile, groups or territory, or of the columns detected for the roles
    over all files, takes in every file again. A run that breaks off leaves
    whole years, old or new, and the next run repeats its work; two runs at
    the same time on one table are not meant."""
    profile = PROFILES[profile] if isinstance(profile, str) else profile
    p = _pending(spark, paths, out_dir, profile, roles, [sorted(groups), territory])
    if p is None:
        return Consolidation()
    new = p.rows(spark)
    if new is not None:
        kept = recode(new, p.roles, keep_all=True).where(F.col(CODE_GROUP).isin(list(groups)))
        new = with_year(territory_cut(kept, territory))
    return _taken_in(spark, out_dir, p, new, YEAR, lambda rows: write_years(rows, out_dir, only_years=True, indexed=[SOURCE_FILE]))


#: Folders of a cube: a replaced file rewrites the one that holds its counts.
BUCKET, BUCKETS = "ep_lote", 64


def update_cube(spark: SparkSession, paths: Paths, cube_dir: str, profile: SourceProfile | str, roles: Optional[Roles] = None) -> Consolidation:
    """Bring the cube at ``cube_dir`` up to date with the files: the counts of
    ``plans.cube.digest``, kept per file. Counts add up, so a new file's are
    added and a replaced file's take the place of those it had; its bucket is
    rewritten, other files are not read again. Runs as ``consolidate_files``."""
    profile = PROFILES[profile] if isinstance(profile, str) else profile
    p = _pending(spark, paths, cube_dir, profile, roles, [])
    if p is None:
        return Consolidation()
    new = p.rows(spark)
    if new is not None:
        rec = recode(new, p.roles, keep_all=True).select(SOURCE_FILE, *[c for c in CANONICAL if c in _canonical(p.roles)])
        new = digest(rec, SOURCE_FILE).withColumn(BUCKET, F.pmod(F.xxhash64(SOURCE_FILE), F.lit(BUCKETS)).cast("int"))

    def write(rows: DataFrame) -> None:
        (rows.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, SOURCE_FILE).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(cube_dir))

    return _taken_in(spark, cube_dir, p, new, BUCKET, write)


def _canonical(roles: Roles) -> set:
    given = {DATE: roles.date, SEX: roles.sex, SEX_TEXT: roles.sex, AGE: roles.age, AGE_UNIT_TEXT: roles.age_unit, MUNICIPALITY: roles.municipality,
             OUTCOME: roles.outcome, DIAGNOSIS: roles.diagnosis, **dict.fromkeys((CODE, CODE_GROUP, CODE_TYPE, CODE_ORIGIN), roles.codes)}
    return {c for c, role in given.items() if role}


def open_cube(spark: SparkSession, cube_dir: str, profile: SourceProfile | str) -> Optional[Register]:
    """A register over a cube: every aggregate of the report, under any
    filter, from the counts alone. None without a cube."""
    table, kept = read_base(spark, cube_dir), manifest(spark, cube_dir)
    if table is None or kept is None:
        return None
    roles = json.loads(kept.select("settings").first()[0])[0]
    cube = table.drop(BUCKET, SOURCE_FILE)
    return Register(profile if isinstance(profile, str) else profile.name, cube, Roles(**{**roles, "codes": tuple(roles["codes"])}), cube)


def _united(parts: Sequence[DataFrame]) -> DataFrame:
    """New rows beside kept ones, whose columns and types may be from before a
    change of layout: the new rows' types where both have a column."""
    new, old = parts
    have = {c.lower(): c for c in new.columns}
    old = old.select(*[F.col(f"`{f.name}`").cast(new.schema[have[f.name.lower()]].dataType).alias(have[f.name.lower()])
                       if f.name.lower() in have else F.col(f"`{f.name}`") for f in old.schema.fields])
    return new.unionByName(old, allowMissingColumns=True)
