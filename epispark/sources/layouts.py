"""Catalogue of Parquet files: which files there are, the layout of each, and
the ``key=value`` folders they lie in.

The files are listed by Spark's own file index. Their footers are read by the
tasks of one job, whatever the number of files; a footer is a few kilobytes at
the end of a file. A store that Python on the executors cannot open is read
through Hadoop by threads of the driver instead. Files of one layout share a
fingerprint, and the schema of a layout is taken from one of its files.
"""

from __future__ import annotations

import hashlib
import json
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Dict, Iterator, List, Optional, Sequence, Tuple, Union
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Paths = Union[str, Sequence[str]]
#: Where Spark keeps its own schema in a footer; the folder of a
#: null partition value.
SPARK_SCHEMA = "org.apache.spark.sql.parquet.row.metadata"
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
CATALOGUE = "path string, size long, modified timestamp, layout string, spark_schema string, error string"
#: Tasks that read footers, at most.
FOOTER_TASKS = 4096


def hidden(name: str) -> bool:
    return name.startswith(("_", ".")) and "=" not in name


def roots(spark: SparkSession, paths: Paths) -> List[Tuple[str, bool]]:
    """(path, is a folder) of everything the paths and globs name on any
    Hadoop filesystem, sorted like a glob; what a wildcard hits in a hidden
    name is left out. A blank path names nothing."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out: Dict[str, bool] = {}
    for p in [paths] if isinstance(paths, str) else paths:
        if p and p.strip():
            hp = jvm.org.apache.hadoop.fs.Path(p.strip())
            asked = hp.toString().split("/")[::-1]
            for st in hp.getFileSystem(conf).globStatus(hp) or []:
                path = st.getPath().toString()
                parts = list(zip(asked, path.split("/")[::-1]))
                if not hidden(parts[0][1]) and not any(hidden(found) and re.search(r"[*?\[{]", mark) for mark, found in parts):
                    out[path] = st.isDirectory()
    return sorted(out.items())


def _escaped(path: str) -> str:
    """A path whose characters are not read as a glob."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def listed(spark: SparkSession, found: Sequence[Tuple[str, bool]]) -> DataFrame:
    """``path, size, modified`` of the data files of roots, each once also
    where one root lies in another; hidden parts are left out."""
    folders = {p for p, is_folder in found if is_folder}

    def inside(path: str) -> bool:
        parts = path.split("/")
        return any("/".join(parts[:i]) in folders for i in range(1, len(parts)))

    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load([_escaped(p) for p, _ in found if not inside(p)])
            .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")))


def _fingerprint(schema: str, spark_schema: Optional[str]) -> str:
    return hashlib.md5(f"{schema}\n{spark_schema}".encode()).hexdigest()


def _opened(path: str):
    from pyarrow import fs

    if re.match("file:/|/", path):
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/+", "/", path))
    scheme, rest = path.split(":", 1)
    where, inner = fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + quote(rest))
    return where.open_input_file(inner)


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq

    for b in batches:
        rows = []
        for path in b.column(0).to_pylist():
            try:
                with _opened(path) as f:
                    meta = pq.ParquetFile(f).metadata
                own = (meta.metadata or {}).get(SPARK_SCHEMA.encode(), b"").decode() or None
                rows.append((_fingerprint(str(meta.schema).split("\n", 1)[1], own), own, None))
            except Exception as e:  # told per file: read again through Hadoop, and named if that fails too
                rows.append((None, None, f"{type(e).__name__}: {e}"[:300]))
        columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), *columns],
                                         names=["path", "size", "modified", "layout", "spark_schema", "error"])


def catalogue(spark: SparkSession, paths: Paths) -> Optional[DataFrame]:
    """A row per data file that paths, globs and folders stand for: ``path,
    size, modified, layout, spark_schema, error``. Files of equal ``layout`` have
    the same schema in their footers; a file whose footer the task could not
    read has ``error`` instead. None when nothing matches."""
    found = roots(spark, paths)
    if not found:
        return None
    return listed(spark, found).coalesce(FOOTER_TASKS).mapInArrow(_footers, CATALOGUE)


def _hadoop_footer(spark: SparkSession, path: str) -> Tuple[str, Optional[str]]:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
        jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf))
    try:
        meta = reader.getFooter().getFileMetaData()
        own = meta.getKeyValueMetaData().get(SPARK_SCHEMA)
        return _fingerprint(meta.getSchema().toString(), own), own
    finally:
        reader.close()


@dataclass(frozen=True)
class DataFile:
    """A file, its layout, and the partition folders above it: ``base`` is the
    folder that the first ``key=value`` part lies in, None without such parts."""

    path: str
    layout: str
    base: Optional[str]
    values: Tuple[Tuple[str, Optional[str]], ...]


def partition_values(path: str) -> Tuple[Optional[str], Tuple[Tuple[str, Optional[str]], ...]]:
    """(base, ((key, value), ...)) of a file path, from its first ``key=value``
    folder on down; a null folder is None."""
    parts = path.split("/")
    first = next((i for i, p in enumerate(parts[:-1]) if re.match("[^=]+=", p)), None)
    if first is None:
        return None, ()
    pairs = [p.split("=", 1) for p in parts[first:-1] if "=" in p]
    return "/".join(parts[:first]), tuple((unquote(k), None if v == NULL_FOLDER else unquote(v)) for k, v in pairs)


def partition_type(values: Sequence[Optional[str]]) -> T.DataType:
    """One type for all values of a key, over all roots."""
    known = [v for v in values if v is not None]
    if known and all(re.fullmatch(r"[+-]?[0-9]{1,18}", v) for v in known):
        return T.IntegerType() if all(abs(int(v)) < 1 << 31 for v in known) else T.LongType()
    if known and all(re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", v) for v in known):
        return T.DoubleType()
    if known and all(re.fullmatch(r"[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])", v) for v in known):
        return T.DateType()
    return T.StringType()


def data_files(spark: SparkSession, paths: Paths) -> Tuple[List[DataFile], Dict[str, T.StructType]]:
    """(files sorted by path, schema of each layout). One job reads the
    footers; a layout that Spark did not write takes one more, for one of its
    files. Raises ValueError naming the files that are no readable Parquet."""
    table = catalogue(spark, paths)
    rows = sorted(table.drop("size", "modified").collect()) if table is not None else []
    unread = [r.path for r in rows if r.error]
    again, bad = {}, []

    def footer(path):
        try:
            return path, _hadoop_footer(spark, path), None
        except Exception as e:  # any error of the store or the format, told with the file's name
            return path, None, getattr(getattr(e, "java_exception", None), "toString", e.__str__)()

    if unread:
        with ThreadPoolExecutor(16) as pool:
            for path, found, error in pool.map(footer, unread):
                if error is None:
                    again[path] = found
                else:
                    bad.append(f"{path} ({error.splitlines()[0][:200]})")
    if bad:
        raise ValueError(f"not readable as Parquet: {'; '.join(bad[:20])}" + (f" and {len(bad) - 20} more" if len(bad) > 20 else ""))
    files, schemas = [], {}
    for r in rows:
        layout, own = again.get(r.path) or (r.layout, r.spark_schema)
        files.append(DataFile(r.path, layout, *partition_values(r.path)))
        if layout not in schemas:
            schemas[layout] = T.StructType.fromJson(json.loads(own)) if own else spark.read.parquet(_escaped(r.path)).schema
    return files, schemas
