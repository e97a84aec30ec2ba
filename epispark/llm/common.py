"""Helpers shared by the operators of this subpackage: per-worker state,
bounded caches, bounded training samples, scratch tables and connected
components."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import zipfile
from collections import OrderedDict
from itertools import chain
from typing import Any, Callable, Dict, Hashable, Iterable, Iterator, List, Optional, Tuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

_WORKER: "OrderedDict[Hashable, Any]" = OrderedDict()
_WORKER_STATES = 2


def worker_state(key: Hashable, build: Callable[[], Any]) -> Any:
    """One object per Python worker and key. Workers are reused by tasks and by
    later queries, so only the objects used last are kept."""
    if key in _WORKER:
        _WORKER.move_to_end(key)
        return _WORKER[key]
    while len(_WORKER) >= _WORKER_STATES:
        _WORKER.popitem(last=False)
    _WORKER[key] = build()
    return _WORKER[key]


class GenerationCache(dict):
    """``cache[key]`` computes a missing value. Holds at most two generations
    of ``capacity`` entries: a full generation becomes the old one, and keys
    found there move to the new one, so frequent keys stay. Keys are texts;
    one of more than ``longest`` characters is computed each time, so what the
    cache holds is bounded in bytes too."""

    def __init__(self, compute: Callable[[Any], Any], capacity: int = 150_000, longest: int = 64):
        super().__init__()
        self.compute, self.capacity, self.longest, self.old = compute, capacity, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.compute(key)
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.capacity:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_SHIPPED: set = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per application, so
    that tasks can import it wherever the driver found it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, dirs, files in sorted(os.walk(os.path.join(top, __name__.split(".")[0]))):
            dirs.sort()
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.writestr(zipfile.ZipInfo(os.path.relpath(full, top)), open(full, "rb").read())
    name = f"{__name__.split('.')[0]}-{hashlib.sha256(data.getvalue()).hexdigest()[:12]}.zip"
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), name)
    with open(path, "wb") as out:
        out.write(data.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose tasks can import this package."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def texts(column: pa.Array) -> List[str]:
    """Strings of an Arrow column, nulls as empty."""
    return [t or "" for t in column.to_pylist()]


def text_bytes(column: pa.Array) -> Tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an Arrow column, one after the other, and
    the place where each starts, with the end; nulls as empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64, len(column) + 1, 8 * column.offset)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def text_column(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """The Arrow column of texts given as by ``text_bytes``."""
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(data))


def spread(values: np.ndarray, first: np.ndarray, size: np.ndarray, at: np.ndarray) -> Tuple[np.ndarray, np.ndarray]:
    """Item i has the ``size[i]`` values from place ``first[i]`` on: the values
    of the items ``at``, one after the other, and where those of each end."""
    own = size[at]
    last = np.cumsum(own)
    return values[np.repeat(first[at] - (last - own), own) + np.arange(int(last[-1]) if len(last) else 0)], last


def hashed_words(column: pa.Array, letters: bytes, cut: Callable[[str], List[str]], digest: Callable[[str], int]) -> Tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of lowered texts: the hashes of the distinct ones of the column,
    and for each occurrence, text by text, its place among them and its text.

    ``letters`` maps ASCII characters that no word holds to spaces and the
    others, but for bytes of other characters, to lower case; texts are cut at
    those spaces as bytes. Distinct strings are hashed once each, those with
    other characters after ``cut``. A capital sigma's lower case depends on
    what follows it, so texts are lowered beforehand where there is one."""
    data, at = text_bytes(column)
    if b"\xce\xa3" in data.tobytes():
        data, at = text_bytes(pa.array([t.lower() for t in texts(column)], pa.large_string()))
    data = np.frombuffer(data.tobytes().translate(letters), np.uint8)
    starts, ends = word_edges(data != 32, at)
    size = ends - starts
    coded = text_column(data[data != 32], np.concatenate([[0], np.cumsum(size)])).dictionary_encode()
    words = coded.dictionary
    place, row = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), np.diff(np.searchsorted(starts, at)))
    own, edges = text_bytes(words)
    odd = np.unique(np.searchsorted(edges, np.flatnonzero(own > 127), side="right") - 1)
    words = words.to_numpy(zero_copy_only=False).tolist()
    cuts = {}
    for i in odd.tolist():
        found = cut(words[i].lower())
        if len(found) == 1:
            words[i] = found[0]
        else:
            cuts[i] = found
    n = np.array([len(found) for found in cuts.values()], dtype=np.int64)
    hashes = np.fromiter(map(digest, chain(words, *cuts.values())), dtype=np.uint64, count=len(words) + int(n.sum()))
    if cuts:
        odd, first, size = list(cuts), np.arange(len(words)), np.ones(len(words), dtype=np.int64)
        first[odd], size[odd] = len(words) + np.cumsum(n) - n, n
        row = np.repeat(row, size[place])
        place = spread(np.arange(len(hashes)), first, size, place)[0]
    return hashes, place, row


def word_edges(inside: np.ndarray, at: np.ndarray) -> Tuple[np.ndarray, np.ndarray]:
    """Where the runs of ``inside`` begin and end; ``at`` are the places where
    texts start, with the end, which no run goes beyond."""
    rows = at[(at > 0) & (at < len(inside))]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    starts[rows] = inside[rows]
    ends[:-1] &= ~inside[1:]
    ends[rows - 1] = inside[rows - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def slices(batches: Iterable[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what a task builds from one stays bounded."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def runs(batches: Iterable[pa.RecordBatch], keys: List[str]) -> Iterator[tuple]:
    """(key, slice) for each run of equal integer keys within a batch; a run
    that goes on in the next batch comes again with the same key."""
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, dtype=bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.append(np.flatnonzero(change), b.num_rows)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield tuple(int(c[lo]) for c in cols), b.slice(lo, hi - lo)


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: List[str]) -> Iterator[pa.Table]:
    """Whole groups of equal integer keys of sorted batches, one table each."""
    held: List[pa.RecordBatch] = []
    last = None
    for key, part in runs(batches, keys):
        if held and key != last:
            yield pa.Table.from_batches(held)
            held = []
        held.append(part)
        last = key
    if held:
        yield pa.Table.from_batches(held)


def held_out(doc_id: Column) -> Column:
    """The evaluation fold: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) outside the evaluation fold, one row per document."""
    return (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.min(label).alias("label")))


def class_counts(labels: DataFrame, label: str) -> Dict[int, int]:
    """Learnable documents of each class that has any."""
    return {r[0]: r[1] for r in learnable(labels, label).groupBy("label").count().collect()}


def hash_sample(df: DataFrame, key: Column, n: int, total: int, *ties: str) -> DataFrame:
    """The ``n`` rows of ``df`` with the least ``key``, a hash spread over all
    64 bits. Of ``total`` rows only about twice as many as wanted pass the
    first cut, so the last step sees a bounded number of rows whatever the
    number of partitions."""
    share = min(1.0, (2 * n + 200) / max(1, total))
    cut = df if share == 1.0 else df.where(key < int(-2**63 + share * 2**64))
    return cut.orderBy(key, *ties).limit(n)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int) -> DataFrame:
    """(text, label) of at most ``per_class`` labelled documents of each class
    0 and 1, outside the evaluation fold, picked by a hash of the id. The ids
    are at most ``2 * per_class`` rows, hence the broadcast. A document with
    several label rows takes the least label, one with several texts the least."""
    one = learnable(labels, label)
    pick = F.xxhash64(F.col("doc_id"), F.lit(seed))
    counts = class_counts(labels, label)
    ids = None
    for value in (0, 1):
        part = hash_sample(one.where(F.col("label") == value), pick, per_class, counts.get(value, 0), "doc_id")
        ids = part if ids is None else ids.unionByName(part)
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .join(F.broadcast(ids), "doc_id")
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
            .select("doc_id", "text", "label"))


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts the lineage and
    survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: Optional[DataFrame]) -> None:
    """Delete the files of a scratch table nothing reads any more."""
    if df is None:
        return
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (a, b: long) -> (id, component): every id that occurs, with the
    smallest id reachable from it.

    Alternating large-star and small-star steps: each turns the links into
    others with the same components, until every link leads straight to its
    component's least id. Every step is a min per node (pre-aggregated) and a
    join back on the node, which adaptive execution splits where a hub is hot.
    Links between equal ids count as a node without links; nulls are ignored.
    """
    nodes = links.where("a is not null and b is not null")
    edges = saved(nodes.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                  "links")
    loops = nodes.where("a = b").select(F.col("a").alias("id")).distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges)
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node takes the node's least neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        # small star: a node and its smaller neighbours take the least of them
        large = saved(large, "star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        after_edges = saved(small, "links")
        after = state(after_edges)
        forget(large)
        forget(edges)
        edges = after_edges
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    found = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = found.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    return found.unionByName(loops.join(found, "id", "left_anti").select("id", F.col("id").alias("component")))
