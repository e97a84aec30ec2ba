"""Near-duplicate documents by SuperMinHash (operator 8).

Each document is its set of word shingles. Per element a random permutation of
the signature's places is walked step by step; step ``j`` offers ``j`` plus a
random fraction to one place, which keeps its least offer. Offers of later
steps are larger, so the walk stops as soon as no place could still change:
after one or two steps for a large set. Signatures are cut into bands;
documents that share a band are candidates; candidates are confirmed on their
full sets; confirmed links are grouped to components.

Copies (equal sets) are one class, represented by its least id. Each
document and the least member of each of its buckets are joined to clusters
of candidates. The full sets meet in their cluster, in chunks of bounded size;
a document is only held against those that share a band with it and are not
yet in its component, and only the links that join components leave the task.
Pairs are never written out.
"""

from __future__ import annotations

from typing import Iterator, List, Tuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GenerationCache, arrow_map, connected_components, saved, slices, sorted_groups, texts, worker_state

PLACES = 128
FRACTION_BITS = 25
_M1, _M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_STEP, _FOLD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


def _word_hashes() -> GenerationCache:
    return worker_state("word-hashes", lambda: GenerationCache(xxhash.xxh64_intdigest))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``words``-word shingles. A-Z are
    lowered; words are cut at ASCII white space, as ``bytes.split`` does;
    fewer words are one shingle; none give an empty set."""
    tokens = text.encode().lower().split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_word_hashes().__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    k = min(words, len(h))
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        x = np.full(n, k, dtype=np.uint64)
        for j in range(k):
            x = mix(x * np.uint64(_FOLD) + h[j:j + n])
    return np.unique(x)


def super_minhash(sets: List[np.ndarray], places: int = PLACES, budget: int = 1 << 18) -> np.ndarray:
    """uint32 signatures, sets x places: the step in the high bits, the random
    fraction in the low ones. Empty sets get all ones. Sets are walked
    together, at most ``budget`` elements (or one set) at a time."""
    out = np.full((len(sets), places), 0xFFFFFFFF, dtype=np.uint32)
    lo = 0
    while lo < len(sets):
        hi, held = lo, 0
        while hi < len(sets) and (hi == lo or held + len(sets[hi]) <= budget):
            held += len(sets[hi])
            hi += 1
        _walk(sets[lo:hi], out[lo:hi])
        lo = hi
    return out


def _offer(x: np.ndarray, j: int, places: int) -> Tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        u = mix(x + np.uint64((_STEP * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
    k = j + ((u >> np.uint64(32)) * np.uint64(places - j) >> np.uint64(32)).astype(np.int64)
    value = np.uint32(j << FRACTION_BITS) | (u & np.uint64((1 << FRACTION_BITS) - 1)).astype(np.uint32)
    return k, value


def _walk(sets: List[np.ndarray], out: np.ndarray) -> None:
    places = out.shape[1]
    sizes = np.array([len(s) for s in sets])
    x = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    flat = out.reshape(-1)
    k, value = _offer(x, 0, places)
    np.minimum.at(flat, doc * places + k, value)
    open_ = (sizes > 0) & (out.max(axis=1) >> FRACTION_BITS > 0)
    keep = open_[doc]
    if not keep.any():
        return
    x, doc, first = x[keep], doc[keep], k[keep]
    # the walked permutation: place j and the drawn place trade, the drawn one is offered to
    order = np.tile(np.arange(places, dtype=np.uint8), (len(x), 1))
    row = np.arange(len(x))
    order[row, first] = 0
    for j in range(1, places):
        k, value = _offer(x, j, places)
        at = order[row, k].astype(np.int64)
        order[row, k] = order[row, j]
        np.minimum.at(flat, doc * places + at, value)
        alive = (out.max(axis=1) >> FRACTION_BITS > j) & open_
        keep = alive[doc]
        if not keep.any():
            return
        if keep.sum() < 0.7 * len(keep):
            x, doc, order, row = x[keep], doc[keep], order[keep], np.arange(int(keep.sum()))
            open_ = alive


def band_rows(similarity: float, places: int = PLACES, miss: float = 1e-6) -> int:
    """The most rows a band may have for a pair at ``similarity`` to share no
    band with a probability of at most ``miss``."""
    return max([r for r in range(1, places + 1) if (1 - similarity ** r) ** (places // r) <= miss], default=1)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band, the band's number mixed in."""
    n, places = signatures.shape
    bands = places // rows
    with np.errstate(over="ignore"):
        x = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (n, 1))
        cut = signatures[:, :bands * rows].reshape(n, bands, rows).astype(np.uint64)
        for r in range(rows):
            x = mix(x * np.uint64(_FOLD) + cut[:, :, r])
    return x.view(np.int64)


def _long_lists(m: np.ndarray) -> pa.Array:
    offsets = np.arange(len(m) + 1, dtype=np.int32) * (m.shape[1] if len(m) else 0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.reshape(-1), pa.int64()))


def sketches(docs: DataFrame, words: int, rows: int, places: int) -> DataFrame:
    """(doc_id, n, f1, f2, bands): set size, a 128-bit fingerprint of the set
    and its band keys."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            sets = [shingle_set(t, words) for t in texts(b.column(1))]
            with np.errstate(over="ignore"):
                prints = [(mix(s ^ np.uint64(_M2)).sum(dtype=np.uint64), mix(s + np.uint64(_M1)).sum(dtype=np.uint64)) for s in sets]
            keys = band_keys(super_minhash(sets, places), rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 *(pa.array(np.array([p[i] for p in prints], dtype=np.uint64).view(np.int64)) for i in (0, 1)), _long_lists(keys)],
                ["doc_id", "n", "f1", "f2", "bands"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return arrow_map(source, sketch, "doc_id long, n long, f1 long, f2 long, bands array<long>")


def full_sets(docs: DataFrame, words: int, rows: int, places: int) -> DataFrame:
    """(doc_id, elements, keys): the whole set and its band keys, as bytes."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            sets = [shingle_set(t, words) for t in texts(b.column(1))]
            keys = band_keys(super_minhash(sets, places), rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary())],
                ["doc_id", "elements", "keys"])

    return arrow_map(docs, sets_of, "doc_id long, elements binary, keys binary")


def links_between(left: List[int], right: List[int], sets: List[np.ndarray], keys: np.ndarray, percent: int, same: bool):
    """Links that join documents of ``left`` and ``right`` (places in ``sets``,
    the same list where ``same``), as a forest.

    A document is held against the right ones that share a band with it and
    are not yet in its component: its elements are marked in the right side's
    vocabulary and the marks are summed per document, so one pass counts all
    intersections.
    """
    right = np.asarray(right)
    sizes = np.array([len(sets[k]) for k in right])
    ends = np.cumsum(sizes)
    vocabulary, place = np.unique(np.concatenate([sets[k] for k in right]), return_inverse=True)
    marks = np.zeros(len(vocabulary), dtype=np.int32)
    group = np.arange(len(sets))
    found = []
    for at, r in enumerate(left):
        shared = group[right] != group[r]
        if same:
            shared[:at + 1] = False
        shared &= (100 * np.minimum(sizes, len(sets[r])) >= percent * np.maximum(sizes, len(sets[r])))
        some = np.flatnonzero(shared)
        some = some[(keys[right[some]] == keys[r]).any(axis=1)]
        if not len(some):
            continue
        own = np.searchsorted(vocabulary, sets[r])
        own = own[(own < len(vocabulary)) & (vocabulary[np.minimum(own, len(vocabulary) - 1)] == sets[r])]
        marks[own] = 1
        if 4 * len(some) < len(right):
            both = np.array([marks[place[ends[k] - sizes[k]:ends[k]]].sum() for k in some])
        else:
            both = np.add.reduceat(marks[place], ends - sizes)[some]
        marks[own] = 0
        for k in some[100 * both >= percent * (len(sets[r]) + sizes[some] - both)]:
            c = right[k]
            if group[c] != group[r]:
                group[group == group[c]] = group[r]
                found.append((r, int(c)))
    return found


def confirmed(members: DataFrame, percent: int, chunk_bytes: int) -> DataFrame:
    """``members`` (cluster, doc_id, elements, keys) -> links (a, b) with 100 *
    intersection >= percent * union among the documents of a cluster that
    share a band; as many as it takes to join them. A cluster is dealt into
    chunks of about ``chunk_bytes`` of elements, every two chunks meet in one
    group, and a task holds one group."""
    size = members.groupBy("cluster").agg(
        F.ceil(F.sum(F.octet_length("elements")) / chunk_bytes).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("chunks")).cast("int")
    dealt = (members.join(size, "cluster").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id",
                     "elements", "keys"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in sorted_groups(batches, ["cluster", "i", "j"]):
            doc, own = group["doc_id"].to_numpy(), group["own"].to_numpy()
            i, j = group["i"][0].as_py(), group["j"][0].as_py()
            sets = [np.frombuffer(e, np.uint64) for e in group["elements"].to_pylist()]
            keys = np.frombuffer(b"".join(group["keys"].to_pylist()), np.int64).reshape(len(sets), -1)
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            if len(left) and len(right):
                for x, y in links_between(left.tolist(), right.tolist(), sets, keys, percent, i == j):
                    a.append(int(doc[x]))
                    b.append(int(doc[y]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    placed = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "doc_id")
    return arrow_map(placed, compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, places: int = PLACES,
                    chunk_bytes: int = 1 << 24) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Documents are linked when 100 * intersection >= percent * union of their
    distinct ``words``-word shingles; ``component_id`` is the least doc_id
    reachable by links, itself included, and ``kept`` says it is the row's own.
    A pair at the threshold is missed with a probability below one in a
    million. Null and empty texts have no shingles and are linked with
    nothing. Rows with equal doc_id are one document: all of them stay in the
    result, with their own sizes. A null doc_id is linked with nothing, its
    component is null and it is kept. An empty table gives no rows; other
    columns are ignored.
    """
    rows = band_rows(percent / 100, places)
    drawn = saved(sketches(docs, words, rows, places), "sketches")
    known = drawn.where("doc_id is not null and n > 0")
    classes = known.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("head"))
    heads = known.select("doc_id", "f1", "f2", "n", "bands").join(
        classes.select(F.col("head").alias("doc_id"), "f1", "f2", "n"), ["doc_id", "f1", "f2", "n"], "left_semi")
    banded = heads.select("doc_id", F.explode("bands").alias("bucket")).distinct()
    least = banded.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1")
    # a document with its bucket's least member: the clusters of candidates
    star = (banded.join(least, "bucket").where("doc_id <> least")
            .select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct())
    clusters = saved(connected_components(star).select(F.col("id").alias("doc_id"), F.col("component").alias("cluster")), "clusters")

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sets = full_sets(source.join(clusters.select("doc_id"), "doc_id", "left_semi"), words, rows, places)
    members = saved(sets.where(F.octet_length("elements") > 0).join(clusters, "doc_id"), "members")
    found = connected_components(confirmed(members, percent, chunk_bytes))

    head_of = classes.join(found.withColumnRenamed("id", "head"), "head", "left").select(
        "f1", "f2", "n", F.coalesce("component", "head").alias("class_component"))
    return (drawn.select("doc_id", "n", "f1", "f2").join(head_of, ["f1", "f2", "n"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("class_component", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
