"""Near-duplicate vectors by product quantisation (operator 4).

Unit vectors are put into the inverted list of their nearest coarse centre;
the residual is coded by one of 256 centres in each of eight subspaces, and
the length of what the code loses is kept. A vector probes every list that
could hold a neighbour: one whose cell's bisector lies within the link radius.
In a list, distances to the codes come from a table per probe (asymmetric);
codes farther away than the radius plus their loss are skipped; the others are
decided by the exact cosine in double precision. Both tests are bounds of the
triangle inequality, so no link is lost to the index.

Equal vectors of a label are one class with a multiplicity. Lists longer than
``piece`` are dealt into pieces, each a group of its own that the probes
visit, so no task holds an unbounded list; probes are streamed past it. Links
inside a piece leave the task as a forest and as counts, never as all pairs.
"""

from __future__ import annotations

from typing import Dict, Iterator, List, Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import arrow_map, connected_components, hash_sample, runs, saved, slices

SUBSPACES, CODES = 8, 256
Model = Dict[int, Tuple[np.ndarray, List[np.ndarray]]]  # by dimension: centres, code books


def unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(axis=1))[:, None]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (((centres * centres).sum(1)[None, :]) - 2 * x @ centres.T).argmin(axis=1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        size = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def _cuts(dim: int) -> List[slice]:
    edges = np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def fit_index(x: np.ndarray, cells: int, seed: int) -> Tuple[np.ndarray, List[np.ndarray]]:
    rng = np.random.default_rng(seed)
    centres = _kmeans(x, cells, rng)
    rest = x - centres[_nearest(x, centres)]
    return centres, [_kmeans(rest[:, s], CODES, rng) for s in _cuts(x.shape[1])]


def _index_of(model: Model, dim: int) -> Tuple[np.ndarray, List[np.ndarray]]:
    """A dimension the sample lacked has one cell and codes that say nothing."""
    if dim in model:
        return model[dim]
    return np.zeros((1, dim)), [np.zeros((1, s.stop - s.start)) for s in _cuts(dim)]


def assign(x: np.ndarray, centres: np.ndarray, books: List[np.ndarray], radius: float):
    """Cell, codes, code loss and probed cells of unit vectors."""
    d2 = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T
    cell = d2.argmin(axis=1)
    rest = x - centres[cell]
    codes = np.stack([_nearest(rest[:, s], b) for s, b in zip(_cuts(x.shape[1]), books)], axis=1).astype(np.uint8)
    decoded = np.concatenate([b[codes[:, i]] for i, b in enumerate(books)], axis=1)
    loss = np.sqrt(((rest - decoded) ** 2).sum(1))
    size = (centres * centres).sum(1)
    # by products, as differences of all pairs would take cells x cells x dimensions
    between = np.sqrt(np.maximum(size[:, None] + size[None, :] - 2 * centres @ centres.T, 0) + 1e-12)[cell]
    probes = d2 - d2[np.arange(len(x)), cell][:, None] <= 2 * between * (radius + 1e-6) + 1e-9
    return cell, codes, loss, probes


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, raw, f1, f2) of every row; dim is 0 where the
    vector links with nothing. ``raw`` are its bytes in its own precision,
    scaled to a largest component of about one; f1 and f2 their hash."""
    kind = vectors.schema["embedding"].dataType.elementType
    dtype = np.dtype("<f4" if isinstance(kind, FloatType) else "<f8")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in slices(batches, 2048):
            dims, raws, prints = [], [], []
            for doc, label, value in zip(b.column(0), b.column(1), b.column(2)):
                v = value.values if value.is_valid else None
                dim, data = 0, b""
                if doc.is_valid and label.is_valid and v is not None and len(v) and not v.null_count:
                    a = v.to_numpy().astype(np.float64)
                    if np.isfinite(a).all() and a.any():
                        # by a power of two, which changes no cosine, so that no square leaves the range
                        dim, data = len(a), (np.ldexp(a, -np.frexp(np.abs(a).max())[1]) + 0.0).astype(dtype).tobytes()
                dims.append(dim)
                raws.append(data)
                h = xxhash.xxh3_128_intdigest(data)
                prints.append((h >> 64, h & 0xFFFFFFFFFFFFFFFF))
            f = np.array(prints, dtype=np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(dims, pa.int32()), pa.array(raws, pa.binary()), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy())],
                ["vec_id", "label", "dim", "raw", "f1", "f2"])

    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    return arrow_map(source, prepare, "vec_id long, label long, dim int, raw binary, f1 long, f2 long")


def fit_model(heads: DataFrame, total: int, dtype: str, cells: int, sample: int, seed: int) -> Model:
    """Coarse centres and code books from at most ``sample`` vectors, picked by
    a hash of the id, in one task; at most ``cells`` centres a dimension."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raws = [r for b in batches for r in b.column(0).to_pylist()]
        by_dim: Dict[int, List[bytes]] = {}
        for r in raws:
            by_dim.setdefault(len(r), []).append(r)
        for rows in by_dim.values():
            x = unit(np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1).astype(np.float64))
            centres, books = fit_index(x, cells, seed)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.shape[1]], pa.int32()), pa.array([centres.astype("<f8").tobytes()], pa.binary()),
                 pa.array([[b.astype("<f8").tobytes() for b in books]], pa.list_(pa.binary()))], ["dim", "centres", "books"])

    pick = F.xxhash64("vec_id", F.lit(seed))
    some = hash_sample(heads, pick, sample, total, "vec_id").select("vec_id", "raw").repartition(1).sortWithinPartitions(pick, "vec_id")
    model: Model = {}
    for r in arrow_map(some.select("raw"), fit, "dim int, centres binary, books array<binary>").collect():
        cut = _cuts(r.dim)
        model[r.dim] = (np.frombuffer(r.centres, "<f8").reshape(-1, r.dim),
                        [np.frombuffer(b, "<f8").reshape(-1, s.stop - s.start) for b, s in zip(r.books, cut)])
    return model


class _Piece:
    """A list piece in a task: its rows, their links so far as a forest."""

    def __init__(self, parts: List[pa.RecordBatch], dtype: np.dtype, model: Model):
        t = pa.Table.from_batches(parts)
        self.ids, self.size = t["vec_id"].to_numpy(), t["copies"].to_numpy()
        dim, cell = t["dim"][0].as_py(), t["cell"][0].as_py()
        self.raw = np.frombuffer(b"".join(t["raw"].to_pylist()), dtype).reshape(len(self.ids), dim).astype(np.float64)
        self.norm = np.sqrt((self.raw ** 2).sum(1))
        centres, self.books = _index_of(model, dim)
        self.centre, self.cut = centres[cell], _cuts(dim)
        self.codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(len(self.ids), -1)
        self.loss = t["loss"].to_numpy()
        self.root = np.arange(len(self.ids))

    def links(self, ids: np.ndarray, raw: np.ndarray, least: float, radius: float):
        """Of probes: (probe id, one linked id, number of linked vectors)."""
        norm = np.sqrt((raw ** 2).sum(1))
        rest = raw / norm[:, None] - self.centre
        adc = np.zeros((len(ids), len(self.ids)))
        for i, (s, book) in enumerate(zip(self.cut, self.books)):
            part = rest[:, s]
            table = (part * part).sum(1)[:, None] + (book * book).sum(1)[None, :] - 2 * part @ book.T
            adc += table[:, self.codes[:, i]]
        near = adc <= ((radius + self.loss + 1e-6) ** 2)[None, :]
        near &= ids[:, None] != self.ids[None, :]
        a, b = np.nonzero(near)
        out = []
        # at most 65,536 pairs at a time; a probe cut in two gives two rows
        for lo in range(0, len(a), 1 << 16):
            x, y = a[lo:lo + (1 << 16)], b[lo:lo + (1 << 16)]
            cos = np.einsum("ij,ij->i", raw[x], self.raw[y]) / (norm[x] * self.norm[y])
            hit = cos >= least
            x, y = x[hit], y[hit]
            edges = np.append(np.flatnonzero(np.r_[True, x[1:] != x[:-1]]), len(x)) if len(x) else np.zeros(1, int)
            for s, e in zip(edges[:-1], edges[1:]):
                p, linked = x[s], y[s:e]
                roots = np.unique(self.root[linked])
                if len(roots) > 1:
                    self.root[np.isin(self.root, roots)] = roots[0]
                out.append((int(ids[p]), int(self.ids[linked[0]]), int(self.size[linked].sum())))
        return out

    def forest(self):
        own = np.arange(len(self.ids))
        moved = own[self.root != own]
        return [(int(self.ids[i]), int(self.ids[self.root[i]]), 0) for i in moved]


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.98, sample: int = 16384, max_cells: int = 1024,
                           piece: int = 4096, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``
    (vec_id, label, embedding).

    Vectors of one label and one length are linked at a cosine of ``cosine``
    or more; ``n_links`` counts the other rows linked directly, copies
    included; ``component_id`` is the least vec_id reachable by links, itself
    included. A null vec_id, label or vector, an empty or zero vector, and one
    with null or non-finite components link with nothing; without vec_id the
    component is null and the row is kept. Repeated rows count as copies of
    each other. An empty table gives no rows; other columns are ignored.
    """
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    drawn = saved(prepared(vectors), "vectors")
    dtype = np.dtype("<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "<f8")
    good = drawn.where("dim > 0")
    classes = saved(good.groupBy("label", "dim", "f1", "f2").agg(F.min("vec_id").alias("head"), F.count(F.lit(1)).alias("copies")), "classes")
    # copies hold equal bytes, so any of them stands for the class
    heads = (good.join(classes.withColumnRenamed("head", "vec_id"), ["label", "dim", "f1", "f2", "vec_id"])
             .dropDuplicates(["label", "dim", "f1", "f2"]).select("vec_id", "label", "dim", "raw", "copies"))
    n, most = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    n = n or 0
    # by the largest label, whose lists are the longest
    cells = int(min(max_cells, max(1, round(np.sqrt(most or 0) / 4))))
    model = fit_model(heads, n, dtype.str, cells, sample, seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                t = b.take(pa.array(at))
                raws = t.column(3).to_pylist()
                x = unit(np.frombuffer(b"".join(raws), dtype).reshape(len(at), dim).astype(np.float64))
                cell, codes, loss, probes = assign(x, *_index_of(model, int(dim)), radius)
                where = [np.flatnonzero(p).tolist() for p in probes]
                yield pa.RecordBatch.from_arrays(
                    [*t.columns, pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()),
                     pa.array(loss), pa.array(where, pa.list_(pa.int32()))],
                    [*t.schema.names, "cell", "codes", "loss", "probes"])

    placed = saved(arrow_map(heads, place, "vec_id long, label long, dim int, raw binary, copies long, cell int, codes binary, "
                                           "loss double, probes array<int>"), "placed")
    key = ["label", "dim", "cell"]
    pieces = placed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("pieces"))
    lists = (placed.drop("probes").join(pieces, key)
             .withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int")).drop("pieces").withColumn("side", F.lit(0)))
    probing = (placed.select("vec_id", "label", "dim", "raw", "copies", F.explode("probes").alias("cell")).join(pieces, key)
               .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
               .withColumn("codes", F.lit(None).cast("binary")).withColumn("loss", F.lit(None).cast("double")).withColumn("side", F.lit(1)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held, out = None, [], None, []

        def rows(some):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], pa.int64()) for i in range(3)], ["a", "b", "links"])

        for k, part in runs(batches, ["label", "dim", "cell", "piece"]):
            if k != at:
                if held:
                    out += held.forest()
                at, parts, held = k, [], None
            side = part["side"].to_numpy()
            if (side == 0).any():
                parts.append(part.slice(0, int((side == 0).sum())))
            probes = part.slice(int((side == 0).sum()))
            for i in range(0, probes.num_rows, 256):
                if held is None:
                    held = _Piece(parts, dtype, model)
                p = probes.slice(i, 256)
                raw = np.frombuffer(b"".join(p["raw"].to_pylist()), dtype).reshape(p.num_rows, k[1]).astype(np.float64)
                out += held.links(p["vec_id"].to_numpy(), raw, cosine, radius)
                if len(out) > 20_000:
                    yield rows(out)
                    out = []
        if held:
            out += held.forest()
        yield rows(out)

    sort = ["label", "dim", "cell", "piece"]
    work = lists.unionByName(probing).select("vec_id", "label", "dim", "cell", "piece", "side", "raw", "copies", "codes", "loss")
    found = saved(arrow_map(work.repartition(*sort).sortWithinPartitions(*sort, "side"), search, "a long, b long, links long"), "links")
    components = connected_components(found.select("a", "b"))
    counts = found.groupBy(F.col("a").alias("head")).agg(F.sum("links").alias("links"))
    class_of = (classes.join(counts, "head", "left").join(components.withColumnRenamed("id", "head"), "head", "left")
                .select("label", "dim", "f1", "f2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                        F.coalesce("component", "head").alias("component")))
    return (drawn.select("vec_id", "label", "dim", "f1", "f2").join(class_of, ["label", "dim", "f1", "f2"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
