"""Mixing sources to target weights by iterative proportional fitting (operator 9).

Tokens are summed per cell of source x language x topic. The cell sums are
raked: each dimension in turn is scaled so that its marginal meets the target,
with no cell above the tokens there are, until all marginals hold. A cell's
raked share of its own tokens is the probability with which each of its
documents is drawn, so the expected token marginals are the targets.

Topics come from spherical k-means over hashed words, fitted on all distinct
documents. Categories that a mapping does not name form one rest category; under
an exponent every category has its own target.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass
from typing import Callable, Dict, Iterator, List, Mapping, Optional, Tuple, Union

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .common import arrow_map, forget, hashed_words, saved, slices, text_bytes, word_edges

_LOG = logging.getLogger(__name__)
REST = "(rest)"
#: More cells than these are joined by a shuffle; fewer go to every task.
BROADCAST_CELLS = 500_000
_WORD = re.compile(r"[^\W\d_]+")
#: ASCII letters in lower case, bytes of other characters as they are, the rest as spaces.
_WORD_BYTES = bytes(b | 32 if chr(b).isalpha() else 32 for b in range(128)) + bytes(range(128, 256))
#: ASCII white space as spaces.
_BLANKED = bytes(32 if chr(b).isspace() else b for b in range(128)) + bytes(range(128, 256))
#: The other characters of white space, as the three bytes they begin with or fill, and the first of these bytes.
_WIDE = [chr(c).encode() for c in range(128, 1 << 16) if chr(c).isspace()]
_WIDE_SPACES = [int.from_bytes(c.ljust(3, b"\0"), "big") for c in _WIDE]
_WIDE_LEADS = bytes(b in {c[0] for c in _WIDE} for b in range(256))
#: A count as it is stored.
_CELL = np.dtype([("slot", "<u2"), ("n", "<u4")])
Target = Union[Mapping[str, float], float]


@dataclass(frozen=True)
class TopicModel:
    centres: bytes  # float64, topics x slots
    topics: int
    slots: int
    languages: tuple  # those with a mean of their own
    means: bytes  # float64, (languages + 1) x slots, the last for all others


def _counts(some: Union[List[str], pa.Array], slots: int) -> np.ndarray:
    """Counts of hashed words, a row per text."""
    column = some if isinstance(some, pa.Array) else pa.array(some, pa.string())
    hashes, place, row = hashed_words(column, _WORD_BYTES, _WORD.findall, xxhash.xxh32_intdigest)
    slot = (hashes % np.uint64(slots)).astype(np.int64)
    return np.bincount(row * slots + slot[place], minlength=len(column) * slots).reshape(len(column), slots)


def _tokens(column: pa.Array) -> np.ndarray:
    """White-space separated words of each text. Those of texts with white
    space beyond ASCII are split one by one."""
    data, at = text_bytes(column)
    starts, _ = word_edges(np.frombuffer(data.tobytes().translate(_BLANKED), np.uint8) != 32, at)
    n = np.diff(np.searchsorted(starts, at))
    lead = np.flatnonzero(np.frombuffer(data.tobytes().translate(_WIDE_LEADS), bool))
    wide = data[lead].astype(np.int32) << 16 | data[lead + 1].astype(np.int32) << 8
    wide |= np.where(data[lead] >= 0xE0, data[np.minimum(lead + 2, len(data) - 1)], 0)
    for i in np.unique(np.searchsorted(at, lead[np.isin(wide, _WIDE_SPACES)], side="right") - 1).tolist():
        n[i] = len(column[i].as_py().split())
    return n


def _unit(x: np.ndarray) -> np.ndarray:
    np.sqrt(x, out=x)
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-12)[:, None]


def _slot_counts(some: Union[List[str], pa.Array], slots: int) -> np.ndarray:
    """Unit vectors of square-rooted counts of hashed words."""
    return _unit(_counts(some, slots).astype(float))


def _stored(counts: np.ndarray) -> pa.Array:
    """The cells that are not zero, a binary of them per row."""
    row, at = np.nonzero(counts)
    cells = np.empty(len(at), dtype=_CELL)
    cells["slot"], cells["n"] = at, counts[row, at]
    ends = (np.searchsorted(row, np.arange(len(counts) + 1)) * _CELL.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(cells.tobytes())])


def _loaded(column: pa.Array, slots: int) -> np.ndarray:
    """The unit vectors of stored counts."""
    x = np.zeros((len(column), slots))
    size = pc.binary_length(column).to_numpy(zero_copy_only=False) // _CELL.itemsize
    cells = np.frombuffer(b"".join(column.to_pylist()), _CELL)
    x[np.repeat(np.arange(len(column)), size), cells["slot"]] = cells["n"]
    return _unit(x)


def _less_language(x: np.ndarray, languages: List, names: tuple, means: np.ndarray) -> np.ndarray:
    """What is left of the vectors without their language's mean."""
    place = {n: i for i, n in enumerate(names)}
    rest = x - means[[place.get(v, len(names)) for v in languages]]
    return rest / np.maximum(np.sqrt((rest * rest).sum(1)), 1e-12)[:, None]


def _sums(vectors: DataFrame, kind: str, place: Callable[[pa.RecordBatch], Tuple[list, np.ndarray]], slots: int) -> Dict:
    """{key: (documents, sum of vectors)} over all rows; ``place`` gives the
    keys (of type ``kind``) and the vectors of a batch. Each task adds up its
    own rows, so a key brings one row a task to the sums of these."""
    schema = f"key {kind}, n long, total binary"

    def collected(parts: Iterator[Tuple[list, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held: Dict = {}
        for keys, n, x in parts:
            codes = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            at = np.array([codes[k] for k in keys], dtype=np.int64)
            for k, i in codes.items():
                mine = at == i
                count, total = held.get(k, (0, 0.0))
                held[k] = (count + int(n[mine].sum()), total + x[mine].sum(0))
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string() if kind == "string" else pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()),
                 pa.array([t.astype("<f8").tobytes() for _, t in held.values()], pa.binary())], ["key", "n", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return collected((keys, np.ones(len(keys), dtype=np.int64), x) for keys, x in map(place, slices(batches, 512)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return collected((b.column(0).to_pylist(), b.column(1).to_numpy(),
                          np.stack([np.frombuffer(t, "<f8") for t in b.column(2).to_pylist()])) for b in slices(batches, 512))

    got = arrow_map(arrow_map(vectors, add, schema).repartition("key"), merge, schema).collect()
    return {r.key: (r.n, np.frombuffer(bytes(r.total), "<f8")) for r in got}


def fit_topics(docs: DataFrame, topics: int = 8, slots: int = 512, seed: int = 5, rounds: int = 15) -> TopicModel:
    """Centres of all distinct documents (text, lang): k-means whose rounds are
    sums per topic within each task. Copies of a text in a language enter once.
    The mean of a language is taken off first, for topics that are not the
    languages again; languages with under 20 documents share one. The first
    centres are documents picked by a hash of their text; with fewer distinct
    documents than topics some topics stay unused. Word counts are written to
    the scratch folder, so texts are read once."""
    if slots > 1 << 16:
        raise ValueError("at most 65536 slots")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _stored(_counts(b.column(2), slots))], ["key", "lang", "counts"])

    rows = docs.where("text is not null").select(F.xxhash64("text", F.lit(seed)).alias("key"), F.col("lang").cast("string").alias("lang"), "text")
    vectors = saved(arrow_map(rows, count, "key long, lang string, counts binary").distinct(), "vectors")
    by_language = _sums(vectors.select("lang", "counts"), "string", lambda b: (b.column(0).to_pylist(), _loaded(b.column(1), slots)), slots)
    if not by_language:
        forget(vectors)
        return TopicModel(np.zeros((topics, slots)).tobytes(), topics, slots, (), np.zeros((1, slots)).tobytes())
    names = tuple(sorted(k for k, (n, _) in by_language.items() if k is not None and n >= 20))
    others = [v for k, v in by_language.items() if k not in names] or list(by_language.values())
    means = np.stack([by_language[k][1] / by_language[k][0] for k in names] + [sum(t for _, t in others) / sum(n for n, _ in others)])
    first = vectors.where(F.length("counts") > 0).orderBy("key", "lang").select("lang", "counts").limit(topics).collect()
    centres = np.zeros((topics, slots))
    if first:
        x = _loaded(pa.array([bytes(r.counts) for r in first], pa.binary()), slots)
        centres = np.resize(_less_language(x, [r.lang for r in first], names, means), (topics, slots))
    for _ in range(rounds):
        now = centres

        def nearest(b: pa.RecordBatch) -> Tuple[list, np.ndarray]:
            x = _less_language(_loaded(b.column(1), slots), b.column(0).to_pylist(), names, means)
            return (x @ now.T).argmax(1).tolist(), x

        centres = now.copy()
        for k, (_, total) in _sums(vectors.select("lang", "counts"), "int", nearest, slots).items():
            if total.any():
                centres[k] = total / np.sqrt((total * total).sum())
        if np.allclose(centres, now, atol=1e-6):
            break
    forget(vectors)
    return TopicModel(centres.astype("<f8").tobytes(), topics, slots, names, means.astype("<f8").tobytes())


def annotate(docs: DataFrame, model: TopicModel) -> DataFrame:
    """``docs`` with ``topic`` and ``tokens`` (white-space separated words)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = np.frombuffer(model.centres, "<f8").reshape(model.topics, model.slots)
        means = np.frombuffer(model.means, "<f8").reshape(-1, model.slots)
        for b in slices(batches, 1024):
            column = b.column(b.schema.get_field_index("text"))
            x = _less_language(_slot_counts(column, model.slots), b.column(b.schema.get_field_index("lang")).to_pylist(), model.languages, means)
            topic = (x @ centres.T).argmax(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(topic), pa.array(_tokens(column), pa.int64())], [*b.schema.names, "topic", "tokens"])

    base = docs.drop("topic", "tokens")
    return arrow_map(base, add, StructType(list(base.schema.fields)).add("topic", IntegerType()).add("tokens", LongType()))


def _places(cells: np.ndarray) -> List[np.ndarray]:
    """The index of every cell of a dense table, an array per dimension."""
    return [i.ravel() for i in np.indices(cells.shape)]


def _scales(cells: np.ndarray, weight: np.ndarray, at: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Per category of one dimension (``at`` gives each cell's) the factor f
    for which its sum(min(cells, cells * weight * f)) = goal. The sum is
    concave in f, so Newton's steps from below end at the factor."""
    n = len(goal)
    live = (cells > 0) & (weight > 0)
    at, c, w = at[live], cells[live], weight[live]
    whole, free = np.bincount(at, c, n), np.bincount(at, c * w, n)
    least = np.full(n, np.inf)
    np.minimum.at(least, at, w)
    f = np.where(np.isfinite(least), 1 / least, 1.0)  # all there is
    f[goal <= 0] = 0.0
    open_ = (goal > 0) & (whole > goal)
    f[open_] = goal[open_] / free[open_]
    while open_.any():
        out = w * f[at] >= 1
        left = np.bincount(at, np.where(out, 0.0, c * w), n)
        step = np.divide(goal - np.bincount(at, np.where(out, c, 0.0), n), left, out=np.zeros(n), where=left > 0)
        open_ &= step > f * (1 + 1e-12)
        f[open_] = step[open_]
    return f


def _marginal(cells: np.ndarray, d: int) -> np.ndarray:
    return cells.sum(tuple(a for a in range(cells.ndim) if a != d))


def _fit(cells: np.ndarray, targets: List[np.ndarray], total: float, rounds: int = 1000, at: Optional[List[np.ndarray]] = None):
    """Weights (to be cut at 1) whose kept cells meet the targets at ``total``,
    and the largest share of the kept tokens that a dimension has in the wrong
    categories. ``cells`` is dense, or flat with its places ``at``. Fitting
    starts slowly on sparse cells; it ends when ten rounds bring under 0.1 %."""
    at, c = at or _places(cells), cells.ravel()
    weight = np.ones_like(c)
    errors: List[float] = []
    for _ in range(rounds):
        for i, t in zip(at, targets):
            weight *= _scales(c, weight, i, total * t)[i]
            # where a total cannot be met weights grow without end
            weight[weight > 0] = np.clip(weight[weight > 0], 1e-120, 1e120)
        kept = np.minimum(c, c * weight)
        whole = kept.sum() or 1.0
        errors.append(max(float(np.abs(np.bincount(i, kept, len(t)) / whole - t).sum() / 2) for i, t in zip(at, targets)))
        if errors[-1] < 1e-6 or len(errors) > 10 and errors[-1] > 0.999 * errors[-11]:
            break
    return weight.reshape(cells.shape), errors[-1]


def rake(cells: np.ndarray, targets: List[np.ndarray], tolerance: float = 0.005, at: Optional[List[np.ndarray]] = None) -> np.ndarray:
    """Shares (0 to 1) of the cells to keep, whose marginals are in proportion
    to ``targets``, for the largest total found that allows it.

    Targets are shares over categories that have tokens. Raking a tiny total,
    where no cell runs out, gives the error that empty cells make inevitable.
    The total is sought, to 1 %, between all tokens and the scarcest
    category's limit (or below, where cells run out) so that no dimension has
    more of the kept tokens in wrong categories than that error plus
    ``tolerance``. Categories too small to matter for that are kept whole
    instead of shrinking the total for their sake.
    """
    if cells.sum() <= 0:
        return np.zeros_like(cells)
    at = at or _places(cells)
    c = cells.ravel()
    sums = [np.bincount(i, c, len(t)) for i, t in zip(at, targets)]
    low, high = min(float((m[t > 0] / t[t > 0]).min()) for m, t in zip(sums, targets)), float(c.sum())
    _, inevitable = _fit(c, targets, low * 1e-6, at=at)
    weight, error = best = _fit(c, targets, high, at=at)
    if not error <= inevitable + tolerance:
        weight, error = best = _fit(c, targets, low, at=at)
        for _ in range(20):
            if error <= inevitable + tolerance:
                break
            high, low = low, low / 2
            weight, error = best = _fit(c, targets, low, at=at)
        while high > 1.01 * low:
            middle = float(np.sqrt(low * high))
            tried, error = _fit(c, targets, middle, at=at)
            if error <= inevitable + tolerance:
                best, low = (tried, error), middle
            else:
                high = middle
    weight, error = best
    _LOG.info("mixing: %.4f of the kept tokens in wrong categories, %.4f by empty cells; %.4f of the tokens kept", error, inevitable,
              np.minimum(c, c * weight).sum() / c.sum())
    return np.where(c > 0, np.minimum(weight, 1.0), 0.0).reshape(cells.shape)


def shares(observed: Dict[str, float], target: Target) -> Dict[str, float]:
    """Target shares of the observed categories. A number is an exponent on
    the observed shares, the rest keeping its own; a mapping names shares, what it leaves goes to the
    rest. Categories without tokens give their share to the others."""
    if isinstance(target, Mapping):
        named = {k: float(v) for k, v in target.items()}
        raw = {k: named.get(k, max(0.0, 1 - sum(named.values())) if k == REST else 0.0) for k in observed}
    else:
        total = sum(observed.values()) or 1.0
        raw = {k: (v / total) ** float(target) for k, v in observed.items() if k != REST}
        if REST in observed:  # unnamed values keep their share
            rest = observed[REST] / total
            raw[REST] = sum(raw.values()) * rest / (1 - rest) if rest < 1 else 1.0
    raw = {k: v if observed[k] > 0 else 0.0 for k, v in raw.items()}
    whole = sum(raw.values())
    return {k: v / whole if whole else 0.0 for k, v in raw.items()}


def category(column: str, target: Target) -> Column:
    """The column's category: its value, or the rest for nulls and for values
    that a mapping does not name."""
    value = F.col(column).cast("string")
    if not isinstance(target, Mapping):
        return F.coalesce(value, F.lit(REST))
    named = [k for k in target if k != REST]
    return F.when(value.isin(*named), value).otherwise(F.lit(REST)) if named else F.lit(REST)


def mixing_plan(rows: DataFrame, targets: Mapping[str, Target]):
    """A table (cell_<dimension> each, probability) of all cells of annotated
    ``rows`` that have tokens, and the target shares.

    A mapping names its categories and leaves the others as the rest; for an
    exponent every value is a category with a target of its own. The driver
    holds the cells that occur, as flat arrays, not their product.
    """
    names = list(targets)
    got = (rows.groupBy(*[category(n, targets[n]).alias(f"cell_{n}") for n in names]).agg(F.sum("tokens").alias("tokens"))
           .where("tokens > 0").toArrow())
    cells = got.column("tokens").to_numpy().astype(float)
    goal, arrays, at = {}, [], []
    for n in names:
        column = got.column(f"cell_{n}").combine_chunks().dictionary_encode()
        at.append(column.indices.to_numpy(zero_copy_only=False).astype(np.int64))
        seen = column.dictionary.to_pylist()
        goal[n] = shares(dict(zip(seen, np.bincount(at[-1], cells, len(seen)).tolist())), targets[n])
        arrays.append(np.array([goal[n][k] for k in seen]))
    kept = rake(cells, arrays, at=at)
    return got.drop_columns(["tokens"]).append_column("probability", pa.array(kept, pa.float64())), goal


def mix(docs: DataFrame, targets: Mapping[str, Target], model: TopicModel, seed: int = 29) -> DataFrame:
    """The drawn documents: ``docs`` with topic, tokens and probability.

    ``targets`` maps source, lang and topic (any columns of the annotated
    documents) to shares. A document is drawn when a hash of its id, or of its
    text without one, falls below its cell's probability, so repeated rows are
    drawn together. Documents without words weigh nothing and take their
    cell's probability, one where the cell has no tokens at all. Null
    categories belong to the rest. Columns of ``docs`` are kept; those named
    like a result are replaced. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = saved(annotate(docs.drop("probability"), model), "annotated")  # read for the cells and for the draw
    plan, _ = mixing_plan(rows, targets)
    names = list(targets)
    schema = ", ".join(f"cell_{n} string" for n in names) + ", probability double"
    table = spark.createDataFrame(plan, schema) if plan.num_rows else spark.createDataFrame([], schema)
    if plan.num_rows <= BROADCAST_CELLS:
        table = F.broadcast(table)
    tagged = rows.withColumns({f"cell_{n}": category(n, targets[n]) for n in names})
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text")), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return (tagged.join(table, [f"cell_{n}" for n in names], "left")
            .withColumn("probability", F.coalesce("probability", F.lit(1.0))).where(draw < F.col("probability"))
            .drop(*[f"cell_{n}" for n in names]))
