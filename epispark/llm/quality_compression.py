"""Quality score by compression (operator 1).

Two zstandard dictionaries are trained, one on good and one on bad labelled
text. A text resembles the class whose dictionary makes it smaller: the main
feature is the normalised difference of the two compressed sizes. A logistic
calibration, fitted on labelled documents that the dictionaries have not seen
and weighted to the classes' shares among all labels, turns it and the sizes
it is made of into a probability.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Callable, Iterator, List

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, class_counts, labelled_sample, slices, texts, worker_state

SEGMENT, LEVEL = 512, 3


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    mean: tuple
    scale: tuple
    weights: tuple
    constant: float  # the score of every text where a class has no labels


def _compressor(dictionary: bytes) -> Callable[[bytes], bytes]:
    plain = dict(level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
    if len(dictionary) < 8:
        return zs.ZstdCompressor(**plain).compress
    d = zs.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zs.ZstdCompressor(dict_data=d, **plain).compress


def _features(text: str, good: Callable, bad: Callable) -> List[float]:
    """Of a whole text: the normalised size difference over segments, where
    the dictionaries decide, and over the text at once, where its own
    repetitions do; compressed sizes per byte; log length."""
    data = text.encode()
    g = b = 0
    for i in range(0, len(data), SEGMENT):
        part = data[i:i + SEGMENT]
        g += len(good(part)) - 4
        b += len(bad(part)) - 4
    whole_g, whole_b = len(good(data)), len(bad(data))
    n = max(1, len(data))
    return [(b - g) / max(b, g, 1), g / n, b / n, whole_g / n, whole_b / n,
            (whole_b - whole_g) / max(whole_b, whole_g, 1), math.log(n)]


def _expand(x: np.ndarray) -> np.ndarray:
    k = x.shape[1]
    return np.column_stack([x] + [x[:, i] * x[:, j] for i in range(k) for j in range(i, k)])


def _dictionary(parts: List[bytes], size: int) -> bytes:
    segments = [t[i:i + SEGMENT] for t in parts for i in range(0, len(t), SEGMENT)]
    try:
        return zs.train_dictionary(size, segments).as_bytes()
    except (zs.ZstdError, ValueError):  # too little text for training: the text itself is the dictionary
        return b"".join(segments)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 60):
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    weight = weight / weight.sum()
    w = np.zeros(z.shape[1])
    keep = np.r_[0.0, np.ones(len(w) - 1)] * ridge
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ z + np.diag(keep + 1e-9)
        step = np.linalg.solve(hess, z.T @ (weight * (p - y)) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def fit_compression(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 3000,
                    class_bytes: int = 24_000_000, dictionary_bytes: int = 65536, seed: int = 17) -> CompressionModel:
    """Fit on a bounded sample: at most ``per_class`` documents of each class,
    whole texts until ``class_bytes`` a class are used, in the order of a hash
    of the id, in one task. Every other sampled document trains a dictionary,
    the rest calibrate. Without labels of both classes every score is the
    share of the class there is, or 0.5 without any."""
    counts = class_counts(labels, label)
    total = sum(counts.values())
    if len(counts) < 2:
        return CompressionModel(b"", b"", (), (), (), float(next(iter(counts))) if total else 0.5)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {0: [], 1: []}
        used = {0: 0, 1: 0}
        for b in batches:
            for text, y in zip(texts(b.column(0)), b.column(1).to_pylist()):
                if used[y] < class_bytes:
                    kept[y].append(text)
                    used[y] += len(text)
        if not (len(kept[0]) > 1 and len(kept[1]) > 1):
            return
        dicts = {y: _dictionary([t.encode() for t in kept[y][::2]], dictionary_bytes) for y in kept}
        good, bad = _compressor(dicts[1]), _compressor(dicts[0])
        rows, y, weight = [], [], []
        for label_value, some in kept.items():
            calibrate = some[1::2]
            rows += [_features(t, good, bad) for t in calibrate]
            y += [label_value] * len(calibrate)
            weight += [counts[label_value] / len(calibrate)] * len(calibrate)
        mean, scale, w = _logistic(_expand(np.array(rows)), np.array(y, float), np.array(weight, float))
        as_list = lambda v: pa.array([v.tolist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([dicts[1]], pa.binary()), pa.array([dicts[0]], pa.binary()), as_list(mean), as_list(scale), as_list(w)],
            ["good", "bad", "mean", "scale", "weights"])

    sample = labelled_sample(docs, labels, label, per_class, seed)
    one = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(seed)), "doc_id").select("text", "label")
    got = arrow_map(one, fit, "good binary, bad binary, mean array<double>, scale array<double>, weights array<double>").collect()
    if not got:
        return CompressionModel(b"", b"", (), (), (), counts.get(1, 0) / total)
    r = got[0]
    return CompressionModel(bytes(r.good), bytes(r.bad), tuple(r["mean"]), tuple(r.scale), tuple(r.weights), 0.5)


def score_quality(docs: DataFrame, model: CompressionModel, threshold: float = 0.7) -> DataFrame:
    """``docs`` with score (0 to 1, higher: better) and predicted (score >=
    ``threshold``), from the text alone.

    Null texts score as empty ones, which get a score too; repeated rows stay;
    an empty table gives no rows. Columns of ``docs`` are kept; those named
    like a result are replaced.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.weights:
            good, bad = worker_state(("zstd", hash(model)), lambda: (_compressor(model.good), _compressor(model.bad)))
            mean, scale, w = (np.array(v) for v in (model.mean, model.scale, model.weights))
        for b in slices(batches):
            rest = [b.column(i) for i in range(b.num_columns)]
            if model.weights:
                x = _expand(np.array([_features(t, good, bad) for t in texts(b.column(b.schema.get_field_index("text")))]))
                p = 1 / (1 + np.exp(-np.clip(w[0] + ((x - mean) / scale) @ w[1:], -30, 30)))
            else:
                p = np.full(b.num_rows, model.constant)
            yield pa.RecordBatch.from_arrays([*rest, pa.array(p, pa.float64())], [*b.schema.names, "score"])

    base = docs.drop("score", "predicted")
    from pyspark.sql.types import DoubleType, StructType

    schema = StructType(list(base.schema.fields)).add("score", DoubleType())
    return arrow_map(base, score, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
