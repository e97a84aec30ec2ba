"""Toxicity by a factorization machine over hashed terms (operator 10).

A text is the set of its lower-cased words, hashed. The machine adds a weight
per term and, for each pair of terms present, the inner product of their
factors, so it learns that an insult with a group mention is worse than
either. Terms are screened on the training sample by their association with
the label, which keeps unrelated words, however many, from adding up. A term
that tells little alone may tell much beside another: terms are screened again
within the documents that hold a term already kept. Of two terms that are
toxic together only, the rarer one is told by the first screen, its partner
by the second.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from typing import Dict, Iterator, List

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import GenerationCache, arrow_map, class_counts, labelled_sample, slices, texts, worker_state

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class FactorModel:
    terms: tuple  # hashes of the screened terms
    bias: float
    weights: tuple
    factors: bytes  # float32, terms x rank
    rank: int


def term_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode()) >> 1


def _words(text: str) -> set:
    return set(_WORD.findall(text.lower()))


def margins(rows: List[np.ndarray], bias: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of documents given as places of the terms they hold: bias + sum of
    weights + sum over pairs of factor products, the latter as half of
    (sum of factors) squared less the sum of squares."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    idx = np.concatenate(rows) if rows else np.zeros(0, int)
    idx = idx.astype(np.int64)
    z = bias + np.bincount(at, w[idx], len(rows))
    for f in range(v.shape[1]):
        col = v[idx, f]
        z += 0.5 * (np.bincount(at, col, len(rows)) ** 2 - np.bincount(at, col * col, len(rows)))
    return z


def _train(rows: List[np.ndarray], y: np.ndarray, weight: np.ndarray, n_terms: int, rank: int, rounds: int, seed: int):
    """Adam with decoupled decay on mini-batches of dense presence rows."""
    rng = np.random.default_rng(seed)
    x = np.zeros((len(rows), n_terms), dtype=np.uint8)
    for i, r in enumerate(rows):
        x[i, r] = 1
    weight = weight / weight.mean()
    base = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    p = [np.array([np.log(base / (1 - base))]), np.zeros(n_terms), rng.normal(0, 0.02, (n_terms, rank))]
    m = [np.zeros_like(a) for a in p]
    s = [np.zeros_like(a) for a in p]
    decay = (0.0, 0.002, 0.01)
    t = 0
    for epoch in range(rounds):
        rate = 0.1 / (1 + epoch / 8)
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), 256):
            pick = order[lo:lo + 256]
            b = x[pick].astype(np.float64)
            sums = b @ p[2]
            z = p[0] + b @ p[1] + 0.5 * ((sums ** 2).sum(1) - b @ (p[2] ** 2).sum(1))
            err = weight[pick] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            grads = [np.array([err.sum()]), b.T @ err, b.T @ (err[:, None] * sums) - (b.T @ err)[:, None] * p[2]]
            t += 1
            for k in range(3):
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                s[k] = 0.99 * s[k] + 0.01 * grads[k] ** 2
                step = (m[k] / (1 - 0.9 ** t)) / (np.sqrt(s[k] / (1 - 0.99 ** t)) + 1e-6)
                p[k] = p[k] - rate * (step + decay[k] * np.sign(p[k]) * (k == 1) + decay[k] * p[k])
    return float(p[0][0]), p[1], p[2]


def _association(both: np.ndarray, toxic: np.ndarray, all_: float, all1: float, documents: float) -> np.ndarray:
    """Chi-square of terms with the label, of weights of ``documents`` documents:
    ``both`` those that hold a term, ``toxic`` the toxic ones among them."""
    expected = both * all1 / all_
    spread = expected * (1 - all1 / all_) * (1 - both / all_) + 1e-9
    return (toxic - expected) ** 2 / spread * documents / all_


def copy_groups(bags: List[np.ndarray], least: float = 0.7) -> List[int]:
    """A group per document, one for near copies: those that share their three
    least hashes and ``least`` of all hashes with the first of the group."""
    firsts: Dict[bytes, List[int]] = {}
    out = []
    for i, bag in enumerate(bags):
        some = firsts.setdefault(bag[:3].tobytes(), [])
        for j in some:
            shared = len(np.intersect1d(bag, bags[j], assume_unique=True))
            if shared >= least * (len(bag) + len(bags[j]) - shared):  # two empty bags too
                out.append(j)
                break
        else:
            some.append(i)
            out.append(i)
    return out


def fit_factor_machine(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 4000,
                       class_bytes: int = 32_000_000, n_terms: int = 2048, min_documents: int = 6,
                       min_score: float = 40.0, rank: int = 8, rounds: int = 30, seed: int = 23) -> FactorModel:
    """Fit on a bounded sample: at most ``per_class`` documents of each class,
    whole texts until ``class_bytes`` a class are used, in the order of a hash
    of the id, in one task. Terms need ``min_documents`` sampled documents that
    are no copies of each other and a chi-square of ``min_score``, over the
    sample or over its documents with a term that passed so; the ``n_terms``
    best stay. Classes weigh as among all labels; copies within
    the sample share one document's weight. Without labels of both classes
    every score is the share of the class there is, or 0 without any."""
    counts = class_counts(labels, label)
    if len(counts) < 2:
        return FactorModel((), 30.0 if counts.get(1) else -30.0, (), b"", rank)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = {0: 0, 1: 0}
        bags, ys = [], []
        hashes = GenerationCache(term_hash)
        for b in batches:
            for text, y in zip(texts(b.column(0)), b.column(1).to_pylist()):
                if used[y] < class_bytes:
                    used[y] += len(text)
                    bags.append(np.unique(np.fromiter(map(hashes.__getitem__, _words(text)), dtype=np.int64)))
                    ys.append(y)
        y = np.array(ys, float)
        n1, n0 = y.sum(), (1 - y).sum()
        if not n1 or not n0:
            return
        keys = copy_groups(bags)
        copies = Counter(keys)
        weight = np.array([(counts[1] / n1 if v else counts[0] / n0) / copies[k] for v, k in zip(ys, keys)])
        flat = np.concatenate(bags)
        per = np.repeat(weight, [len(bag) for bag in bags])
        terms, inverse = np.unique(flat, return_inverse=True)
        both = np.bincount(inverse, per, len(terms))
        toxic = np.bincount(inverse, per * np.repeat(y, [len(bag) for bag in bags]), len(terms))
        all_, all1 = weight.sum(), (weight * y).sum()
        single = np.array([1 / copies[k] for k in keys])
        apart = np.bincount(inverse, np.repeat(single, [len(bag) for bag in bags]), len(terms))
        score = _association(both, toxic, all_, all1, len(bags)) * (apart >= min_documents)
        score[score < min_score] = 0
        first = np.argsort(-score, kind="stable")[:n_terms]
        cuts = np.cumsum([0, *(len(bag) for bag in bags)])
        beside = np.zeros(len(terms))
        for k in first[score[first] > 0]:
            held = np.flatnonzero(inverse == k)
            some = np.searchsorted(cuts, held, side="right") - 1
            at = np.concatenate([inverse[cuts[d]:cuts[d + 1]] for d in some])
            sizes = cuts[some + 1] - cuts[some]
            near, back = np.unique(at, return_inverse=True)
            within = _association(np.bincount(back, np.repeat(weight[some], sizes)), np.bincount(back, np.repeat((weight * y)[some], sizes)),
                                  weight[some].sum(), (weight * y)[some].sum(), single[some].sum())
            within *= np.bincount(back, np.repeat(single[some], sizes)) >= min_documents
            beside[near] = np.maximum(beside[near], within)
        beside[beside < min_score] = 0
        score = np.maximum(score, beside)
        keep = np.sort(np.argsort(-score, kind="stable")[:n_terms])
        keep = keep[score[keep] > 0]
        place = np.full(len(terms), -1)
        place[keep] = np.arange(len(keep))
        rows = np.split(place[inverse], np.cumsum([len(bag) for bag in bags])[:-1])
        rows = [r[r >= 0] for r in rows]
        bias, w, v = _train(rows, y, weight, len(keep), rank, rounds, seed)
        yield pa.RecordBatch.from_arrays(
            [pa.array([terms[keep].tolist()], pa.list_(pa.int64())), pa.array([bias]), pa.array([w.tolist()], pa.list_(pa.float64())),
             pa.array([v.astype("<f4").tobytes()], pa.binary())], ["terms", "bias", "weights", "factors"])

    sample = labelled_sample(docs, labels, label, per_class, seed)
    one = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(seed)), "doc_id").select("text", "label")
    got = arrow_map(one, fit, "terms array<long>, bias double, weights array<double>, factors binary").collect()
    if not got:
        share = min(max(counts[1] / sum(counts.values()), 1e-9), 1 - 1e-9)
        return FactorModel((), float(np.log(share / (1 - share))), (), b"", rank)
    r = got[0]
    return FactorModel(tuple(r.terms), r.bias, tuple(r.weights), bytes(r.factors), rank)


class _Scorer:
    def __init__(self, model: FactorModel):
        place = {h: i for i, h in enumerate(model.terms)}
        self.places = GenerationCache(lambda word: place.get(term_hash(word), -1))
        self.bias, self.w = model.bias, np.array(model.weights)
        self.v = np.frombuffer(model.factors, "<f4").reshape(-1, model.rank).astype(float)

    def scores(self, some: List[str]) -> np.ndarray:
        rows = []
        for t in some:
            held = set(map(self.places.__getitem__, _words(t)))
            held.discard(-1)
            rows.append(np.fromiter(sorted(held), dtype=np.int64, count=len(held)))
        if not len(self.w):
            z = np.full(len(some), self.bias)
        else:
            z = margins(rows, self.bias, self.w, self.v)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_toxicity(docs: DataFrame, model: FactorModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1, higher: more toxic) and predicted (score >=
    ``threshold``), from the text alone.

    Null texts score as empty ones, which get the machine's bias; repeated
    rows stay; an empty table gives no rows. Columns of ``docs`` are kept;
    those named like a result are replaced.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_state(("fm", hash(model)), lambda: _Scorer(model))
        for b in slices(batches):
            p = scorer.scores(texts(b.column(b.schema.get_field_index("text"))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, "score"])

    base = docs.drop("score", "predicted")
    schema = StructType(list(base.schema.fields)).add("score", DoubleType())
    return arrow_map(base, score, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
