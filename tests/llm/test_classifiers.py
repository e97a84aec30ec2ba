"""Quality and toxicity: held-out accuracy, degenerate labels, awkward rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from epispark.llm import quality_compression, toxicity_fm
from epispark.llm.common import held_out
from epispark.llm.queries import QUERIES

from conftest import SF_CHECK, SF_SMALL
from helpers import ODD, auc, crc, no_documents, odd_documents

LABELS = "doc_id long, quality int, toxic int"


def scored(spark, name, label):
    rows = QUERIES[name](spark, SF_CHECK).collect()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF_CHECK}/documents.parquet").count()
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) for r in rows)
    return rows, [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]


def test_quality_held_out(spark):
    rows, ho = scored(spark, "op1_quality", "quality")
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert auc([s for s, _, _ in ho], [y for _, y, _ in ho]) > 0.95
    assert np.mean([p == y for _, y, p in ho]) > 0.9


def test_toxicity_held_out(spark):
    rows, ho = scored(spark, "op10_toxicity", "toxic")
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert auc([s for s, _, _ in ho], [y for _, y, _ in ho]) > 0.75
    assert np.mean([p for _, y, p in ho if y == 0]) < 0.02  # clean documents are left alone
    assert np.mean([p for _, y, p in ho if y == 1]) > 0.5


def test_quality_query_equals_plain_scores(spark):
    """Each whole text compressed by hand, one at a time, with the dictionaries
    of the same fit; the logistic written out."""
    import math

    import zstandard

    docs, labels = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_compression.fit_compression(docs, labels, "quality")
    plain = dict(level=3, write_checksum=False, write_content_size=False, write_dict_id=False)
    press = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **plain) for d in (model.good, model.bad)]
    got = {r.doc_id: r for r in QUERIES["op1_quality"](spark, SF_SMALL).collect()}
    for r in docs.select("doc_id", "text").collect():
        data = (r.text or "").encode()
        g, b = (sum(len(c.compress(data[i:i + 512])) - 4 for i in range(0, len(data), 512)) for c in press)
        wg, wb = (len(c.compress(data)) for c in press)
        n = max(1, len(data))
        x = [(b - g) / max(b, g, 1), g / n, b / n, wg / n, wb / n, (wb - wg) / max(wb, wg, 1), math.log(n)]
        x += [x[i] * x[j] for i in range(7) for j in range(i, 7)]
        odds = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], x, model.mean, model.scale))
        score = 1 / (1 + math.exp(-min(30, max(-30, odds))))
        assert abs(got[r.doc_id].score - score) < 1e-9 and got[r.doc_id].predicted == int(score >= 0.7)
        assert got[r.doc_id].held_out == (crc(r.doc_id) % 4 == 2)


def test_toxicity_query_equals_the_sum_over_pairs(spark):
    """Every text by hand: words, weights, and factors of all pairs."""
    import re

    docs, labels = (spark.read.parquet(f"{SF_CHECK}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity_fm.fit_factor_machine(docs, labels, "toxic")
    factors = np.frombuffer(model.factors, "<f4").reshape(-1, model.rank).astype(float)
    place = {h: i for i, h in enumerate(model.terms)}
    got = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, SF_CHECK).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        held = sorted({place[h] for h in map(toxicity_fm.term_hash, set(re.findall(r"\w+", (r.text or "").lower()))) if h in place})
        z = model.bias + sum(model.weights[i] for i in held) + sum(factors[i] @ factors[j] for i, j in itertools.combinations(held, 2))
        score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        assert abs(got[r.doc_id].score - score) < 1e-9 and got[r.doc_id].predicted == int(score >= 0.3)


def test_held_out_fold(spark):
    got = spark.range(200).withColumn("h", held_out(F.col("id"))).collect()
    assert all(r.h == (crc(r.id) % 4 == 2) for r in got)
    assert spark.sql("select cast(null as long) as id").select(held_out(F.col("id"))).first()[0] is False


def test_labels_of_the_fold_are_not_learnt(spark):
    """Flipping every held-out label changes no score."""
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    flipped = labels.withColumns({c: F.when(held_out(F.col("doc_id")), 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    assert quality_compression.fit_compression(docs, labels) == quality_compression.fit_compression(docs, flipped)
    assert toxicity_fm.fit_factor_machine(docs, labels, rounds=2) == toxicity_fm.fit_factor_machine(docs, flipped, rounds=2)


def test_machine_learns_a_pair(spark):
    """Neither word alone is toxic, both together are."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        words = [f"w{k}" for k in rng.integers(0, 300, 12)]
        a, b = [(0, 0), (1, 0), (0, 1), (1, 1)][i % 4]
        words += ["insult"] * a + ["group"] * b
        rows.append((i, " ".join(rng.permutation(words)), int(a and b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity_fm.fit_factor_machine(docs.drop("toxic"), docs.select("doc_id", "toxic"), min_score=20.0)
    probes = spark.createDataFrame([(1, "w1 insult w2"), (2, "w1 group w2"), (3, "w1 insult w2 group"), (4, "w1 w2")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity_fm.score_toxicity(probes, model).collect()}
    assert got[3] > 0.6 and max(got[1], got[2], got[4]) < 0.4
    place = [model.terms.index(toxicity_fm.term_hash(w)) for w in ("insult", "group")]
    v = np.frombuffer(model.factors, "<f4").reshape(-1, model.rank)
    assert v[place[0]] @ v[place[1]] > 0.5


def test_machine_learns_a_rare_pair_at_its_defaults(spark):
    """One word in 15 % of the documents, the other in 2 %, toxic where both
    are: the first tells next to nothing alone."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(6000):
        a, b = rng.random() < 0.15, rng.random() < 0.02
        words = [f"w{k}" for k in rng.integers(0, 300, 12)] + ["insult"] * a + ["group"] * b
        rows.append((i, " ".join(rng.permutation(words)), int(a and b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity_fm.fit_factor_machine(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    probes = spark.createDataFrame([(1, "w1 insult w2"), (2, "w1 group w2"), (3, "w1 insult w2 group"), (4, "w1 w2")], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity_fm.score_toxicity(probes, model).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0} and len(model.terms) < 6


def test_only_near_copies_share_a_group():
    rng = np.random.default_rng(5)
    bag = np.unique(rng.integers(0, 2**62, 200))
    near = np.delete(bag, [50, 90, 120])
    other = np.unique(np.r_[bag[:3], rng.integers(bag[3], 2**62, 150)])
    assert toxicity_fm.copy_groups([bag, near, other, other[:-5], bag[1:], np.empty(0, int), np.empty(0, int)]) == [0, 0, 2, 2, 4, 5, 5]


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(4)
    w, v = rng.normal(size=10), rng.normal(size=(10, 3))
    rows = [np.array([], dtype=int), np.array([2]), np.array([1, 4, 7]), np.arange(10)]
    want = [0.5 + sum(w[r]) + sum(v[i] @ v[j] for i, j in itertools.combinations(r, 2)) for r in rows]
    assert np.allclose(toxicity_fm.margins(rows, 0.5, w, v), want)


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(1, 1, 1)], 1.0), ([(1, 0, 0), (6, 0, 0), (9, 0, 0)], 0.0), ([(None, 1, 1), (3, None, None)], 0.5)])
def test_missing_classes(spark, labels, score):
    docs, table = odd_documents(spark), spark.createDataFrame(labels, LABELS)
    got = quality_compression.score_quality(docs, quality_compression.fit_compression(docs, table)).collect()
    assert [r.score for r in got] == [score] * len(ODD)
    toxic = toxicity_fm.score_toxicity(docs, toxicity_fm.fit_factor_machine(docs, table)).collect()
    assert [round(r.score, 6) for r in toxic] == [0.0 if score == 0.5 else score] * len(ODD)


def test_awkward_rows(spark):
    docs = odd_documents(spark)
    rows = [(r[0], k % 2, k % 2) for k, r in enumerate(ODD)] + [(500, 1, 1), (6, 0, 1), (6, 1, 0)]
    table = spark.createDataFrame(rows, LABELS).withColumn("text", F.lit("clash"))
    for got in (quality_compression.score_quality(docs, quality_compression.fit_compression(docs, table)),
                toxicity_fm.score_toxicity(docs, toxicity_fm.fit_factor_machine(docs, table))):
        assert got.columns == [c for c in docs.columns if c not in ("score", "predicted")] + ["score", "predicted"]
        found = got.collect()
        assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
        by_text = {}
        for r in found:
            assert by_text.setdefault(r.text or "", r.score) == r.score
    empty = no_documents(spark)
    model = quality_compression.fit_compression(docs, table)
    assert quality_compression.score_quality(empty, model).count() == 0
    assert toxicity_fm.score_toxicity(empty, toxicity_fm.fit_factor_machine(empty, table)).count() == 0
    assert quality_compression.fit_compression(empty, table).weights == ()


def test_score_ignores_everything_but_the_text(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").limit(50)
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    model = toxicity_fm.fit_factor_machine(spark.read.parquet(f"{SF_CHECK}/documents.parquet"), labels, rounds=2)
    other = docs.withColumns({"doc_id": -F.col("doc_id"), "lang": F.lit("zz"), "source": F.lit(None).cast("string")})
    a = sorted(r.score for r in toxicity_fm.score_toxicity(docs, model).collect())
    assert a == sorted(r.score for r in toxicity_fm.score_toxicity(other, model).collect())
