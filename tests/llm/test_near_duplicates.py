"""SuperMinHash and vector near-duplicates against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epispark.llm import embedding_pq, minhash_super
from epispark.llm.common import connected_components
from epispark.llm.queries import QUERIES

from conftest import SF_SMALL
from helpers import ODD, components, no_documents, odd_documents, shingles


def scalar_signature(elements, places):
    """The walk one element and one step at a time, to the end."""
    best = [None] * places
    for x in elements:
        order = list(range(places))
        for j in range(places):
            k, value = (int(v[0]) for v in minhash_super._offer(np.array([x], dtype=np.uint64), j, places))
            order[j], order[k] = order[k], order[j]
            if best[order[j]] is None or value < best[order[j]]:
                best[order[j]] = value
    return best


def test_early_stop_changes_nothing():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 5, 40, 300)]
    got = minhash_super.super_minhash(sets, 64)
    assert [g.tolist() for g in got] == [scalar_signature(s, 64) for s in sets]
    assert (minhash_super.super_minhash([np.empty(0, np.uint64)], 64) == 0xFFFFFFFF).all()


def test_estimate_is_unbiased_and_varies_less_than_independent_ranks():
    rng = np.random.default_rng(2)
    found = []
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**63, 90).astype(np.uint64))
        a, b = minhash_super.super_minhash([x[:80], x[10:]], 128)
        found.append((a == b).mean())
    true = 70 / len(x)
    assert abs(np.mean(found) - true) < 0.01
    assert np.std(found) < (true * (1 - true) / 128) ** 0.5


def test_bands_miss_under_one_in_a_million():
    rows = minhash_super.band_rows(0.8)
    assert (1 - 0.8 ** rows) ** (128 // rows) < 1e-6


def near_copies(n, words, swap, seed):
    """Chains of texts in which each swaps some words of the one before."""
    rng = np.random.default_rng(seed)
    text = [f"w{i}" for i in rng.integers(0, 10**6, words)]
    out = []
    for _ in range(n):
        out.append(" ".join(text))
        for i in rng.integers(0, words, swap):
            text[i] = f"w{rng.integers(0, 10**6)}"
    return out


def brute(rows, k, percent):
    sets = {}
    for doc, text in rows:
        if doc is not None:
            sets.setdefault(doc, []).append(shingles(text, k))
    flat = [(d, s) for d, some in sets.items() for s in some if s]
    links = [(a, b) for i, (a, s) in enumerate(flat) for b, t in flat[:i]
             if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) and 100 * len(s & t) >= percent * len(s | t)]
    return components(sets, links)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    rows = [(r[0], r[1]) for r in ODD]
    rows += [(100 + i, t) for i, t in enumerate(near_copies(40, 60, 1, 3))]       # a chain whose ends are not alike
    rows += [(200 + i, t) for i, t in enumerate(near_copies(30, 400, 3, 4))]
    rows += [(300 + i, "one and the same text of a few words") for i in range(50)]  # copies
    rows += [(400 + i, f"shared start of a short text {i} {i + 1}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash")).withColumn("n", F.lit(0))
    got = minhash_super.near_duplicates(docs, k, 80).collect()
    want = brute(rows, k, 80)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id), r
    sizes = {(d, len(shingles(t, k))) for d, t in rows}
    assert {(r.doc_id, r.n_shingles) for r in got} == sizes


def test_small_chunks_change_nothing(spark):
    """Chunks of a cluster, however small, all meet each other."""
    rows = [(i, t) for i, t in enumerate(near_copies(60, 60, 1, 7) + near_copies(20, 300, 2, 8))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_super.near_duplicates(docs, 2, 80, chunk_bytes=3000).collect()}
    assert got == brute(rows, 2, 80)


def test_near_duplicates_of_nothing(spark):
    assert minhash_super.near_duplicates(no_documents(spark)).count() == 0
    assert minhash_super.near_duplicates(odd_documents(spark).limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(i, i + 1) for i in range(300, 340)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (9, 4), (4, 9)]
    links += [tuple(map(int, rng.integers(2000, 2100, 2))) for _ in range(80)]
    df = spark.createDataFrame(links + [(None, 3)], "a long, b long")
    got = {r.id: r.component for r in connected_components(df).collect()}
    assert got == components({i for e in links for i in e}, links)


def test_query_op8(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    want = brute(rows, 2, 80)
    assert {r.doc_id: r.component_id for r in QUERIES["op8_near_duplicates"](spark, SF_SMALL).collect()} == want


def vector_rows():
    rng = np.random.default_rng(6)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(6):
            centre = rng.normal(size=16)
            for _ in range(25):
                rows.append((n, (centre + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.4])).astype(float).tolist(), label))
                n += 1
    one = rows[0][1]
    rows += [(1000 + i, one, 0) for i in range(20)] + [(1100, [2 * v for v in one], 0), (1101, one, 1), (1102, one, None)]
    rows += [(1200, None, 0), (1201, [], 0), (1202, [0.0] * 16, 0), (1203, [float("nan")] * 16, 0), (1204, [None] + one[1:], 0),
             (1205, one[:8], 0), (1206, one[:8], 0), (1207, [float("inf")] + one[1:], 0), (None, one, 0), (-3, one, 0), (-3, one, 0)]
    return rows


def brute_vectors(rows, least):
    good = []
    for doc, v, label in rows:
        if doc is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v):
            good.append((doc, label, np.array(v)))
    count = [0] * len(good)
    links = []
    for i, (a, la, v) in enumerate(good):
        for j, (b, lb, w) in enumerate(good[:i]):
            if la == lb and len(v) == len(w) and v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w)) >= least:
                count[i] += 1
                count[j] += 1
                links.append((a, b))
    comp = components({r[0] for r in rows if r[0] is not None}, links)
    return {g[0]: c for g, c in zip(good, count)}, comp


@pytest.mark.parametrize("piece,cosine", [(4096, 0.98), (7, 0.98), (7, 0.9)])
def test_vectors(spark, piece, cosine):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit("clash"))
    got = embedding_pq.near_duplicate_vectors(df, cosine, piece=piece).collect()
    count, comp = brute_vectors(rows, cosine)
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.n_links, r.component_id, r.kept) == (count.get(r.vec_id, 0), comp[r.vec_id], comp[r.vec_id] == r.vec_id)


def test_index_loses_no_link_on_random_vectors():
    """Recall of probes and codes against brute force is one."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 32))
    x = np.concatenate([x, x[:500] + rng.normal(size=(500, 32)) * 0.03])
    u = embedding_pq.unit(x)
    radius = np.sqrt(2 - 2 * 0.98)
    centres, books = embedding_pq.fit_index(u[::3], 20, 1)
    cell, codes, loss, probes = embedding_pq.assign(u, centres, books, radius)
    a, b = np.nonzero(u @ u.T >= 0.98)
    assert len(a) > 2400 and probes[a, cell[b]].all()
    decoded = centres[cell] + np.concatenate([k[codes[:, i]] for i, k in enumerate(books)], axis=1)
    assert (np.sqrt(((u[a] - decoded[b]) ** 2).sum(1)) <= radius + loss[b] + 1e-6).all()


def test_components_of_any_size(spark):
    """Squares that leave the range of doubles, and their like at other scales."""
    rows = [(i, [float(x) * scale for x in v], 1) for i, (v, scale) in enumerate(
        [((1, 2, 3), 1e200), ((1, 2, 3.001), 1e200), ((1, 2, 3), 1e-200), ((1, 2, 3), 1.0), ((3, -2, 1), 1e-310), ((3, -2, 1), 1e300), ((0, 0, 5e-324), 1.0)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_pq.near_duplicate_vectors(df).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


def test_many_cells_take_little_memory():
    """1,024 cells of 768 dimensions: no cells x cells x dimensions."""
    import tracemalloc

    rng = np.random.default_rng(2)
    x = embedding_pq.unit(rng.normal(size=(64, 768)))
    centres = embedding_pq.unit(rng.normal(size=(1024, 768)))
    books = [rng.normal(size=(16, s.stop - s.start)) for s in embedding_pq._cuts(768)]
    tracemalloc.start()
    embedding_pq.assign(x, centres, books, 0.2)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_vectors_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_pq.near_duplicate_vectors(empty).count() == 0
    bad = spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert [(r.n_links, r.component_id, r.kept) for r in embedding_pq.near_duplicate_vectors(bad).orderBy("vec_id").collect()] == [
        (0, 1, True), (0, 2, True)]
