"""Search, chat formatting, source mixing and the pipeline."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from epispark.llm import bm25_wand, chat_format, packing, source_mixing
from epispark.llm.common import held_out
from epispark.llm.queries import QUERIES
from epispark.llm.tokenizing import BYTE_BPE

from conftest import SF_CHECK, SF_SMALL
from helpers import ODD, no_documents, odd_documents


def brute_search(rows, queries, k):
    rows = [(d, Counter(re.findall(r"[^\W_]+", (t or "").lower()))) for d, t in rows if d is not None]
    mean = sum(sum(c.values()) for _, c in rows) / len(rows)
    df = Counter(w for _, c in rows for w in c)
    out = {}
    for q, text in queries:
        if q is None:
            continue
        found = []
        for d, c in rows:
            s, hit = 0.0, False
            for w in set(re.findall(r"[^\W_]+", (text or "").lower())):
                if w in c:
                    hit = True
                    s += math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
            if hit:
                found.append((-round(s, 6), d))
        out[q] = [(d, -s) for s, d in sorted(found)[:k]]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("shard", [16384, 40])
def test_search_is_exact(spark, shard):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumn("score", F.lit("clash"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    queries = [(i, t) for i, t in rows if i % 40 == 0] + [(9001, "nosuchword"), (9002, None), (9003, ""), (None, "the"), (9004, "the of")]
    asked = spark.createDataFrame(queries, "query_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = {}
    for r in bm25_wand.search(docs, asked, 7, shard).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    want = brute_search(rows, queries, 7)
    assert got.keys() == want.keys()
    for q in want:
        assert [d for d, _ in got[q]] == [d for d, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=2e-6)


def test_search_awkward_rows(spark):
    queries = [(1, "the cat"), (1000, "word another dog")]
    asked = spark.createDataFrame(queries, "query_id long, text string")
    got = [(r.query_id, r["rank"], r.doc_id) for r in bm25_wand.search(odd_documents(spark), asked, 3).orderBy("query_id", "rank").collect()]
    want = brute_search([(r[0], r[1]) for r in ODD], queries, 3)
    assert got == [(q, i + 1, d) for q in sorted(want) for i, (d, _) in enumerate(want[q])]
    assert bm25_wand.search(no_documents(spark), asked).count() == 0
    assert bm25_wand.search(odd_documents(spark), asked.limit(0)).count() == 0


def test_blocks_are_skipped():
    rng = np.random.default_rng(0)
    bags = [(np.unique(rng.integers(k % 8 * 1000, k % 8 * 1000 + 300, 40)), None) for k in range(2048)]
    bags = [(t.astype(np.int64), np.ones(len(t), dtype=np.int32)) for t, _ in bags]
    index = bm25_wand.Shard(list(range(2048)), list(bags), 40.0)
    query = bags[17][0]
    ids, scores, scored = index.search(query, np.ones(len(query)), 5)
    full = sorted((-round(float(np.isin(t, query).sum() * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(t) / 40))), 6), i) for i, (t, _) in enumerate(bags))
    assert ids.tolist() == [i for _, i in full[:5]] and np.allclose(scores, [-s for s, _ in full[:5]])
    assert scored < index.blocks / 4


def test_documents_are_skipped_by_what_frequent_terms_can_add():
    """Sixty light terms, forty in each document, and a few heavy ones: the
    light ones alone bring no document among the best, and few are completed."""
    rng = np.random.default_rng(4)
    bags = [np.unique(np.r_[rng.choice(60, 40, False), 1000 + rng.integers(0, 400, 6)]) for _ in range(2048)]
    weight = np.where(np.arange(1400) < 60, 0.05, 5.0)
    index = bm25_wand.Shard(list(range(2048)), [(t, np.ones(len(t), dtype=np.int32)) for t in bags], 45.0)
    for query in bags[:20]:
        ids, scores, scored = index.search(query, weight[query], 3)
        full = sorted((-round(float(weight[np.intersect1d(t, query)].sum() * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(t) / 45))), 6), i) for i, t in enumerate(bags))
        assert ids.tolist() == [i for _, i in full[:3]] and np.allclose(scores, [-s for s, _ in full[:3]])
        assert scored < 0.6 * index.blocks


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.lists(st.sampled_from(range(24)), max_size=30)), min_size=1, max_size=60), st.integers(1, 12))
def test_shard_search_is_a_full_search(rows, k):
    """Ids occur again, texts are copied, terms are in all documents or one."""
    bags = [tuple(np.unique(np.array(t, dtype=np.int64) ** 2, return_counts=True)) for _, t in rows]
    index = bm25_wand.Shard([i for i, _ in rows], list(bags), 8.0)
    for query, _ in [*bags[:3], (np.arange(600), None)]:
        weight = 1 + query % 7
        full = []
        for (i, _), (t, c) in zip(rows, bags):
            mine = np.isin(t, query)
            if mine.any():
                full.append((-round(float(((1 + t % 7) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * c.sum() / 8)))[mine].sum()), 6), i))
        ids, scores, _ = index.search(query, weight.astype(float), k)
        assert np.allclose(scores, [-s for s, _ in sorted(full)[:k]], atol=2e-6) and len(ids) == min(k, len(full))
        assert ids.tolist() == [i for _, i in sorted((-s, i) for i, s in zip(ids.tolist(), scores))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(alphabet=st.sampled_from("abZ '.:_9\u03a3\u0130\u00c9\u00df\u2019\u2164\u00b2\u0663\u0085\n"), max_size=30)), max_size=5), st.integers(1, 60))
def test_terms_of_a_column_are_those_of_each_text(rows, most):
    rows = [t and t.encode("utf-8", "ignore").decode() for t in rows]
    got = list(bm25_wand.bags_of(pa.array(["before", *rows, "after"], pa.string()).slice(1, len(rows)), most))
    assert len(got) == len(rows)
    for t, (terms, counts) in zip(rows, got):
        want = Counter(xxhash.xxh64_intdigest(w) >> 1 for w in re.findall(r"[^\W_]+", (t or "").lower()))
        assert terms.dtype == np.int64 and counts.dtype == np.int32
        assert list(zip(terms.tolist(), counts.tolist())) == sorted(want.items())


def test_terms_are_hashed_once_a_batch(monkeypatch):
    cut, hashed = [], []
    pattern, digest = bm25_wand._TERM, xxhash.xxh64_intdigest
    monkeypatch.setattr(bm25_wand, "_TERM", type("Pattern", (), {"findall": staticmethod(lambda t: cut.append(t) or pattern.findall(t))}))
    monkeypatch.setattr(bm25_wand.xxhash, "xxh64_intdigest", lambda w: hashed.append(w) or digest(w))
    got = list(bm25_wand.bags_of(pa.array([f"Word, word; (WORD) word's caf\u00e9 {'x' * (i % 2)}" for i in range(600)])))
    assert len(got) == 600 and got[0][1].sum() == 6 and cut == ["caf\u00e9"] and sorted(hashed) == ["caf\u00e9", "s", "word", "x"]


CHAT = st.lists(st.sampled_from([*chat_format.CONTROLS, "\\", "#", "<", "/turn>", " ", "\n", "ok", "é漢", ":", "### ", "<|endoftext|>"]), max_size=8).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "tool", "User", ""]), CHAT), CHAT), max_size=4))
def test_formatted_string_round_trip(turns):
    assert chat_format.parse(chat_format.formatted(turns)) == turns
    for _, text in turns:
        assert chat_format.unescape(chat_format.escape(text)) == text


def test_chat_format(spark, tmp_dir):
    odd = [chat_format.CONTROLS[2] + "\\\\" + chat_format.CONTROLS[6], "\\### User:\\", "", None, "é漢 \n", "<|endoftext|>"]
    rows = [(c, t, r, odd[(c + t) % len(odd)]) for c in range(8) for t, r in enumerate(["system", "user", "assistant", "narrator </role>", None, "assistant"])]
    rows += [(9, None, "user", "first"), (9, 1, "user", "b"), (9, 1, "user", "a"), (9, 1, "assistant", "z"), (9, 1, "user", "a"),
             (None, 0, "assistant", "no id"), (0x7FFFFFFF0, 0, "assistant", "long " * 20000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit("clash")).withColumn("position", F.lit(0))
    segments = chat_format.format_conversations(df)
    segments.write.parquet(f"{tmp_dir}/chat")
    written = spark.read.parquet(f"{tmp_dir}/chat")
    got = {r.conv_id: r for r in chat_format.read_conversations(written).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns = [(r, x) for _, r, x in sorted(turns)]
        said = "".join(x for r, x in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(said),
                hashlib.sha256(said.encode()).hexdigest(), len(chat_format.formatted(turns)))
        assert tuple(got[c])[1:] == want
    # offsets are the running sums of the segments before
    for c in by:
        at = chars = 0
        for r in written.where(F.col("conv_id").eqNullSafe(F.lit(c).cast("long"))).orderBy("position").collect():
            assert (r.token_start, r.char_start, r.n_ids, len(r.loss_mask)) == (at, chars, len(r.ids), len(r.ids))
            at, chars = at + r.n_ids, chars + r.n_chars
    base = chat_format.ChatTokenizer(BYTE_BPE).base
    for r in written.collect():  # reserved ids frame a segment and occur nowhere else
        assert r.ids[-1] == base + chat_format.TURN_END and sum(i >= base for i in r.ids) == (2 if r.ids[0] != base + chat_format.OTHER else 3)
    empty = df.limit(0)
    assert chat_format.read_conversations(chat_format.format_conversations(empty)).count() == 0


def test_rake_meets_the_marginals():
    rng = np.random.default_rng(1)
    cells = rng.integers(50, 1000, (6, 4, 5)).astype(float)
    targets = [rng.dirichlet(np.full(n, 20.0)) for n in cells.shape]
    keep = source_mixing.rake(cells, targets)
    kept = cells * keep
    assert keep.min() >= 0 and keep.max() <= 1
    for d, t in enumerate(targets):
        assert np.abs(source_mixing._marginal(kept, d) / kept.sum() - t).max() < 0.011
    limit = min((source_mixing._marginal(cells, d) / t).min() for d, t in enumerate(targets))
    assert kept.sum() > 0.8 * limit  # as many tokens as the scarcest category allows


def test_raking_equals_plain_proportional_fitting_when_nothing_runs_out():
    rng = np.random.default_rng(2)
    cells = rng.integers(50, 1000, (4, 3)).astype(float)
    targets = [np.full(4, 0.25), np.array([0.5, 0.3, 0.2])]
    weight, error = source_mixing._fit(cells, targets, cells.sum() / 1000)
    plain = cells.copy()
    for _ in range(200):
        plain *= (targets[0] / plain.sum(1))[:, None]
        plain *= targets[1] / plain.sum(0)
    kept = cells * weight
    assert error < 1e-5 and np.allclose(kept / kept.sum(), plain / plain.sum(), atol=1e-5)


def test_empty_cells_and_shares():
    keep = source_mixing.rake(np.array([[5.0, 0.0], [0.0, 7.0]]), [np.array([0.5, 0.5]), np.array([0.5, 0.5])])
    assert np.allclose(keep * [[5, 0], [0, 7]], [[5, 0], [0, 5]], rtol=0.1)
    assert not source_mixing.rake(np.zeros((2, 2)), [np.full(2, 0.5)] * 2).any()
    got = source_mixing.shares({"a": 10.0, "(rest)": 30.0}, {"a": 0.4, "gone": 0.2})
    assert got.keys() == {"a", "(rest)"} and all(math.isclose(v, 0.5) for v in got.values())
    got = source_mixing.shares({"a": 64.0, "b": 1.0}, 0.5)
    assert math.isclose(got["a"], 8 / 9) and math.isclose(sum(got.values()), 1)


def test_mixing_draws_to_the_targets(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").unionByName(
        spark.read.parquet("/root/testdata/sf0.1/documents.parquet").withColumn("doc_id", F.col("doc_id") + 10**6)).withColumn("topic", F.lit("clash"))
    model = source_mixing.fit_topics(docs)
    targets = {"source": {"src0": 0.1, "src1": 0.05}, "lang": {"en": 0.4, "de": 0.3}}
    out = source_mixing.mix(docs, targets, model)
    assert set(out.columns) == {*docs.columns, "tokens", "probability"}
    rows = out.select("doc_id", "source", "lang", "tokens", "probability").collect()
    total = sum(r.tokens for r in rows)
    for column, value, share in (("source", "src0", 0.1), ("source", "src1", 0.05), ("lang", "en", 0.4), ("lang", "de", 0.3)):
        assert abs(sum(r.tokens for r in rows if r[column] == value) / total - share) < 0.04
    # a document's draw depends on its id alone: sampled again, the same come
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in source_mixing.mix(docs.orderBy("text"), targets, model).collect())


def test_small_categories_get_their_own_targets(spark):
    """A hot source and a hundred sources and languages below 1 %: an exponent
    lifts each of the small ones."""
    rows = [(i, "some words here", "aa" if i % 3 else f"l{i % 200}", "hot" if i < 15000 else f"s{i % 100}") for i in range(45000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    annotated = docs.withColumn("tokens", F.lit(3).cast("long"))
    plan, goal = source_mixing.mixing_plan(annotated, {"source": 0.5, "lang": 0.8})
    observed = Counter(r[3] for r in rows)
    whole = sum((v / 45000) ** 0.5 for v in observed.values())
    assert len(goal["source"]) == 101 and len(goal["lang"]) > 100
    for k, v in observed.items():
        assert math.isclose(goal["source"][k], (v / 45000) ** 0.5 / whole)
    keep = {(r["cell_source"], r["cell_lang"]): r["probability"] for r in plan.to_pylist()}
    kept = Counter()
    for r in rows:
        kept[r[3]] += keep[r[3], r[2]]
    total = sum(kept.values())
    assert sum(abs(kept[k] / total - v) for k, v in goal["source"].items()) / 2 < 0.006
    assert kept["hot"] / total < 0.08 and total > 15000


def test_slow_fits_are_not_taken_for_inevitable_errors(caplog):
    cells, targets = np.array([[1.0, 0.001], [0.001, 1.0]]) * 1e6, [np.array([0.5, 0.5]), np.array([0.6, 0.4])]
    assert source_mixing._fit(cells, targets, 1.0)[1] < 1e-3
    with caplog.at_level("INFO", source_mixing.__name__):
        kept = cells * source_mixing.rake(cells, targets)
    assert np.allclose(kept.sum(0) / kept.sum(), targets[1], atol=0.011) and kept.sum() > 0
    assert "kept tokens in wrong categories" in caplog.text


def test_totals_that_cannot_be_met_stay_finite():
    """Many rare categories in few cells, far from their targets."""
    rng = np.random.default_rng(0)
    at = [np.unique(np.minimum(rng.zipf(a, 20000), 2000), return_inverse=True)[1] for a in (1.3, 1.5)]
    cells = rng.pareto(1.2, 20000) * 1000 + 1
    targets = [(t := np.bincount(i, cells) ** e) / t.sum() for i, e in zip(at, (0.5, 0.8))]
    with np.errstate(over="raise", invalid="raise"):
        kept = cells * source_mixing.rake(cells, targets, at=at)
    assert 0 < kept.sum() < cells.sum()
    for i, t in zip(at, targets):
        # 0.0030 is what plain fitting is left with after 5,000 rounds
        assert np.abs(np.bincount(i, kept, len(t)) / kept.sum() - t).sum() / 2 < 0.0030 + 0.006


def test_sparse_places_rake_as_the_dense_table():
    rng = np.random.default_rng(6)
    cells = rng.integers(50, 1000, (6, 4, 5)) * (rng.random((6, 4, 5)) < 0.6) * 1.0
    targets = [rng.dirichlet(np.full(n, 20.0)) for n in cells.shape]
    at = [i.astype(np.int64) for i in np.nonzero(cells)]
    assert np.allclose(source_mixing.rake(cells[cells > 0], targets, at=at), source_mixing.rake(cells, targets)[cells > 0], atol=1e-3)


def test_topics_are_fitted_on_all_distinct_documents(spark):
    """Centres and language means are those of plain k-means over all distinct
    documents: 3,000 texts, 30 of them in a rare language, and 3,000 copies of
    one text, which count once."""
    rng = np.random.default_rng(8)
    vocabulary = [[f"{'abcd'[k]}{'abcdefghijklmnopqrst'[j]}" for j in range(20)] for k in range(4)]
    rows = [(i, " ".join(rng.choice(vocabulary[i % 4], 30)) + f" z{'abcdefghij'[i // 300]}{'abcdefghij'[i // 30 % 10]}", "rr" if i % 100 == 0 else "aa") for i in range(3000)]
    rows += [(3000 + i, "one text said again", "aa") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    model = source_mixing.fit_topics(docs, topics=4, slots=128)
    assert model.languages == ("aa", "rr")
    distinct = sorted({(t, v) for _, t, v in rows})
    x = source_mixing._slot_counts([t for t, _ in distinct], 128)
    languages = [v for _, v in distinct]
    means = np.frombuffer(model.means, "<f8").reshape(-1, 128)
    for i, name in enumerate(model.languages):
        assert np.allclose(means[i], x[[v == name for v in languages]].mean(0))
    x = source_mixing._less_language(x, languages, model.languages, means)
    centres = np.frombuffer(model.centres, "<f8").reshape(4, 128)
    topic = (x @ centres.T).argmax(1)
    for k in range(4):  # a fixed point of k-means over all of them
        total = x[topic == k].sum(0)
        assert np.allclose(centres[k], total / np.sqrt((total * total).sum()), atol=0.02)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(alphabet=st.sampled_from("abZ '.:_9\u03a3\u0130\u00c9\u00df\u2019\u2164\u00b2\u0663\u0085\n"), max_size=30)), max_size=5))
def test_word_counts_are_those_of_each_text(rows):
    rows = [t and t.encode("utf-8", "ignore").decode() for t in rows]
    for column in (pa.array(["before", *rows, "after"], pa.string()).slice(1, len(rows)), pa.array(rows, pa.large_string())):
        got = source_mixing._counts(column, 4096)
        assert got.shape == (len(rows), 4096)
        for t, n in zip(rows, got):
            slots = [xxhash.xxh32_intdigest(w) % 4096 for w in re.findall(r"[^\W\d_]+", (t or "").lower())]
            assert n.tolist() == np.bincount(np.array(slots, dtype=np.int64), minlength=4096).tolist(), t


def test_words_are_hashed_once_a_batch(monkeypatch):
    """The pattern sees distinct strings with letters beyond ASCII only, and a
    word is hashed once however often and in whichever case texts say it."""
    cut, hashed = [], []
    pattern, digest = source_mixing._WORD, xxhash.xxh32_intdigest
    monkeypatch.setattr(source_mixing, "_WORD", type("Pattern", (), {"findall": staticmethod(lambda t: cut.append(t) or pattern.findall(t))}))
    monkeypatch.setattr(source_mixing.xxhash, "xxh32_intdigest", lambda w: hashed.append(w) or digest(w))
    x = source_mixing._slot_counts([f"Word, word; (WORD) word's caf\u00e9 {'x' * (i % 2)}" for i in range(600)], 512)
    assert x.shape == (600, 512) and [t for t in cut if t] == ["caf\u00e9"]
    assert sorted(hashed.count(w) for w in ("word", "s", "x")) == [1, 1, 1] and len(hashed) < 10


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(alphabet=st.sampled_from("ab .\u00e9\u2019\u6f22\U0001f600\x1c\x1f\u0085\u00a0\u1680\u2003\u2028\u205f\u3000\u200b\n"), max_size=30)), max_size=6))
def test_tokens_are_those_of_split(rows):
    rows = [t and t.encode("utf-8", "ignore").decode() for t in rows]
    for column in (pa.array(["before", *rows, "after"], pa.string()).slice(1, len(rows)), pa.array(rows, pa.large_string())):
        assert source_mixing._tokens(column).tolist() == [len((t or "").split()) for t in rows]


def test_stored_counts_come_back():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 90000, (50, 300)) * (rng.random((50, 300)) < 0.1)
    counts[[0, 7, 49]] = 0
    stored = source_mixing._stored(counts)
    assert stored.type == pa.binary() and pa.concat_arrays([stored]).validate(full=True) is None
    for lo, hi in ((0, 50), (3, 20), (7, 8), (9, 9)):
        assert np.array_equal(source_mixing._loaded(stored.slice(lo, hi - lo), 300), source_mixing._unit(counts[lo:hi].astype(float)))


def test_only_texts_with_wide_spaces_are_split_one_by_one():
    """Neither other characters beyond ASCII nor quotation marks make a text
    go through Python's split."""
    column = pa.array(["caf\u00e9 \u2019x\u2019 \u6f22\u5b57 y"] * 500 + ["a\u00a0b c"])

    class Seen:
        def __init__(self):
            self.read = []

        def __getitem__(self, i):
            self.read.append(i)
            return column[i]

        def __getattr__(self, name):
            return getattr(column, name)

        def __len__(self):
            return len(column)

    seen = Seen()
    assert source_mixing._tokens(seen).tolist() == [4] * 500 + [3] and seen.read == [500]


def test_mixing_awkward_rows(spark):
    docs = odd_documents(spark)
    model = source_mixing.fit_topics(docs)
    out = source_mixing.mix(docs, {"source": 1.0, "lang": 1.0, "topic": 1.0}, model).collect()
    assert len(out) == len(ODD)  # the observed shares as targets keep everything
    assert all(r.probability > 0.99 for r in out)
    empty = no_documents(spark)
    assert source_mixing.mix(empty, {"lang": {"en": 1.0}}, source_mixing.fit_topics(empty)).count() == 0


def test_query_op9(spark):
    got = QUERIES["op9_source_mix"](spark, SF_CHECK).collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()}
    assert {r.doc_id for r in got} <= ids and len({r.doc_id for r in got}) == len(got) > len(ids) / 10
    assert all(0 < r.probability <= 1 for r in got)


def test_query_op9_meets_its_marginals(spark):
    """Tokens drawn of the real table, by language and source, beside their targets."""
    large = "/root/testdata/sf0.1"
    got = QUERIES["op9_source_mix"](spark, large).groupBy("lang", "source").agg(F.sum("tokens").alias("tokens")).collect()
    total = sum(r.tokens for r in got)
    for lang, target in {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}.items():
        assert abs(sum(r.tokens for r in got if r.lang == lang) / total - target) < 0.03, lang
    words = spark.read.parquet(f"{large}/documents.parquet").groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()
    root = {r.source: r.n ** 0.5 for r in words}
    for source, r in root.items():
        assert abs(sum(x.tokens for x in got if x.source == source) / total - r / sum(root.values())) < 0.03, source


def test_rows_of_one_query_id_are_one_query(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha delta"), (3, "beta beta zeta")], "doc_id long, text string")
    once = spark.createDataFrame([(7, "alpha beta zeta")], "query_id long, text string")
    many = spark.createDataFrame([(7, "alpha beta"), (7, "alpha beta"), (7, "zeta alpha")], "query_id long, text string")
    assert sorted(map(tuple, bm25_wand.search(docs, many).collect())) == sorted(map(tuple, bm25_wand.search(docs, once).collect()))


def test_pipeline_keeps_one_row_of_copies(spark, tmp_dir):
    """Of equal texts one row stays, that with the least id, whatever rows
    share an id or have none; rows without words all stay."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(9, text), (9, text), (4, text + " more"), (None, text), (None, text), (None, "a text alone without an id"), (5, "another text of its own here"),
            (5, "yet another text under the same id"), (6, ""), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, tmp_dir)
    assert kept.columns == docs.columns
    want = [(4, text + " more"), (None, "a text alone without an id"), (5, "another text of its own here"), (5, "yet another text under the same id"), (6, ""), (6, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_pipeline(spark):
    """Each stage keeps a subset of whole rows; the last one packs all of them."""
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()}
    before = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, SF_CHECK), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert all(before[d] == r for d, r in after.items()) and docs.count() == len(after)
        gone = [labels[d] for d in before.keys() - after.keys() if d in labels]
        if name == "quality":
            assert sum(g.quality == 0 for g in gone) > 0.8 * len(gone) and len(after) > 0.75 * len(before)
        if name == "toxicity":
            assert sum(g.toxic for g in gone) > 0.8 * len(gone) and len(after) > 0.85 * len(before)
        assert 0 < len(after) < len(before)
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_CHECK)
    assert {r.doc_id for r in last.select("doc_id").collect()} == set(before)


def test_pipeline_rejects_labelled_documents(spark):
    """Of the evaluation fold nearly all bad and most toxic documents go and
    the others stay; the toxicity stage rejects whatever op10 does."""
    large = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{large}/documents.parquet")
    fold = spark.read.parquet(f"{large}/labels.parquet").where(held_out(F.col("doc_id"))).collect()
    for stage, bad, least in ((corpus_pipeline.quality, lambda r: r.quality == 0, 0.95), (corpus_pipeline.toxicity, lambda r: r.toxic == 1, 0.8)):
        kept = {r.doc_id for r in stage(spark, docs, large).select("doc_id").collect()}
        assert np.mean([r.doc_id not in kept for r in fold if bad(r)]) >= least
        assert np.mean([r.doc_id not in kept for r in fold if not bad(r)]) < 0.01
    op10 = QUERIES["op10_toxicity"](spark, large).where("predicted = 0").collect()
    assert kept == {r.doc_id for r in op10}


def test_pipeline_awkward_rows(spark, tmp_dir):
    spark.createDataFrame([(1, 1, 0), (2, None, None), (6, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    for docs in (odd_documents(spark), no_documents(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, tmp_dir)
            if name != "packing":
                assert out.columns == docs.columns
            out.collect()
