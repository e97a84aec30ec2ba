"""Quotient filters against dictionaries; phrases against brute force."""

import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from epispark.llm import collocations
from epispark.llm import quotient_filter as qf
from epispark.llm.queries import QUERIES

from conftest import SF_SMALL
from helpers import no_documents, odd_documents

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=2000, absorb=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                f.update((lang, *w[i:i + size]) for i in range(len(w) - size + 1))
    found = {}
    for (lang, *p), a in f.items():
        if len(p) > 1 and a >= least:
            cuts = [(10**6 * a * a // (f[(lang, *p[:k])] * f[(lang, *p[k:])]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, tuple(p)] = (score, a, f[(lang, *p[:k])], f[(lang, *p[k:])])
    gone = {(lang, q) for (lang, p), (_, a, *_) in found.items() if len(p) == 3 for q in (p[:2], p[1:])
            if (lang, q) in found and 100 * a >= absorb * found[lang, q][1]}
    out = []
    for lang in n:
        kept = sorted((-s, -a, " ".join(p).encode(), a, l, r) for (x, p), (s, a, l, r) in found.items() if x == lang and (x, p) not in gone)
        out += [(lang, i + 1, p.decode(), a, l, r, n[lang], -s) for i, (s, _, p, a, l, r) in enumerate(kept[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("bits", [1, 3, 8, 9, 24, 51, 63, 64])
def test_filter_is_lossless_and_counts(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 40, 3000):
        keys = np.unique(rng.integers(0, 2**min(bits, 63), n).astype(np.uint64))
        counts = np.where(rng.random(len(keys)) < 0.6, 1, rng.integers(1, 2**45, len(keys)))
        data = qf.build(keys, counts, bits)
        back = qf.read(data)
        assert back[0].tolist() == keys.tolist() and back[1].tolist() == counts.tolist()
        known = dict(zip(keys.tolist(), counts.tolist()))
        for x in [*keys[:5].tolist(), *rng.integers(0, 2**min(bits, 63), 5).tolist()]:
            assert qf.count(data, x) == known.get(x, 0)


@pytest.mark.parametrize("bits", [3, 24, 51, 64, 75, 126])
def test_permutation_is_inverted(bits):
    p = qf.Permutation(bits)
    rng = np.random.default_rng(bits)
    high, low = rng.integers(0, 2**p.high_bits, 500, dtype=np.uint64), rng.integers(0, 2**p.low_bits, 500, dtype=np.uint64)
    there = p.forward(high, low)
    back = p.back(*there)
    assert back[0].tolist() == high.tolist() and back[1].tolist() == low.tolist()
    assert int(there[0].max()) <= int(p.high) and int(there[1].max()) <= int(p.low)


@pytest.mark.parametrize("bits", [1, 2, 17, 21, 22, 42])
def test_ids_are_packed_and_unpacked(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, min(2**bits, 2**62), 200).astype(np.uint64)
    got = Counter(zip(*(x.tolist() for x in collocations._unpacked(*collocations._packed(ids, bits), bits))))
    x = ids.tolist()
    want = Counter((*p, 0) for p in zip(x, x[1:]) if all(p)) + Counter(p for p in zip(x, x[1:], x[2:]) if all(p))
    assert got == want


def test_a_filter_takes_few_bytes():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**45, 200_000).astype(np.uint64))
    assert len(qf.build(keys, np.ones(len(keys), np.int64), 45)) < 4.5 * len(keys)


def test_merging_filters_adds_counts():
    rng = np.random.default_rng(3)
    total, filters = Counter(), []
    for _ in range(20):
        part = Counter(rng.integers(0, 500, 300).tolist())
        total += part
        keys = sorted(part)
        filters.append(qf.build(np.array(keys, np.uint64), np.array([part[k] for k in keys]), 12))
    m = qf.Merger(waiting=50)
    for f in filters:
        m.add(f)
    for keys, counts in (m.total(), qf.merged(filters)):
        assert dict(zip(keys.tolist(), counts.tolist())) == total


def test_query_equals_brute_force(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("lang", "text").collect()]
    got = rows_of(QUERIES["op12_collocations"](spark, SF_SMALL))
    assert len(got) > 100 and got == brute(rows)


def test_levels_blocks_and_ties(spark):
    """Many levels, small blocks and tasks, ties in the score, a cut top."""
    rng = np.random.default_rng(5)
    words = ["ab", "Cd", "é", "x y", " ", "...", "f,g", "\t", "n", "o\rp"]
    rows = [(lang, " ".join(rng.choice(words, rng.integers(0, 60)))) for lang in ("en", None, "und", "xx") for _ in range(30)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for top in (7, 2000):
        got = rows_of(collocations.collocations(df, 3, top, 50, range_entries=8, level_bits=2, entries=64))
        assert got == brute(rows, 3, top)


def test_blocks_hold_whole_texts_and_long_ones(spark):
    docs = odd_documents(spark).select("lang", "text")
    blocks = collocations.encoded_blocks(docs.coalesce(1), 60).collect()
    assert sum(len(b.codes) // b.width for b in blocks if b.lang == "en") >= 30000
    assert {b.lang for b in blocks} == {"en", "xx"} and len({b.block for b in blocks}) == len(blocks)


def test_odd_and_empty(spark):
    docs = odd_documents(spark, ["lang_id", "a", "l", "r", "n", "phrase"])
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert rows_of(collocations.collocations(docs, 2)) == brute(rows, 2)
    assert collocations.collocations(no_documents(spark)).count() == 0
    assert collocations.collocations(docs.where("text is null or text = ''")).count() == 0


def test_large_counts_are_exact(spark):
    df = spark.createDataFrame([(10**16 - 1, 10**16 - 1, 10**16), (3, 5, 7)], "a long, l long, r long")
    got = [r.s for r in df.select(collocations._score("a", "l", "r").alias("s")).collect()]
    assert got == [10**6 * a * a // (l * r) for a, l, r in ((10**16 - 1, 10**16 - 1, 10**16), (3, 5, 7))]


def block_batch(codes, ids):
    """One block as the filter tasks read it: code k + 1 stands for ids[k]."""
    return pa.RecordBatch.from_arrays([
        pa.array([4], pa.int32()), pa.array([np.asarray(codes, "<u4").tobytes()], pa.binary()),
        pa.array([list(range(len(ids)))], pa.list_(pa.int32())), pa.array([list(ids)], pa.list_(pa.int64()))],
        names=["width", "codes", "at", "id"])


def phrases_of(filters, bits, shard_bits):
    """Counts of phrases of (shard, filter) pairs."""
    map_, out = qf.Permutation(3 * bits), Counter()
    for shard, data in filters:
        keys, counts = qf.read(data)
        key = [(shard << 3 * bits - shard_bits) | k for k in keys.tolist()]
        high = np.array([k >> map_.low_bits for k in key], np.uint64)
        ids = collocations._unpacked(*map_.back(high, np.array([k & int(map_.low) for k in key], np.uint64)), bits)
        for p, c in zip(zip(*(x.tolist() for x in ids)), counts.tolist()):
            out[p] += c
    return out


def filters_of(batches):
    return [(b.column(0)[0].as_py(), b.column(1)[0].as_py()) for b in batches]


def peak_of(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("bits,shard_bits", [(4, 0), (4, 3), (17, 7), (21, 9), (25, 11), (42, 62)])
def test_long_blocks_in_pieces(bits, shard_bits):
    """Phrases over the edges of a piece count once, whatever its size."""
    rng = np.random.default_rng(bits)
    codes = np.append(rng.integers(0, 9, 299), 8)
    ids = rng.integers(1, 1 << bits, 8) if bits > 4 else np.arange(1, 9)
    x = np.append(0, ids)[codes].tolist()
    want = Counter((*p, 0) for p in zip(x, x[1:]) if all(p)) + Counter(p for p in zip(x, x[1:], x[2:]) if all(p))
    for words, entries in ((1, 1), (2, 40), (7, 10**6), (299, 50), (300, 10**6)):
        work = collocations._block_filters(bits, shard_bits, entries, words)
        assert phrases_of(filters_of(work(iter([block_batch(codes, ids)] * 2))), bits, shard_bits) == Counter({p: 2 * c for p, c in want.items()})


def test_a_filter_task_needs_little_beyond_its_entries():
    """Entries take 14 bytes held, and 24 in copies while they were sorted."""
    rng = np.random.default_rng(11)
    entries, n = 1 << 20, 1 << 16
    batches = [block_batch(np.append(rng.integers(1, n + 1, 40_000), n), rng.permutation(n) + 1) for _ in range(12)]
    seen = []

    def work():
        for b in collocations._block_filters(17, 7, entries)(iter(batches)):
            seen.append(b.column(0)[0].as_py())

    assert peak_of(work) < 45 * entries
    assert len(seen) == 128


def test_a_long_block_needs_little():
    rng = np.random.default_rng(12)
    batch = block_batch(rng.integers(1, 101, 1 << 20), np.arange(1, 101))

    def work():
        for _ in collocations._block_filters(7, 4, 1 << 21)(iter([batch])):
            pass

    assert peak_of(work) < 64 << 20


def some_filters(number, n, seed):
    rng = np.random.default_rng(seed)
    parts = [np.unique(rng.integers(0, 2**44, n).astype(np.uint64)) for _ in range(number)]
    return parts, [qf.build(k, np.ones(len(k), np.int64), 44) for k in parts]


def test_a_merger_needs_little_beyond_its_entries():
    parts, filters = some_filters(64, 1 << 14, 13)
    total = 0

    def work():
        nonlocal total
        m = qf.Merger()
        for f in filters:
            m.add(f)
        total = sum(int(c.sum()) for _, c in m.pieces())

    assert peak_of(work) < 45 * sum(map(len, parts))
    assert total == sum(map(len, parts))


def test_pieces_are_the_total_in_order():
    parts, filters = some_filters(9, 700, 14)
    for waiting, piece in ((1, 1), (50, 64), (3000, 1 << 18)):
        m = qf.Merger(waiting, piece)
        for f in [*filters, filters[0], qf.build(np.zeros(0, np.uint64), np.zeros(0, np.int64), 44)]:
            m.add(f)
        keys, counts = (np.concatenate(x) for x in zip(*m.pieces()))
        want = Counter(np.concatenate([*parts, parts[0]]).tolist())
        assert keys.tolist() == sorted(want) and counts.tolist() == [want[k] for k in keys.tolist()]
    assert [len(k) for k, _ in qf.Merger().pieces()] == [0]


def test_a_large_range_is_split_in_parts():
    """A range of a first level may hold more than a task: it goes on in parts of bounded size."""
    parts, filters = some_filters(40, 500, 15)
    batch = pa.RecordBatch.from_arrays([pa.array([3] * 25 + [8] * 15, pa.int64()), pa.array(filters, pa.binary())], names=["shard", "filter"])
    got = {3: Counter(), 8: Counter()}
    for shard, m in collocations._merged_ranges(iter([batch.slice(0, 10), batch.slice(10)]), 2000):
        assert 0 < len(m) < 2500
        got[shard].update(dict(zip(*(x.tolist() for x in m.total()))))
    assert got == {3: Counter(np.concatenate(parts[:25]).tolist()), 8: Counter(np.concatenate(parts[25:]).tolist())}
    assert [shard for shard, _ in collocations._merged_ranges(iter([batch]))] == [3, 8]
