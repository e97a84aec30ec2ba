"""Token-id files, packing and token counts against the libraries themselves."""

import glob
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from epispark.llm import packing, token_binary, token_counts
from epispark.llm.queries import QUERIES
from epispark.llm.tokenizing import BYTE_BPE, PIECE_BPE, WORD_BPE, PieceCounter, WordEncoder

from conftest import SF_SMALL
from helpers import ODD, no_documents, odd_documents

TOK = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
WORDS = WordEncoder(WORD_BPE)
PIECES = PieceCounter(PIECE_BPE)


def ids_of(text, end):
    return [*TOK.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_words_encode_as_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(WORDS.encode(text), WORDS.dtype).tolist() == TOK.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(alphabet=st.sampled_from("abZsT  \n.,'<|>!019-_éÀ×ªΣ漢\u0085\x1c\x00"), max_size=30)), max_size=6))
def test_columns_encode_as_the_library(rows):
    rows = [t and t.encode("utf-8", "ignore").decode() for t in rows]
    for column in (pa.array(["<|endoftext|> be", *rows, "after"], pa.string()).slice(1, len(rows)), pa.array(rows, pa.large_string())):
        ids, ends = WORDS.encode_column(column)
        got = [ids[lo:hi].tolist() for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist())]
        assert got == [TOK.encode(t or "", add_special_tokens=False).ids for t in rows] and len(ids) == sum(map(len, got))


def test_pieces_of_a_batch_are_looked_up_once():
    """A word's case and the signs about it bring no entries of their own."""
    enc = WordEncoder(WORD_BPE)
    before = ["Word, word; (WORD) word. word's 12", "word-word 12word <|endoftext|>"] * 50
    ids, ends = enc.encode_column(pa.array(before))
    assert ids[:ends[1]].tolist() == [i for t in before[:2] for i in TOK.encode(t, add_special_tokens=False).ids]
    assert sorted(enc.words) == sorted(["word", ",", ";", "(", ")", ".", "word's", "1", "2", "-", "<|endoftext|>"])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t▁aé.,'x3<>|s ﬁ漢"), max_size=40))
def test_pieces_add_up(text):
    assert PIECES.additive
    assert sum(map(PIECES.unit, PIECES.units(text))) == PIECES.whole(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=700))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    seq = token_binary.EliasFano.from_bytes(token_binary.EliasFano.of(np.array(values, dtype=np.uint64)).to_bytes())
    assert seq.values().tolist() == values
    for i in {0, len(values) // 2, len(values) - 1} if values else ():
        assert seq.select(i) == values[i]
    with pytest.raises(IndexError):
        seq.select(len(values))


def test_elias_fano_is_near_minimal():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 4000, 100_000))
    size = len(token_binary.EliasFano.of(ends).to_bytes())
    assert size * 8 < len(ends) * (2.3 + np.log2(ends[-1] / len(ends)))  # a 64-bit table takes 64 a value


@pytest.mark.parametrize("block_ids", [1 << 24, 500])
def test_token_files(spark, tmp_dir, block_ids):
    docs = odd_documents(spark)
    path = f"{tmp_dir}/files"
    token_binary.write_token_files(docs, path, WORD_BPE, 1, block_ids)
    got = token_binary.read_token_files(spark, path).toPandas().sort_values("start")
    want = sorted((r[0] is not None, r[0] or 0, *((ids := ids_of(r[1], 1)), len(ids))[1:], crc(ids)) for r in ODD)
    assert sorted((d == d and d is not None, int(d) if d == d and d is not None else 0, n, c)
                  for d, n, c in zip(got.doc_id, got.n_tokens, got.ids_crc32)) == want
    assert got.start.tolist() == (got.n_tokens.cumsum() - got.n_tokens).tolist()
    known = [int(d) for d in got.doc_id if d == d]
    assert known == sorted(known) and got.doc_id.isna().iloc[0]
    # random access straight from a file
    data = open(sorted(glob.glob(f"{path}/part-*"))[-1], "rb").read()
    assert data.endswith(token_binary.MARK.encode())
    block = token_binary.Block(data)
    doc, start, ids = block.document(block.n - 1)
    assert doc == 9 and ids.tolist() == ids_of("x", 1) and start + len(ids) == block.n_ids


def test_token_files_below_folders_named_like_parts(spark, tmp_dir):
    """Part and block number come from the file's name, whatever its folders hold."""
    path = f"{tmp_dir}/part-7-c1/run-c1-files"
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("the cat sat on the mat").alias("text"))
    token_binary.write_token_files(docs, path, WORD_BPE, 1, 100)
    got = token_binary.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == list(range(400)) and len({r.file for r in got}) > 16
    assert [r.start for r in got] == [i * got[0].n_tokens for i in range(400)]


def test_token_files_of_nothing(spark, tmp_dir):
    token_binary.write_token_files(no_documents(spark), f"{tmp_dir}/none", WORD_BPE, 1)
    assert token_binary.read_token_files(spark, f"{tmp_dir}/none").count() == 0


def test_query_op2(spark):
    got = {r.doc_id: r for r in QUERIES["op2_token_files"](spark, SF_SMALL).collect()}
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()
    at = 0
    for r in rows:
        ids = ids_of(r.text, 1)
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    assert len(got) == len(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 9, 23, 4096, 12345])
def test_piece_lengths(n):
    sizes = packing.piece_lengths(n, 8)
    assert sum(sizes) == n and sizes == sorted(sizes, reverse=True)
    assert all(s & (s - 1) == 0 and s <= 8 for s in sizes)
    assert len(sizes) == n // 8 + bin(n % 8).count("1")


def test_packing(spark, tmp_dir):
    packed = packing.pack_power_of_two(odd_documents(spark), WORD_BPE, 2, 64)
    rows = packed.collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    assert all(len(r.ids) == 4 * r.length and 1 << r.bucket == r.length <= 64 for r in rows)
    want = sorted((str(r[0]), s, i) for r in ODD for s, i in enumerate(ids_of(r[1], 2)))
    have = sorted((str(r.doc_id), r.start + k, i) for r in rows for k, i in enumerate(np.frombuffer(r.ids, "<u4").tolist()))
    assert have == want
    packing.write_buckets(packed, f"{tmp_dir}/buckets")
    again = spark.read.parquet(f"{tmp_dir}/buckets")
    assert again.where(F.length("ids") != 4 * F.pow(F.lit(2), F.col("bucket"))).count() == 0 and again.count() == len(rows)
    assert packing.pack_power_of_two(no_documents(spark)).count() == 0
    with pytest.raises(ValueError):
        packing.pack_power_of_two(no_documents(spark), max_length=100)


def test_query_op7(spark):
    texts = {r.doc_id: ids_of(r.text, 2) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    covered = {d: 0 for d in texts}
    for r in QUERIES["op7_packing"](spark, SF_SMALL).orderBy("doc_id", "start").collect():
        ids = texts[r.doc_id]
        assert r.start == covered[r.doc_id] and r.doc_tokens == len(ids)
        assert r.ids_crc32 == crc(ids[r.start:r.start + r.length])
        covered[r.doc_id] += r.length
    assert covered == {d: len(i) for d, i in texts.items()}


@pytest.mark.parametrize("tokenizer", [PIECE_BPE, WORD_BPE, BYTE_BPE])
def test_token_counts(spark, tokenizer):
    if tokenizer.endswith(".model"):
        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokenizer))
        count = lambda t: len(sp.encode(t))
    else:
        tok = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    got = token_counts.token_counts(odd_documents(spark), tokenizer, limit=20, sample_documents=3, entries=5).collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()), n := count(r[1] or ""), n > 20) for r in ODD)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.token_counts(no_documents(spark), tokenizer).count() == 0


def test_query_op6(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_BPE))
    got = {r.doc_id: r for r in QUERIES["op6_token_counts"](spark, SF_SMALL).collect()}
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        n = len(sp.encode(r.text or ""))
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len((r.text or "").encode()), n > 4096)
