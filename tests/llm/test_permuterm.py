"""Spelling variants by rotations against brute force."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from epispark.llm import permuterm
from epispark.llm.queries import QUERIES

from conftest import SF_SMALL
from helpers import no_documents, odd_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(n, ratio=10):
    out = {}
    for w in n:
        others = [x for x in n if x != w and near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best is not None and n[best] >= ratio * n[w] else None, len(others))
    rows = set()
    for w, (form, near_n) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n[w], near_n, n[form] if form is not None else None))
    return rows


def variants(spark, n, ratio=10):
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    return {tuple(r) for r in permuterm.spelling_variants(df, ratio).collect()}


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op11_spelling_variants"](spark, SF_SMALL).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) > 200 and len(got) == len(set(got)) and set(got) == brute(brute_counts(rows))


def test_repeated_letters_marks_and_chains(spark):
    n = {"aab": 5, "ab": 50, "aaab": 1, "b": 500, "$ab": 3, "a$b": 4, "ab$": 6, "x": 7, "": 9, "𝄞b": 2, "éb": 2, "abc": 5000, "abcd": 100000}
    assert variants(spark, n) == brute(n)
    assert {r[0]: r[2] for r in variants(spark, n)}["ab"] == "abcd"


@settings(max_examples=5, deadline=None)
@given(st.dictionaries(st.text(alphabet="ab$é", max_size=4), st.integers(1, 2000), max_size=40), st.sampled_from([2, 10]))
def test_small_alphabets(spark_words, n, ratio):
    assert variants(spark_words, n, ratio) == brute(n, ratio)


@pytest.fixture(scope="module")
def spark_words(spark):
    return spark


def test_counts_of_odd_rows(spark):
    docs = odd_documents(spark, ["word", "n", "form"])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    extra = [(i, "Beispiel WORTSCHATZ éÀÉabcdef Überraschung_überraschung") for i in (None, None, 3, 5, 8, 13, 21)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r.word: r.n for r in permuterm.word_counts(docs).collect()}
    assert got == brute_counts(rows + extra) and got
    assert permuterm.spelling_variants(permuterm.word_counts(no_documents(spark))).count() == 0


def test_nulls_and_repeated_words(spark):
    df = spark.createDataFrame([("wort", 2, "x"), ("wort", 3, "y"), (None, 5, "z"), ("leer", None, "z"), ("wird", 0, "z"), ("worte", 50, "z")],
                               "word string, n long, form string")
    assert {tuple(r) for r in permuterm.spelling_variants(df).collect()} == {("wort", "worte", "worte", 5, 1, 50), ("worte", None, "worte", 50, 1, None)}
    with pytest.raises(ValueError):
        permuterm.spelling_variants(df, 1)


def test_rows_grow_with_the_words_of_a_range_not_its_pairs(spark):
    words = spark.range(26 * 26).select(F.concat(F.lit("stamm"), F.char(97 + F.col("id") % 26), F.char(97 + (F.col("id") / 26).cast("int"))).alias("word"),
                                        F.lit(1).cast("long").alias("n"))
    assert permuterm.rotations(words).count() == 26 * 26 * 15
    assert {r.n_near for r in permuterm.near_words(words).collect()} == {50}
