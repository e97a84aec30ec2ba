"""Quality rules: counts and expectation-maximisation against brute force."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from epispark.llm import rule_votes
from epispark.llm.queries import QUERIES

from conftest import SF_CHECK, SF_SMALL
from helpers import no_documents, odd_documents

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + o for i, w in enumerate(windows) if times[w] > 1 for o in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered))


def brute_fit(patterns, rules, rounds):
    """patterns: vote tuple -> count."""
    prior, s, t = rule_votes.START[0], [rule_votes.START[1]] * rules, [rule_votes.START[2]] * rules

    def posterior(v):
        odds = math.log(prior / (1 - prior)) + sum(
            math.log(s[j] / (1 - t[j])) if x == 1 else math.log((1 - s[j]) / t[j]) for j, x in enumerate(v) if x is not None)
        return 1 / (1 + math.exp(-odds))

    for _ in range(rounds):
        p = {v: posterior(v) for v in patterns}
        good = lambda j, x: sum(n * p[v] for v, n in patterns.items() if v[j] == x)
        bad = lambda j, x: sum(n * (1 - p[v]) for v, n in patterns.items() if v[j] == x)
        new = [(good(j, 1) + 9) / (good(j, 1) + good(j, 0) + 10) for j in range(rules)]
        t = [max((bad(j, 0) + 5) / (bad(j, 0) + bad(j, 1) + 10), 1 - new[j]) for j in range(rules)]
        every = sum(n * p[v] for v, n in patterns.items())
        prior, s = (every + 4) / (sum(patterns.values()) + 5), new
    return {v: posterior(v) for v in patterns}


def test_counts_equal_brute_force(spark):
    docs = odd_documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame(
        [(20, "a b c a b c a b"), (21, "x x x x"), (22, "a b\n a b\na b\n\n\na b"), (23, "l1 # $ é𝄞\nl1 # $ é𝄞\r\n||"), (24, "p q r s p q r")],
        "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, rule_votes.text_counts(docs).select("doc_id", *COLUMNS).collect()), key=str)
    assert got == sorted([(i, *brute_counts(t)) for i, t in rows], key=str)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    counts = {r.doc_id: brute_counts(r.text) for r in docs}
    voted = rule_votes.quality_votes(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).collect()
    patterns = Counter(tuple(r.votes) for r in voted)
    p = brute_fit(patterns, len(rule_votes.RULES), 12)
    for r in voted:
        assert abs(r.posterior - p[tuple(r.votes)]) < 1e-9
    got = {r.doc_id: r for r in QUERIES["op13_quality_rules"](spark, SF_SMALL).collect()}
    for r in voted:
        n, chars, symbols, _, dups, repeats = counts[r.doc_id]
        failed = n < 50 or 100 * repeats > 50 * n
        assert tuple(got[r.doc_id]) == (r.doc_id, n, chars, symbols, dups, repeats, failed, not failed and p[tuple(r.votes)] >= 0.5)


def test_clean_documents_stay_and_bad_ones_go(spark):
    """Labels are only compared with, never read by the rules."""
    got = QUERIES["op13_quality_rules"](spark, SF_CHECK).where("not base_failed")
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    found = {(r.quality, r.kept): r.n for r in got.join(labels, "doc_id").groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert found.get((1, False), 0) <= 0.01 * found[1, True] and found.get((0, True), 0) <= 0.1 * found[0, False], found


def test_votes_of_planted_accuracies_are_recovered(spark):
    """Rules that err apart from each other: the posterior finds the class."""
    rows = [(g, [1 if g else 0, (1 if g else 0) if i % 10 else (0 if g else 1), (1 if g else 0) if i % 4 else None])
            for g in (True, False) for i in range(300 if g else 100)]
    df = spark.createDataFrame(rows, "good boolean, votes array<int>")
    model = rule_votes.fit_votes(df, 3)
    wrong = df.withColumn("p", model.posterior(F.col("votes"))).where((F.col("p") >= 0.5) != F.col("good")).count()
    assert wrong == 0 and abs(model.prior - 0.75) < 0.02 and abs(model.right_good[1] - 0.9) < 0.03


def test_odd_and_empty(spark):
    got = rule_votes.quality_votes(odd_documents(spark, ["votes", "posterior", "n_words", "base_failed"]))
    assert got.count() == 11 and got.where("doc_id = 1 and n_words = 11 and base_failed").count() == 2
    assert rule_votes.quality_votes(no_documents(spark)).count() == 0


def test_no_python_on_the_path(spark):
    plan = rule_votes.text_counts(odd_documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
