"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at a few counts of a text and votes good, votes bad or
abstains. No labels are read: expectation-maximisation over the votes of all
documents estimates how often the vote of each rule is right for good and for
bad documents, and each document gets the posterior probability of being
good. A document that breaks one rule of little weight is kept; one that
breaks a rule the others agree with goes.

The rounds run over the table of vote patterns and their counts, of at most
3 to the power of the number of rules rows whatever the corpus. Texts are read
once; their counts, a few numbers a document, are written and read back.

Rows are documents: repeated rows, equal or null ids each stand for
themselves. A null text has no words. An empty table gives no rows. Columns
of the input other than id and text are not looked at. Repeated windows are
found within a row, by sorting 128-bit hashes of its windows, so a text needs
about 60 bytes a word of memory in the task that holds it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import List, Sequence, Tuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, saved

WORD = r"[^\x20\x09-\x0D]+"

#: (rule, votes good when, votes bad when) over the columns of ``text_counts``;
#: where neither holds the rule abstains. Shares are compared as products, so
#: a text without words divides by nothing.
RULES: List[Tuple[str, str, str]] = [
    ("long_enough", "n_words >= 100", "n_words < 50"),
    ("word_length", "word_chars between 3 * n_words and 9 * n_words", "word_chars < 2.5 * n_words or word_chars > 12 * n_words"),
    ("few_symbols", "20 * n_symbols <= n_words", "4 * n_symbols > n_words"),
    ("few_repeats", "5 * n_repeat_words <= n_words", "100 * n_repeat_words > 40 * n_words"),
    ("own_lines", "n_lines >= 3 and 10 * n_dup_lines <= n_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("lower_case", "5 * n_upper <= n_letters", "2 * n_upper > n_letters"),
    ("letters", "10 * n_letters >= 9 * word_chars", "10 * n_letters < 8 * word_chars"),
    ("few_shouts", "20 * n_shouts <= n_words", "4 * n_shouts > n_words"),
    ("spelled", "20 * n_bare <= n_words", "5 * n_bare > n_words"),
]


def _kept(text: Column, others: str) -> Column:
    """How many characters are left once matches of ``others`` are cut out."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id and, of each whole text, long counts: n_words, word_chars (code
    points in words), n_symbols, n_lines (lines with a word), n_dup_lines
    (those equal to an earlier one), n_repeat_words (words in 3-word windows
    found twice or more, the first included), n_letters, n_upper, n_shouts
    (exclamation and question marks), n_bare (words without letter or digit)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = base.select(
        "doc_id", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), lines.alias("lines"),
        F.regexp_replace("text", r"[^#*$%&|<>!?]+", "").alias("marks"), _kept(F.col("text"), r"\P{L}+").alias("n_letters"),
        _kept(F.col("text"), r"\P{Lu}+").alias("n_upper"))
    n_symbols = F.length(F.translate("marks", "!?", "")).cast("long")

    def window(w, i):
        three = (w, F.get("words", i + 1), F.get("words", i + 2))
        return F.struct(F.xxhash64(*three).alias("h"), F.xxhash64(F.lit(1), *three).alias("g"), i.alias("i"))

    windows = F.transform(F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))), window)
    sized = found.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        n_symbols.alias("n_symbols"), (F.length("marks") - n_symbols).alias("n_shouts"), "n_letters", "n_upper",
        F.size(F.filter("words", lambda w: ~w.rlike(r"[\p{L}\p{N}]"))).cast("long").alias("n_bare"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(windows).alias("windows"))

    def same(x, y):
        return F.coalesce((x["h"] == y["h"]) & (x["g"] == y["g"]), F.lit(False))

    again = F.filter("windows", lambda x, k: same(x, F.get("windows", k - 1)) | same(x, F.get("windows", k + 1)))
    starts = F.sort_array(F.transform(again, lambda x: x["i"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(i - s["last"], F.lit(3))).alias("n")), lambda s: s["n"])
    return sized.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"),
                        "n_letters", "n_upper", "n_shouts", "n_bare")


def votes(rules: Sequence[Tuple[str, str, str]] = RULES) -> Column:
    """An entry per rule: 1 good, 0 bad, null where it abstains."""
    return F.array(*[F.when(F.expr(bad), 0).when(F.expr(good), 1) for _, good, bad in rules])


@dataclass(frozen=True)
class VoteModel:
    """``prior``: share of good documents. ``right_good[j]``, ``right_bad[j]``:
    how often rule j, where it votes, votes right on good and on bad ones."""

    prior: float
    right_good: Tuple[float, ...]
    right_bad: Tuple[float, ...]

    def posterior(self, cast: Column) -> Column:
        """Probability of good, from an array of votes. The weights are one
        literal array, so rounds that differ in it share their plan's code."""
        weights = F.array(*[F.array(F.lit(math.log((1 - s) / t)), F.lit(math.log(s / (1 - t))))
                            for s, t in zip(self.right_good, self.right_bad)])
        odds = F.zip_with(cast, weights, lambda v, w: F.coalesce(F.get(w, v), F.lit(0.0)))
        start = F.get(F.array(F.lit(math.log(self.prior / (1 - self.prior)))), F.lit(0))
        return 1 / (1 + F.exp(-F.aggregate(odds, start, lambda a, b: a + b)))


#: Where the rounds start: most documents good, good ones seldom voted down.
START = (0.8, 0.98, 0.3)
#: Votes each accuracy is given beforehand: right and wrong, on good and on bad documents.
BEFORE = (9.0, 1.0, 5.0, 5.0)


def fit_votes(voted: DataFrame, rules: int, rounds: int = 12) -> VoteModel:
    """Expectation-maximisation over the ``votes`` of all rows, an array of
    ``rules`` entries each.

    A round is one aggregate over the patterns that occur; what comes to the
    driver is two sums for each rule and vote. A rule whose bad vote would
    speak for a document is neutral. The patterns lie in one sorted file, so
    sums do not depend on the order of tasks."""
    counted = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    patterns = saved(counted.coalesce(1).sortWithinPartitions("votes"), "patterns").coalesce(1)
    model = VoteModel(START[0], (START[1],) * rules, (START[2],) * rules)
    for _ in range(rounds):
        expected = patterns.select("n", model.posterior(F.col("votes")).alias("p"),
                                   F.posexplode(F.concat("votes", F.array(F.lit(1)))).alias("rule", "vote"))
        sums = {(r.rule, r.vote): (r.good, r.bad) for r in expected.groupBy("rule", "vote").agg(
            F.sum(F.col("n") * F.col("p")).alias("good"), F.sum(F.col("n") * (1 - F.col("p"))).alias("bad")).collect()}
        right_good, right_bad = [], []
        for j in range(rules):
            (g0, b0), (g1, b1) = (sums.get((j, v), (0.0, 0.0)) for v in (0, 1))
            s = (g1 + BEFORE[0]) / (g1 + g0 + BEFORE[0] + BEFORE[1])
            t = (b0 + BEFORE[2]) / (b1 + b0 + BEFORE[2] + BEFORE[3])
            right_good.append(s)
            right_bad.append(max(t, 1 - s))
        good, bad = sums.get((rules, 1), (0.0, 0.0))
        model = VoteModel((good + 4) / (good + bad + 5), tuple(right_good), tuple(right_bad))
    forget(patterns)
    return model


def quality_votes(docs: DataFrame, rules: Sequence[Tuple[str, str, str]] = RULES, least: float = 0.5) -> DataFrame:
    """Per document: its counts, its ``votes`` in the order of the rules,
    ``posterior`` (probability of good), ``base_failed`` (under 50 words, or more than half of the words in
    repeated windows) and ``kept`` (posterior of at least ``least`` and not
    ``base_failed``)."""
    counted = saved(text_counts(docs).select("*", votes(rules).alias("votes")), "rule-votes")
    model = fit_votes(counted, len(rules))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (counted.withColumn("posterior", model.posterior(F.col("votes"))).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least)))
