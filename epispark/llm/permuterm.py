"""Spelling variants by permuterm rotations.

A word ``w`` and a mark are rotated to every start. With ``w = p c s`` the
rotation that ends in the character ``c`` is ``s mark p c``: among the sorted
rotations all words that differ from ``w`` in that character alone lie side by
side, under the prefix ``s mark p``, and so does the rotation ``s mark p`` of
the word that lacks it. Every replacement, insertion and deletion of one code
point is found in one such prefix range, and nothing else is in it.

A range is never expanded to pairs: each member learns how many others there
are and which of them is the most frequent. Rotations are shuffled and sorted
by prefix; a word of length L has 2 L + 1 entries (L that skip a character and
L + 1 whole ones), so the work grows with the vocabulary, not with its square.
Ranges stay small, as the members of one differ in a single character, but
nothing relies on that: the windows over them spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, saved

#: Runs of these are words; A-Z alone are lower-cased.
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = "$"


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2, slip: int = 31) -> DataFrame:
    """``word, n`` over all whole texts: lower-cased runs of letters, of at
    least ``least_length`` code points and ``least_count`` occurrences.

    A run whose crc32 of ``<doc_id>:<run>`` is a multiple of ``slip`` loses
    its code point at crc32 modulo its length; without an id (null) or with
    ``slip`` 0 none does. A null text has no words. Repeated rows and ids
    count each time. Counts are added up within each task first, so a word of
    a third of all occurrences is one row a task."""
    run = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{LETTERS}{{{int(least_length)},}}"), F.lit(0)))
    runs = docs.select("doc_id", run.alias("run"))
    runs = runs.withColumn("run", F.when(F.octet_length("run") == F.length("run"), F.lower("run"))
                           .otherwise(F.translate("run", UPPER, LOWER)))
    word = F.col("run")
    if slip:
        runs = runs.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(F.col("h") % slip == 0, less).otherwise(word)
    return (runs.select(word.alias("word")).where(F.length("word") >= least_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count))


def rotations(words: DataFrame) -> DataFrame:
    """``prefix, at, word, n, kind``: kind 0 for whole rotations, for those
    that skip a character 1, or 2 where the character repeats the one before
    (leaving out either gives the same shorter word, which meets kind 1 only).
    ``at`` is the place of the mark in the prefix, so words may hold it."""
    split = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    before = F.substring("word", F.lit(1), F.col("i"))

    def after(skip: int) -> Column:
        return F.substring("word", F.col("i") + 1 + skip, F.length("word"))

    def entry(skip: int, kind: Column) -> Column:
        return F.struct(F.concat(after(skip), F.lit(MARK), before).alias("prefix"),
                        (F.length("word") - F.col("i") - skip).alias("at"), kind.alias("kind"))

    again = (F.col("i") > 0) & (F.substring("word", F.col("i"), F.lit(1)) == F.substring("word", F.col("i") + 1, F.lit(1)))
    entries = F.array(entry(0, F.lit(0)), entry(1, F.when(again, 2).otherwise(1)))
    both = F.when(F.col("i") < F.length("word"), entries).otherwise(F.array(entry(0, F.lit(0))))
    return split.select("word", "n", F.inline(both))


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n`` of distinct ``word, n``: how many
    others differ by exactly one code point inserted, deleted or replaced, and
    the one of largest n among them (ties: least in code-point order)."""
    group = Window.partitionBy("prefix", "at")

    def count(found: Column) -> Column:
        return F.sum(found.cast("int")).over(group)

    def best(found: Column) -> Column:
        return F.min(F.when(found, F.col("rank"))).over(group)

    kind, rank = F.col("kind"), F.struct((-F.col("n")).alias("less"), "word")
    skips, whole, first = kind > 0, kind == 0, kind == 1
    ranges = (rotations(words).withColumn("rank", rank)
              .withColumns({"n_skip": count(skips), "n_whole": count(whole), "n_first": count(first), "skip_1": best(skips),
                            "whole_1": best(whole), "first_1": best(first)})
              .where(F.col("n_skip") + F.col("n_whole") > 1)
              .withColumn("skip_2", best(skips & (F.col("rank") != F.col("skip_1")))))
    # others of the range that a member is near to, and the best of them
    other = F.when(F.col("rank") == F.col("skip_1"), F.col("skip_2")).otherwise(F.col("skip_1"))
    n_near = (F.when(whole, F.col("n_first")).when(first, F.col("n_skip") - 1 + F.col("n_whole")).otherwise(F.col("n_skip") - 1))
    near = F.when(whole, F.col("first_1")).when(first, F.least(other, "whole_1")).otherwise(other)
    found = (ranges.select("word", n_near.alias("n_near"), near.alias("near")).groupBy("word")
             .agg(F.sum("n_near").cast("long").alias("n_near"), F.min("near").alias("near")))
    return (words.join(found, "word", "left")
            .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("near.word").alias("form"),
                    (-F.col("near.less")).alias("form_n")))


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` per word of a table ``word, n``.

    ``form`` is the near word of largest n if that is at least ``ratio`` times
    the word's n, else null; ``root`` is where the forms lead. Rows of a word
    are added up; rows with a null word or n and words whose n is not positive
    are left out. n grows by ``ratio`` at each step, so chains are short, and each round halves them.
    Other columns are not looked at; an empty table gives no rows."""
    if ratio < 2:
        raise ValueError("a form has to be more frequent than its variants")
    words = words.where("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")).where("n > 0")
    words = saved(words, "words")
    near = near_words(words)
    fits = F.col("form_n") >= ratio * F.col("n")
    near = saved(near.select("word", "n", "n_near", F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")),
                 "near-words")
    forget(words)
    links = saved(near.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = saved(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                             F.col("next").isNotNull().alias("moved")), "roots")
        forget(links)
        links = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return near.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
