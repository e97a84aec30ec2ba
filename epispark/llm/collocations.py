"""Phrase collocations, counted in quotient filters.

1. Texts are cut into words and encoded in blocks of bounded size, each with
   its own small dictionary; blocks are written once.
2. Word counts come from the blocks' dictionaries. A phrase found ``least``
   times consists of words found ``least`` times, so only those get ids, dense
   over all languages; a rarer word ends a phrase, like punctuation does.
3. Each block's dictionary is joined to the ids (a row per block and distinct
   word, whatever the word's frequency), and its n-grams are packed ids: 3 ids
   for a phrase of three words, the third 0 for one of two.
4. A task adds up the n-grams of its blocks in counting quotient filters, one
   per range of the permuted keys. Ranges are shuffled and merged; where there
   are more than a task can hold, in several levels, each splitting further.
   The permutation spreads a frequent word's phrases over all ranges. A long
   block, a full task and a merged range are gone through piece by piece, so
   that a worker needs little beyond the entries it holds.
5. Merged filters are read back to ids and exact counts; phrases are scored
   by joins on ids.
"""

from __future__ import annotations

from typing import Dict, Iterator, List, Optional, Tuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import quotient_filter as qf
from .common import arrow_map, forget, runs, saved

U64 = np.uint64
#: A-Z are lower-cased, these end a piece; blank and tab part words.
BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(ord(".") if b in BREAKS else b + 32 if 65 <= b <= 90 else 32 if b == 9 else b for b in range(256))
BLOCK = "block long, lang string, words array<binary>, counts array<long>, width int, codes binary"

#: Bytes of text in a block, and entries a task holds before it writes filters.
BLOCK_BYTES, TASK_ENTRIES = 1 << 21, 1 << 21
#: Words of a block whose phrases are packed at once, and bits by which a task's
#: entries are dealt out to be written.
PIECE_WORDS, PIECE_BITS = 1 << 17, 5
#: Entries in a range that one task merges, and bits by which a level splits.
RANGE_ENTRIES, LEVEL_BITS = 1 << 22, 9


def _encoded(pieces: List[bytes]) -> Tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, their counts, codes): code k + 1 stands for word k, 0
    for the end of a piece."""
    text = b".".join(pieces).translate(_TABLE).replace(b".", b" . ").strip()
    found = pc.ascii_split_whitespace(pa.array([text], pa.large_binary()).cast(pa.large_string(), safe=False)).flatten()
    coded = found.dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    skip = np.array([w in (b".", b"") for w in words], dtype=bool)
    new = np.where(skip, 0, np.cumsum(~skip))
    codes = new[codes] if len(words) else codes
    counts = np.bincount(codes, minlength=int((~skip).sum()) + 1)[1:]
    return pa.array([w for w, s in zip(words, skip) if not s], pa.binary()), counts, codes


def encoded_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``BLOCK`` rows of ``lang, text``: a block holds whole texts of one
    language (null: ``und``), about ``block_bytes`` of them, more only for one
    longer text. A null text is empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 33
        held: Dict[str, List[bytes]] = {}
        size = 0

        def flush():
            nonlocal number, size
            for lang, pieces in held.items():
                words, counts, codes = _encoded(pieces)
                width = 2 if len(words) < 1 << 16 else 4
                yield pa.RecordBatch.from_arrays([
                    pa.array([number], pa.int64()), pa.array([lang], pa.string()),
                    pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                    pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([width], pa.int32()),
                    pa.array([codes.astype(f"<u{width}").tobytes()], pa.binary())],
                    names=["block", "lang", "words", "counts", "width", "codes"])
                number += 1
            held.clear()
            size = 0

        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1)
            for i in range(b.num_rows):
                text = texts[i].as_py()
                if not text:
                    continue
                data = text.encode()
                held.setdefault(langs[i], []).append(data)
                size += len(data)
                if size >= block_bytes:
                    yield from flush()
        yield from flush()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, encode, BLOCK)


def word_ids(blocks: DataFrame, least: int) -> Tuple[DataFrame, DataFrame, int]:
    """(words ``id, lang, word, f`` found ``least`` times or more, all
    occurrences ``lang, n``, number of ids). Ids count from 1 without gaps: each
    task numbers its own rows, and the driver, given a count per task, adds
    where each task starts."""
    each = blocks.select("lang", F.inline(F.arrays_zip("words", "counts")))
    total = each.groupBy("lang").agg(F.sum("counts").alias("n"))
    counted = each.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f")).where(F.col("f") >= least)
    numbered = saved(counted.withColumn("task", F.spark_partition_id())
                     .withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "words")
    sizes = {r.task: r.n for r in numbered.groupBy("task").agg((F.max("place") + 1).alias("n")).collect()}
    starts, at = [], 1
    for task in range(max(sizes, default=0) + 1):
        starts.append(at)
        at += sizes.get(task, 0)
    first = F.get(F.lit(np.array(starts, dtype=np.int64)), F.col("task"))
    return numbered.select((first + F.col("place")).alias("id"), "lang", F.col("word").cast("string").alias("word"), "f"), total, at - 1


def _packed(ids: np.ndarray, bits: int, starts: Optional[int] = None) -> Tuple[np.ndarray, np.ndarray]:
    """(high, low) halves of all phrases of two and three words in a row of
    ids, where 0 ends a phrase; of those that start in the first ``starts`` ids."""
    low_bits = 3 * bits // 2
    i, j = ids[:-1][:starts], ids[1:][:starts]
    k = np.append(ids[2:], U64(0))[:starts] if len(ids) > 1 else ids[:0]
    two = np.flatnonzero((i != 0) & (j != 0))
    three = two[k[two] != 0]
    i, j, k = np.concatenate([i[two], i[three]]), np.concatenate([j[two], j[three]]), np.concatenate([np.zeros(len(two), U64), k[three]])
    high = (i << U64(2 * bits - low_bits)) | (j >> U64(low_bits - bits))
    low = (k | (j << U64(bits))) & qf._mask(low_bits)
    return high, low


def _unpacked(high: np.ndarray, low: np.ndarray, bits: int) -> Tuple[np.ndarray, np.ndarray, np.ndarray]:
    low_bits = 3 * bits // 2
    part = 2 * bits - low_bits
    return (high >> U64(part), ((high & qf._mask(part)) << U64(low_bits - bits)) | (low >> U64(bits)), low & qf._mask(bits))


def _distinct(shard: np.ndarray, key: np.ndarray, counts: np.ndarray, key_bits: int, bits: int) -> Tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (shard, key) and the sums of their counts; keys have
    ``key_bits`` of ``bits`` bits. Where these fit a word they are sorted as one."""
    if key_bits == bits or bits <= 64:
        both, counts = qf.added_up(key if key_bits == bits else (shard << U64(key_bits)) | key, counts)
        return (np.zeros(len(both), U64), both, counts) if key_bits == bits else (both >> U64(key_bits), both & qf._mask(key_bits), counts)
    order = np.lexsort((key, shard))
    shard, key, counts = shard[order], key[order], counts[order]
    if len(key):
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])))
        shard, key, counts = shard[first], key[first], np.add.reduceat(counts, first)
    return shard, key, counts


def _filter_rows(parts) -> Iterator[pa.RecordBatch]:
    for shard, data in parts:
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([data], pa.binary())], names=["shard", "filter"])


def _block_filters(bits: int, shard_bits: int, entries: int, words: int = PIECE_WORDS):
    """Task: filters by range of the phrases of all blocks it reads. A block's
    phrases are packed ``words`` words at a time."""
    map_ = qf.Permutation(3 * bits)
    rest = 3 * bits - shard_bits
    narrow = np.min_scalar_type((1 << shard_bits) - 1)
    piece_bits = min(shard_bits, PIECE_BITS)
    edges = (np.arange(1, 1 << piece_bits, dtype=U64) << U64(shard_bits - piece_bits)).astype(narrow)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            cuts = [np.concatenate([[0], np.searchsorted(shard, edges), [len(shard)]]) for shard, _, _ in held]
            for p in range(1 << piece_bits):
                shard, key, counts = (np.concatenate([x[c[p]:c[p + 1]] for x, c in zip(column, cuts)], dtype=kind)
                                      for column, kind in zip(zip(*held), (U64, U64, np.int64)))
                yield from _filter_rows(qf.split(*_distinct(shard, key, counts, rest, 3 * bits), rest, 0))

        for b in batches:
            width, codes, at, to = (b.column(i) for i in range(4))
            for r in range(b.num_rows):
                local = np.frombuffer(codes[r].as_buffer(), f"<u{width[r].as_py()}")
                table = np.zeros(1 << 8 * width[r].as_py() if width[r].as_py() == 2 else int(local.max(initial=0)) + 1, dtype=U64)
                table[at[r].values.to_numpy(zero_copy_only=False) + 1] = to[r].values.to_numpy(zero_copy_only=False).astype(U64)
                for lo in range(0, len(local), words):
                    high, low = map_.forward(*_packed(table[local[lo:lo + words + 2]], bits, words))
                    shard = high >> U64(map_.high_bits - shard_bits)
                    key = ((high & qf._mask(map_.high_bits - shard_bits)) << U64(map_.low_bits)) | low
                    shard, key, counts = _distinct(shard, key, np.ones(len(key), dtype=np.int64), rest, 3 * bits)
                    held.append((shard.astype(narrow), key, counts.astype(np.int32)))
                    size += len(key)
                    if size >= entries:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()

    return work


def _merged_ranges(batches: Iterator[pa.RecordBatch], most: Optional[int] = None) -> Iterator[Tuple[int, qf.Merger]]:
    """(shard, its filters added up) of sorted batches, one shard after the
    other; a shard comes in several parts if it has ``most`` entries or more."""
    last, merger = None, None
    for (shard,), rows in runs(batches, ["shard"]):
        if shard != last:
            if merger:
                yield last, merger
            last, merger = shard, qf.Merger()
        filters = rows.column(rows.schema.get_field_index("filter"))
        for r in range(rows.num_rows):
            merger.add(filters[r].as_py())
            if most and len(merger) >= most:
                yield last, merger
                merger = qf.Merger()
    if merger:
        yield last, merger


def phrase_counts(found: DataFrame, n_ids: int, n_words: int, least: int, range_entries: int = RANGE_ENTRIES,
                  level_bits: int = LEVEL_BITS, entries: int = TASK_ENTRIES) -> DataFrame:
    """``i, j, k, a``: phrases of two (k is 0) and three ids found ``least``
    times or more, with their exact counts; ``found`` has, per block, its
    codes and ``at``, ``id`` arrays. ``n_words`` bounds the number of words.

    A key longer than 64 bits needs its first level to split by the bits
    beyond them; ids may have up to 42 bits."""
    bits = max(1, int(n_ids).bit_length())
    if bits > 42:
        raise ValueError("more than 2 to the power of 42 frequent words")
    total = min(3 * bits - 3 * bits // 2, (2 * n_words // range_entries).bit_length())
    done = max(3 * bits - 64, min(total, level_bits))
    spark = found.sparkSession
    schema = "shard long, filter binary"
    level = arrow_map(found.select("width", "codes", "at", "id"), _block_filters(bits, done, entries), schema)

    def tasks(shard_bits: int) -> int:
        return max(1, min(1 << min(shard_bits, 20), 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))

    while done < total:
        more = min(level_bits, total - done)
        rest = 3 * bits - done

        def deeper(batches, more=more, rest=rest):
            for shard, merger in _merged_ranges(batches, range_entries):
                for keys, counts in merger.pieces():
                    yield from _filter_rows(qf.split(np.full(len(keys), shard, dtype=U64), keys, counts, rest, more))

        level = arrow_map(level.repartition(tasks(done), "shard").sortWithinPartitions("shard"), deeper, schema)
        done += more
    map_ = qf.Permutation(3 * bits)

    def last(batches):
        for shard, merger in _merged_ranges(batches):
            for keys, counts in merger.pieces():
                frequent = counts >= least
                keys, counts = keys[frequent], counts[frequent]
                high = (keys >> U64(map_.low_bits)) | U64(shard << (map_.high_bits - done))
                ids = _unpacked(*map_.back(high, keys & map_.low), bits)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (*ids, counts)], names=["i", "j", "k", "a"])

    return arrow_map(level.repartition(tasks(done), "shard").sortWithinPartitions("shard"), last, "i long, j long, k long, a long")


def _score(a: str, left: str, right: str):
    """floor(1000000 a a / (left right)), in decimals of 38 digits: exact for
    counts up to 10 to the power of 16, an error beyond."""
    wide = F.col(a).cast("decimal(19,0)")
    over = (wide * wide).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    under = F.col(left).cast("decimal(19,0)") * F.col(right).cast("decimal(19,0)")
    return F.call_function("div", over.cast("decimal(38,0)"), under.cast("decimal(38,0)"))


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, absorb: int = 50, **sizes) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: per language the ``top``
    phrases of two or three words by score, count and text.

    A phrase has a = f(phrase) >= ``least``. Each cut into a first part and a
    rest scores floor(1000000 a a / (l r)); the lowest counts, ties to the
    first. A phrase goes if a longer candidate holds it with at least
    ``absorb`` percent of its count. ``n`` is the number of words of the language.

    Null languages are ``und``, null texts empty; repeated rows and ids count
    each time; other columns are not looked at; an empty table gives no rows."""
    blocks = saved(encoded_blocks(docs), "blocks")
    words, total, n_ids = word_ids(blocks, least)
    total = saved(total, "totals")
    n_words = total.agg(F.sum("n")).first()[0] or 0
    used = (blocks.select("block", "lang", F.posexplode("words").alias("at", "word"))
            .join(words.select("lang", F.col("word").cast("binary").alias("word"), "id"), ["lang", "word"])
            .groupBy("block").agg(F.collect_list(F.struct("at", "id")).alias("ids")))
    found = (blocks.select("block", "width", "codes").join(used, "block")
             .select("width", "codes", F.col("ids.at").alias("at"), F.col("ids.id").alias("id")))
    grams = saved(phrase_counts(found, n_ids, n_words, least, **sizes), "phrases")
    forget(blocks)

    def part(letter: str) -> DataFrame:
        return words.select(F.col("id").alias(letter), F.col("word").alias(f"w{letter}"), F.col("f").alias(f"f{letter}"),
                            *([F.col("lang")] if letter == "i" else []))

    pair = grams.where("k = 0").select("i", "j", F.col("a").alias("f"))
    held = (grams.where("k <> 0").select(F.inline(F.array(F.struct("i", "j", "a"), F.struct(F.col("j").alias("i"), F.col("k").alias("j"), "a"))))
            .groupBy("i", "j").agg(F.max("a").alias("longer")))
    two = (grams.where("k = 0").join(held, ["i", "j"], "left")
           .where(F.coalesce(100 * F.col("longer") < absorb * F.col("a"), F.lit(True)))
           .join(part("i"), "i").join(part("j"), "j")
           .select("lang", F.concat_ws(" ", "wi", "wj").alias("phrase"), "a", F.col("fi").alias("l"), F.col("fj").alias("r"),
                   _score("a", "fi", "fj").alias("score")))
    three = (grams.where("k <> 0").join(part("i"), "i").join(part("j"), "j").join(part("k"), "k")
             .join(pair.select("i", "j", F.col("f").alias("fij")), ["i", "j"])
             .join(pair.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("f").alias("fjk")), ["j", "k"])
             .withColumns({"first": _score("a", "fi", "fjk"), "second": _score("a", "fij", "fk")}))
    early = F.col("first") <= F.col("second")
    three = three.select("lang", F.concat_ws(" ", "wi", "wj", "wk").alias("phrase"), "a", F.when(early, F.col("fi")).otherwise(F.col("fij")).alias("l"),
                         F.when(early, F.col("fjk")).otherwise(F.col("fk")).alias("r"), F.least("first", "second").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language of any size: the best of each slice first, then of all slices
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = (two.unionByName(three).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
