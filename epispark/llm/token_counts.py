"""Token counts by a map-side two-tier lookup (operator 6).

Tier one is a broadcast table of the lengths of frequent pre-tokens, learnt
from a bounded sample of documents. Tier two is a cache in each worker, which
encodes what the table lacks. Both only save work: every count is the
tokenizer's own, and no pre-token is shuffled.
"""

from __future__ import annotations

from collections import Counter
from typing import Dict, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GenerationCache, arrow_map, hash_sample, slices, texts, worker_state
from .tokenizing import PIECE_BPE, PieceCounter, piece_counter, word_encoder

#: Bounds of the broadcast table: sampled documents, entries, length of an entry.
SAMPLE_DOCUMENTS, TABLE_ENTRIES, ENTRY_CHARS = 1000, 50_000, 48


def frequent_lengths(docs: DataFrame, tokenizer: str = PIECE_BPE, sample_documents: int = SAMPLE_DOCUMENTS,
                     entries: int = TABLE_ENTRIES) -> Dict[str, int]:
    """Tokens of the most frequent pre-tokens of a sample of documents, at
    most ``entries`` of at most ``ENTRY_CHARS`` characters: some 5 MB. Whole
    texts of the sample are read by one task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(tokenizer)
        seen: Counter = Counter()
        for b in slices(batches, 256):
            for t in texts(b.column(0)):
                seen.update(u for u in counter.units(t) if len(u) <= ENTRY_CHARS)
            if len(seen) > 20 * entries:
                seen = Counter(dict(seen.most_common(4 * entries)))
        words = [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:entries]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([counter.unit(w) for w in words], pa.int32())], ["unit", "tokens"])

    rows = docs.select("text").where("text is not null")
    some = hash_sample(rows, F.xxhash64("text"), sample_documents, docs.count()).coalesce(1)
    return {r.unit: r.tokens for r in arrow_map(some, count, "unit string, tokens int").collect()}


class _Lookup(GenerationCache):
    """Tier one, always there, with tier two around it."""

    def __init__(self, table: Dict[str, int], counter: PieceCounter):
        super().__init__(counter.unit, capacity=150_000 + len(table))
        self.table = table
        self.update(table)

    def __missing__(self, unit):
        n = super().__missing__(unit)
        if len(self) == 1:  # a new generation began
            self.update(self.table)
        return n


def token_counts(docs: DataFrame, tokenizer: str = PIECE_BPE, limit: int = 4096, **sample) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    A null text counts as empty: no bytes, no tokens. Repeated rows stay; an
    empty table gives no rows; other columns are ignored. A model file whose
    counts do not add up over pre-tokens, and a tokenizer (.json) that keeps
    white space, encode whole texts instead.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    by_piece = tokenizer.endswith(".model")
    spark = docs.sparkSession
    additive = by_piece and PieceCounter(tokenizer).additive
    table = spark.sparkContext.broadcast(frequent_lengths(docs, tokenizer, **sample) if additive else {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if additive:
            counter = piece_counter(tokenizer)
            look = worker_state(("lengths", tokenizer), lambda: _Lookup(table.value, counter))
            tokens = lambda t: sum(map(look.__getitem__, counter.units(t)))
        elif by_piece:
            tokens = piece_counter(tokenizer).whole
        else:
            enc = word_encoder(tokenizer)
            tokens = lambda t: len(enc.encode(t)) // enc.dtype.itemsize
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([tokens(t) for t in texts(b.column(1))], pa.int64()),
                 pa.compute.cast(pa.compute.binary_length(b.column(1)), pa.int64())],
                ["doc_id", "n_tokens", "n_bytes"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_bytes long"
    return (arrow_map(rows, count, schema)
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
