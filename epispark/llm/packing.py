"""Packing by power-of-two decomposition (operator 7).

A document of L ids becomes floor(L / max) pieces of ``max_length`` and one
piece for every binary digit of the rest, longest first. Each piece is a
sequence of its own in the bucket of its length: no padding, no sequence
across documents, no shuffle.
"""

from __future__ import annotations

from typing import Iterator, List

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices
from .tokenizing import WORD_BPE, word_encoder

SCHEMA = "doc_id long, start long, length long, doc_tokens long, bucket int, ids binary"


def piece_lengths(n: int, max_length: int) -> List[int]:
    """Lengths of the pieces of ``n`` ids; ``max_length`` is a power of two."""
    full, rest = divmod(n, max_length)
    return [max_length] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack_power_of_two(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = 2, max_length: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, bucket (log2 of
    the length), ids (unsigned 32-bit little-endian), sequence_id, offset (0).

    A null or empty text is the end id alone; repeated rows and ids all stay
    and are packed apart; a null doc_id stays null; an empty table gives no
    rows; other columns are ignored. ``sequence_id`` is the partition's number
    and the row's place in it: the same again when a task is repeated, as long
    as the input's files are the same.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(tokenizer)
        for b in slices(batches, 1024):
            doc, start, length, total, ids = [], [], [], [], []
            tokens, ends = enc.encode_column(b.column(1))
            for d, lo, hi in zip(b.column(0).to_pylist(), np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
                own = np.append(tokens[lo:hi], end_id).astype("<u4").tobytes()
                n, at = len(own) // 4, 0
                for size in piece_lengths(n, max_length):
                    doc.append(d)
                    start.append(at)
                    length.append(size)
                    total.append(n)
                    ids.append(own[4 * at:4 * (at + size)])
                    at += size
            if doc:
                bucket = np.log2(np.asarray(length)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(total, pa.int64()), pa.array(bucket), pa.array(ids, pa.binary())],
                    ["doc_id", "start", "length", "doc_tokens", "bucket", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return (arrow_map(rows, pieces, SCHEMA)
            .withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Parquet with a folder per bucket, from which batches of equal length are read."""
    packed.write.partitionBy("bucket").parquet(path)
