"""Token-id files with Elias-Fano document boundaries (operator 2).

A file is one self-contained block: header, document ids (Elias-Fano over the
differences to the least), document ends (Elias-Fano over the id array), the
concatenated ids, and a trailing mark. Files are in ascending ``doc_id``
order, by partition and by number within a partition.

Layout (little-endian):
  header  64 bytes: mark, version, width of an id in bytes, documents, of
          these without doc_id, ids, least doc_id, bytes of the two sequences
  ids of documents, ends of documents: see ``EliasFano.to_bytes``
  token ids

The ids of documents and the ends are monotone, which is all Elias-Fano needs:
``n`` values below ``u`` take ``n * (2 + log2(u / n))`` bits and a 32-bit
select sample per 256 values; no 64-bit table is kept.
"""

from __future__ import annotations

import struct
import zlib
from typing import Iterator, List

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, saved, slices
from .tokenizing import WORD_BPE, word_encoder

MARK = "EFTK"
HEADER, HEADER_BYTES = "<4sHHQQQqQQ8x", 64
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of non-negative integers below 2**63."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        lows = ((v[:, None] >> np.arange(bits, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(lows.reshape(-1), bitorder="little")
        ones = ((v >> np.uint64(bits)).astype(np.int64) + np.arange(n))
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        unary[ones] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        """n, low bits, bytes of lows and highs, then lows, highs, samples."""
        head = struct.pack("<QIIQ", self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data) -> "EliasFano":
        n, bits, low, high = struct.unpack_from("<QIIQ", data)
        at = 24
        parts = []
        for size in (low, high):
            parts.append(np.frombuffer(data, np.uint8, size, at))
            at += size
        return cls(n, bits, parts[0], parts[1], np.frombuffer(data, "<u4", -(-n // SAMPLE), at))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=np.uint64)
        for k in range(self.low_bits):
            at = i * self.low_bits + k
            out |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(k)
        return out

    def select(self, i: int) -> int:
        """Value ``i``: from the nearest sample, scan the unary bits for the
        remaining ones."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(self.samples[i // SAMPLE])
        skip = i % SAMPLE
        byte, width = start >> 3, 64
        seen = 0
        while True:
            bits = np.unpackbits(self.high[byte:byte + width], bitorder="little")
            if byte == start >> 3:
                bits[: start & 7] = 0
            at = np.flatnonzero(bits)
            if seen + len(at) > skip:
                one = byte * 8 + int(at[skip - seen])
                break
            seen += len(at)
            byte += width
        return ((one - i) << self.low_bits) | int(self._lows(np.array([i]))[0])

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return ((ones - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(i)


def pack_block(doc_ids: List, parts: List[bytes], dtype: np.dtype) -> bytes:
    """One block; ``doc_ids`` ascending with nulls first, ``parts`` the id
    bytes of each document."""
    nulls = sum(d is None for d in doc_ids)
    known = np.asarray(doc_ids[nulls:], dtype=np.int64)
    least = int(known[0]) if len(known) else 0
    ids = EliasFano.of((known - least).astype(np.uint64)).to_bytes()
    ends = np.cumsum([len(p) // dtype.itemsize for p in parts], dtype=np.int64)
    bounds = EliasFano.of(ends).to_bytes()
    head = struct.pack(HEADER, MARK.encode(), 1, dtype.itemsize, len(doc_ids), nulls, int(ends[-1]) if len(ends) else 0, least,
                       len(ids), len(bounds))
    return b"".join([head, ids, bounds, *parts])


class Block:
    """A block's documents by position, without decoding the others."""

    def __init__(self, data):
        data = memoryview(data)
        mark, version, width, self.n, self.nulls, self.n_ids, self.least, a, b = struct.unpack_from(HEADER, data)
        if mark != MARK.encode() or version != 1:
            raise ValueError("not a token-id file")
        at = HEADER_BYTES
        self.ids = EliasFano.from_bytes(data[at:at + a])
        self.ends = EliasFano.from_bytes(data[at + a:at + a + b])
        self.tokens = np.frombuffer(data, f"<u{width}", self.n_ids, at + a + b)

    def document(self, i: int):
        """(doc_id, start, ids) of document ``i`` by select."""
        start = self.ends.select(i - 1) if i else 0
        doc = None if i < self.nulls else self.least + self.ids.select(i - self.nulls)
        return doc, start, self.tokens[start:self.ends.select(i)]

    def doc_ids(self) -> List:
        return [None] * self.nulls + [self.least + int(v) for v in self.ids.values()]


def write_token_files(docs: DataFrame, path: str, tokenizer: str = WORD_BPE, end_id: int = 1,
                      block_ids: int = 1 << 23) -> None:
    """Write the token files of ``docs`` (doc_id: long, text) to ``path``.

    Null texts count as empty and give the end id alone; a null doc_id comes
    first; rows with equal doc_id all stay, ordered by text. An empty table
    gives no block. Other columns are ignored. Ranges are cut on (doc_id, text
    hash), so that one repeated id does not make one large range. Blocks hold
    whole documents and close at ``block_ids`` ids.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(tokenizer)
        end = np.asarray([end_id], dtype=enc.dtype).tobytes()
        ids: List = []
        parts: List[bytes] = []
        held = 0
        for b in slices(batches, 1024):
            tokens, ends = enc.encode_column(b.column(1))
            for doc, lo, hi in zip(b.column(0).to_pylist(), np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
                part = tokens[lo:hi].tobytes() + end
                ids.append(doc)
                parts.append(part)
                held += len(part) // enc.dtype.itemsize
                if held >= block_ids:
                    yield pa.RecordBatch.from_arrays([pa.array([pack_block(ids, parts, enc.dtype)], pa.binary())], ["value"])
                    ids, parts, held = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([pack_block(ids, parts, enc.dtype)], pa.binary())], ["value"])

    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
            .repartitionByRange(F.col("doc_id"), F.xxhash64("text"))
            .sortWithinPartitions("doc_id", F.xxhash64("text"), "text"))
    # The text writer puts a string's bytes down as they are; one row a file,
    # the line separator is the file's trailing mark.
    (arrow_map(rows, blocks, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", MARK).option("maxRecordsPerFile", 1).text(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file, position) of every document,
    read from the files; ``start`` counts the ids of all documents before it."""
    files = (spark.read.format("binaryFile").load(path).where("length > 0")
             .select(F.regexp_extract("path", r"/part-(\d+)-[^/]*$", 1).cast("long").alias("part"),
                     F.regexp_extract("path", r"-c(\d+)\.txt$", 1).cast("long").alias("number"), "content"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, number, content in zip(b.column(0), b.column(1), b.column(2)):
                block = Block(content.as_buffer())
                ends = block.ends.values().astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                wide = block.tokens.astype("<u4")
                crc = [zlib.crc32(wide[s:e]) for s, e in zip(starts, ends)]
                n = block.n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * n, pa.int64()), pa.array([number.as_py()] * n, pa.int64()),
                     pa.array(block.doc_ids(), pa.int64()), pa.array(starts), pa.array(ends - starts),
                     pa.array(crc, pa.int64()), pa.array(np.arange(n, dtype=np.int64))],
                    ["part", "number", "doc_id", "start", "n_tokens", "ids_crc32", "position"])

    from pyspark.sql import Window

    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    # files are read once; what each block holds is added up from its documents
    rows = saved(arrow_map(files, documents, "part long, number long, doc_id long, start long, n_tokens long, "
                                             "ids_crc32 long, position long"), "documents")
    base = (rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("n_ids"))
            .select("part", "number", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")))
    return (rows.join(base, ["part", "number"])
            .select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32",
                    F.concat_ws("-", "part", "number").alias("file"), "position"))
