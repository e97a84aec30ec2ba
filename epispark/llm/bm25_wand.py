"""Exact top-k search by BM25 with block-max pruning (operator 3).

Documents are dealt into shards of bounded size. Each shard holds an inverted
index: every term's postings, and for the terms of very many documents, whose
postings would be most of the work and weigh least, also the largest impact in
each block of documents. For a query the postings of its other terms are added
up; with the block maxima of the frequent ones they bound every document's
score. Documents are completed in falling order of their bounds, until all
bounds left are below the k-th best score; blocks without a document above it
are skipped. Document counts, term frequencies and the average
length are those of all documents, so scores of different shards compare and
the merge of the shards' best k is exact.
"""

from __future__ import annotations

import re
from typing import Iterator, List, Tuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, hashed_words, runs, saved, slices, text_bytes

_TERM = re.compile(r"[^\W_]+")
#: ASCII letters in lower case, digits and bytes of other characters as they are, the rest as spaces.
_TERM_BYTES = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
K1, B = 1.2, 0.75


def bags_of(column: pa.Array, most: int = 1 << 23) -> Iterator[Tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct term hashes of each text and their counts. About ``most``
    bytes of texts are cut into words at once."""
    edges = text_bytes(column)[1]
    place = 0
    while place < len(column):
        stop = max(place + 1, int(np.searchsorted(edges, edges[place] + most, side="right")) - 1)
        yield from _bags(column.slice(place, stop - place))
        place = stop


def _bags(column: pa.Array) -> Iterator[Tuple[np.ndarray, np.ndarray]]:
    hashes, place, row = hashed_words(column, _TERM_BYTES, _TERM.findall, xxhash.xxh64_intdigest)
    distinct, code = np.unique((hashes >> np.uint64(1)).astype(np.int64), return_inverse=True)
    key = row * len(distinct) + code[place]
    key.sort()
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    counts = np.diff(np.append(new, len(key))).astype(np.int32)
    key = key[new]
    terms = distinct[key % max(1, len(distinct))]
    ends = np.searchsorted(key, np.arange(1, len(column) + 1) * len(distinct)) if len(distinct) else np.zeros(len(column), np.int64)
    first = 0
    for last in ends.tolist():
        yield terms[first:last], counts[first:last]
        first = last


class Shard:
    """The index of one shard: postings by term and document. Frequent terms,
    those of at least ``FREQUENT`` of the documents, have a column of impacts
    by document and their largest ones by block instead, ``COLUMNS`` at most.
    Documents are ordered by their most frequent term and length, which puts
    like documents into one block."""

    BLOCK, FREQUENT, COLUMNS = 16, 0.2, 256

    def __init__(self, ids: List[int], bags: List[Tuple[np.ndarray, np.ndarray]], mean_length: float):
        length = np.array([c.sum() for _, c in bags], dtype=float)
        top = np.array([t[c.argmax()] if len(t) else -1 for t, c in bags])
        order = np.lexsort((ids, length, top))
        own = [bags[i] for i in order]
        bags.clear()  # the caller hands its list over, so that its arrays go as soon as they are joined
        self.ids = np.array(ids, dtype=np.int64)[order]
        length = length[order]
        terms = np.concatenate([t for t, _ in own]) if own else np.empty(0, np.int64)
        tf = np.concatenate([c for _, c in own]).astype(float) if own else np.empty(0)
        doc = np.repeat(np.arange(len(own), dtype=np.int32), [len(t) for t, _ in own])
        del own
        impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / max(mean_length, 1e-9)))
        del tf
        by = np.argsort(terms, kind="stable")  # postings by term, then document
        terms, self.doc, self.impact = terms[by], doc[by], impact[by]
        del by, doc, impact
        self.blocks = -(-len(self.ids) // self.BLOCK)
        head = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.empty(0, int)
        self.vocabulary = terms[head]
        self.first = np.append(head, len(terms))
        size = np.diff(self.first)
        often = np.flatnonzero(size >= self.FREQUENT * len(self.ids))
        often = often[np.argsort(-size[often], kind="stable")[:self.COLUMNS]]
        self.column = np.full(len(self.vocabulary), -1)
        self.column[often] = np.arange(len(often))
        self.frequent = np.zeros((self.blocks * self.BLOCK, len(often)))
        for j, i in enumerate(often):
            at = slice(self.first[i], self.first[i + 1])
            self.frequent[self.doc[at], j] = self.impact[at]
        self.block_max = self.frequent.reshape(self.blocks, self.BLOCK, len(often)).max(1)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> Tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores, blocks with completed documents) of the k best
        documents that hold a query term, by falling score, then id."""
        at = np.searchsorted(self.vocabulary, terms)
        at[at == len(self.vocabulary)] = 0
        here = self.vocabulary[at] == terms if len(self.vocabulary) else np.zeros(len(terms), bool)
        at, w = at[here], weights[here]
        if not len(at):
            return np.empty(0, np.int64), np.empty(0), 0
        column = self.column[at]
        rare, often = np.flatnonzero(column < 0), np.flatnonzero(column >= 0)
        column = column[often]
        first, last = self.first[at[rare]], self.first[at[rare] + 1]
        lists = [slice(*ends) for ends in zip(first.tolist(), last.tolist())]
        doc = np.concatenate([self.doc[i] for i in lists]) if lists else np.empty(0, np.int32)
        value = np.concatenate([self.impact[i] for i in lists]) if lists else np.empty(0)
        value *= np.repeat(w[rare], last - first)
        part = np.bincount(doc, value, len(self.ids))
        bound = part + np.repeat(self.block_max[:, column] @ w[often], self.BLOCK)[:len(part)]
        left = np.flatnonzero(bound > 0)
        done, score = np.empty(0, np.int64), np.empty(0)
        least, step = 0.0, max(64, 4 * k)
        while len(left):
            # documents whose bound is below the k-th best score cannot be better
            some = left if len(left) <= step else left[np.argpartition(-bound[left], step)[:step]]
            done = np.concatenate([done, some])
            score = np.concatenate([score, part[some] + self._impacts(some, column) @ w[often]])
            if len(done) >= k:
                least = (np.partition(score, len(score) - k)[len(score) - k] - 2e-6) / (1 + 1e-9)
            bound[some] = 0
            left = left[(bound[left] > 0) & (bound[left] >= least)]
            step *= 8
        best = done[(score > 0) & (score >= least)]
        # the sums of the best once more in the order of terms, so that equal documents are equal in every shard
        place = np.full(len(part), -1)
        place[best] = np.arange(len(best))
        mine = np.flatnonzero(place[doc] >= 0)
        impacts = self._impacts(best, column)
        row, j = np.nonzero(impacts)
        term = np.concatenate([rare[np.searchsorted(np.cumsum(last - first), mine, side="right")], often[j]])
        order = np.argsort(term, kind="stable")
        sums = np.bincount(np.concatenate([place[doc[mine]], row])[order], np.concatenate([value[mine], impacts[row, j] * w[often[j]]])[order], len(best))
        ids, scores = self.ids[best], np.round(sums, 6)
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best], len(np.unique(done // self.BLOCK))

    def _impacts(self, docs: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Impacts of frequent terms, a row per document."""
        return self.frequent.take((docs * self.frequent.shape[1])[:, None] + columns)


def global_statistics(docs: DataFrame) -> Tuple[int, float, DataFrame]:
    """Documents, mean length, and (term, df) over all of them. A task sums
    its documents before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: List[np.ndarray] = []
        size = n = length = 0

        def out(terms, df, n, length):
            k = len(terms)
            return pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.int64()), pa.array(df, pa.int64()), pa.array(np.r_[n, np.zeros(k - 1)].astype(np.int64)),
                 pa.array(np.r_[length, np.zeros(k - 1)].astype(np.int64))], ["term", "df", "docs", "length"])

        for b in slices(batches, 1024):
            for terms, counts in bags_of(b.column(0)):
                held.append(terms)
                size += len(terms)
                n += 1
                length += int(counts.sum())
            if size > 4_000_000:
                yield out(*np.unique(np.concatenate(held), return_counts=True), n, length)
                held, size, n, length = [], 0, 0, 0
        terms, df = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.int64), np.empty(0, np.int64))
        # the counts of documents travel with a term that does not exist
        yield out(np.r_[-1, terms], np.r_[0, df], n, length)

    partial = saved(arrow_map(docs.select(F.coalesce("text", F.lit("")).alias("text")), count, "term long, df long, docs long, length long"), "terms")
    n, length = partial.agg(F.sum("docs"), F.sum("length")).first()
    df = partial.where("term >= 0").groupBy("term").agg(F.sum("df").alias("df"))
    return int(n or 0), (length or 0) / max(1, n or 0), df


def search(docs: DataFrame, queries: DataFrame, k: int = 10, shard_documents: int = 16384) -> DataFrame:
    """The ``k`` best documents of each query: query_id, rank, doc_id, score.

    ``queries`` (query_id, text) are whole texts; a term counts once per query,
    and rows of one query_id are one query with the terms of all its texts.
    score = sum over shared terms of ln(1 + (N - df + 0.5) / (df + 0.5)) times
    tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean length)). Ties go to
    the lesser doc_id; scores count to six decimals. A query without terms, or whose terms no document has,
    gives no rows; null texts count as empty; rows without doc_id or query_id
    are left out; repeated rows of ``docs`` are separate documents. Other
    columns are ignored. Shards hold about ``shard_documents`` documents;
    queries visit each shard and stream past its index.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    n, mean_length, df = global_statistics(docs)
    shards = max(1, -(-n // shard_documents))

    def query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            bags = [terms for terms, _ in bags_of(b.column(1))]
            ids = np.repeat(b.column(0).to_numpy(), [len(t) for t in bags])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(bags) if bags else [], pa.int64())], ["query_id", "term"])

    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.coalesce("text", F.lit("")).alias("text")).where("query_id is not null")
    weight = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = arrow_map(asked, query_terms, "query_id long, term long").join(df, "term").select("query_id", "term", weight.alias("weight"))
    # the terms of one query in a row, each once however many rows have its id
    bags = weighted.groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct("term", "weight"))).alias("bag"))
    # by id and text, so that rows of a repeated id are dealt over all shards
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int")
    left = docs.select(place.alias("shard"), F.lit(0).alias("side"), F.col("doc_id").alias("id"), "text",
                       F.lit(None).cast("array<bigint>").alias("terms"), F.lit(None).cast("array<double>").alias("weights"))
    right = bags.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("side"),
                        F.col("query_id").alias("id"), F.lit(None).cast("string").alias("text"),
                        F.col("bag.term").alias("terms"), F.col("bag.weight").alias("weights"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, bags_, index = None, [], [], None
        for key, part in runs(batches, ["shard", "side"]):
            if at != key[0]:
                at, ids, bags_, index = key[0], [], [], None
            if key[1] == 0:
                ids += part["id"].to_pylist()
                bags_ += bags_of(part["text"])
                continue
            if index is None:
                index = Shard(ids, bags_, mean_length)
                ids, bags_ = [], []
            q, d, s = [], [], []
            for query, terms, weights in zip(part["id"].to_pylist(), part["terms"], part["weights"]):
                found, score, _ = index.search(terms.values.to_numpy(), weights.values.to_numpy(), k)
                q += [query] * len(found)
                d.append(found)
                s.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(np.concatenate(d), pa.int64()), pa.array(np.concatenate(s), pa.float64())],
                                             ["query_id", "doc_id", "score"])

    work = left.unionByName(right).repartition(shards, "shard").sortWithinPartitions("shard", "side", "id")
    found = arrow_map(work, look, "query_id long, doc_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
