"""Ranked lexical search by windowed bucket scoring.

Every task indexes its documents: for each the terms of the items that it holds and how often. Scoring takes an
index file's documents in their order, numbers them, and goes through fixed windows of WINDOW numbers. The documents of
a window are inverted into postings; an item's postings are added term by term into one array of a score per
document, small enough for a core's cache, and a bitset marks the documents reached, by which the scores are harvested
into the item's heap. A window whose best possible score is below the heap's last is left out, which changes no
result. Each task returns its heaps, and the best of all heaps are the answer: no key is dealt out but the item's, and
no document meets another.

All documents are scored exactly, in 64-bit integers. Items are taken in blocks of about BLOCK_TERMS different
terms; what is sent to the tasks is one block, whatever the number of items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm import words as W
from logweave.llm.graph import cut, fresh_path, remove

WINDOW = 1 << 14  # documents; 128 KB of scores
POSTINGS = 1 << 20  # a window of long documents ends here
BLOCK_TERMS = 200_000
#: Terms are maximal runs of letters and digits of ASCII and of all other code points.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[c for c in range(128) if not chr(c).isalnum()]] = True


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    return np.concatenate(([0], np.flatnonzero(np.diff(sorted_keys)) + 1, [len(sorted_keys)])) if len(sorted_keys) else np.zeros(1, np.int64)


def _counted(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, term) in order and how often each occurs; doc is ascending."""
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return doc[at], term[at], np.diff(np.append(at, len(doc)))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        q = b.column("q").to_numpy(zero_copy_only=False)
        for w in W.slices(b.column("text"), lower=True, space_bytes=SEPARATORS):
            n = len(w.text) - 1
            item, term, times = _counted(np.repeat(np.arange(n), np.diff(w.first)), w.hashes().view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(q[w.row : w.row + n][item]), pa.array(term), pa.array(times.astype(np.int64))], names=["q", "term", "times"])


def _index(shared: Broadcast):
    """Of each document with a term: doc_id, its number of terms, and places in the vocabulary with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value["vocabulary"]
        for b in batches:
            for w in W.slices(b.column("text"), lower=True, space_bytes=SEPARATORS):
                size = np.diff(w.first)
                n = len(size)
                h = w.hashes().view(np.int64)
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                ours = np.flatnonzero(vocabulary[at] == h) if len(vocabulary) else np.zeros(0, np.int64)
                doc, term, tf = _counted(np.repeat(np.arange(n), size)[ours], at[ours])
                some = np.flatnonzero(size)
                edge = pa.array(np.append(np.searchsorted(doc, some), len(doc)).astype(np.int32))
                ids = b.column("doc_id").slice(w.row, n).take(pa.array(some))
                lists = (pa.ListArray.from_arrays(edge, pa.array(x.astype(np.int32))) for x in (term, tf))
                yield pa.RecordBatch.from_arrays([ids, pa.array(size[some].astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])

    return run


def _statistics(shared: Broadcast):
    """Documents per term of a task; under -1 the documents and under -2 their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(shared.value["vocabulary"]), np.int64)
        docs = length = 0
        for b in batches:
            df += np.bincount(b.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=len(df))
            docs += len(b)
            length += int(b.column("n").to_numpy(zero_copy_only=False).sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(df[some], [docs, length]))], names=["term", "n"])

    return run


class Heap:
    """The k best (score, smallest doc_id) of an item; a missing doc_id, here the largest number, is last among equals."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """What a document must reach to enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def offer(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = np.append(self.score, score), np.append(self.doc, doc), np.append(self.null, null)
        if len(score) > 8 * self.k:  # all that may tie with the last one stay
            keep = np.flatnonzero(score >= np.partition(score, len(score) - self.k)[len(score) - self.k])
            score, doc, null = score[keep], doc[keep], null[keep]
        best = np.lexsort((doc, null, -score))[: self.k]
        self.score, self.doc, self.null = score[best], doc[best], null[best]


class Scorer:
    """Heaps of a block of items over the windows that they are shown."""

    def __init__(self, block: dict, weights: np.ndarray, docs: int, length: int, k: int):
        self.first, self.term, self.times = block["first"], block["term"], block["times"]
        self.weights, self.docs, self.length = weights, docs, length
        self.heaps = [Heap(k) for _ in range(len(self.first) - 1)]

    def window(self, ids: np.ndarray, null: np.ndarray, n: np.ndarray, slot: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Scores documents 0 to len(ids) - 1 by their postings (slot, term, tf), in order of slot."""
        order = np.argsort(term, kind="stable")
        slot, term, tf = slot[order], term[order], tf[order].astype(np.int64)
        m = 25 + 75 * n * self.docs // self.length
        gain = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[slot]))
        edge = _runs(term)
        if len(edge) < 2:
            return
        most = np.zeros(len(self.weights), np.int64)
        most[term[edge[:-1]]] = np.maximum.reduceat(gain, edge[:-1])
        lo, hi = np.zeros(len(self.weights), np.int64), np.zeros(len(self.weights), np.int64)
        lo[term[edge[:-1]]], hi[term[edge[:-1]]] = edge[:-1], edge[1:]
        # The bitset of every term's documents, word by word.
        word, bit = slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64)
        part = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (term[1:] != term[:-1]))))
        bits, words = np.bitwise_or.reduceat(bit, part), word[part]
        wlo, whi = np.searchsorted(part, lo), np.searchsorted(part, hi)
        scores, reached = np.zeros(len(ids), np.int64), np.zeros((len(ids) + 63) // 64, np.uint64)
        best = np.add.reduceat(np.append(most[self.term] * self.times, 0), self.first[:-1]) if len(self.first) > 1 else np.zeros(0, np.int64)
        best[self.first[:-1] == self.first[1:]] = 0
        for q in np.flatnonzero(best > 0):
            heap = self.heaps[q]
            if best[q] < heap.least():
                continue
            scores[:] = 0
            reached[:] = 0
            for e in range(self.first[q], self.first[q + 1]):
                t = self.term[e]
                if lo[t] < hi[t]:
                    scores[slot[lo[t] : hi[t]]] += self.times[e] * gain[lo[t] : hi[t]]
                    reached[words[wlo[t] : whi[t]]] |= bits[wlo[t] : whi[t]]
            some = np.flatnonzero(reached)
            at = (some[:, None] * 64 + np.arange(64))[(reached[some][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1) > 0]
            at = at[scores[at] >= heap.least()]
            if len(at):
                heap.offer(scores[at], ids[at], null[at])


def _score(shared: Broadcast, numbers: Broadcast, k: int, width: int, postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        scorer = Scorer(block, *numbers.value, k)
        held: list[tuple] = []
        docs = size = 0

        def close() -> None:
            ids, null, n, count, term, tf = (np.concatenate(c) for c in zip(*held))
            scorer.window(ids, null, n, np.repeat(np.arange(len(ids)), count), term, tf)

        for b in batches:
            ids, n = b.column("doc_id"), b.column("n").to_numpy(zero_copy_only=False)
            null = np.asarray(ids.is_null())
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            terms, tfs = b.column("terms"), b.column("tfs")
            edge = terms.offsets.to_numpy().astype(np.int64)
            term, tf = terms.flatten().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False)
            edge = edge - edge[0]
            at = 0
            while at < len(ids):
                room = np.searchsorted(edge, edge[at] + postings - size, "right") - 1
                to = min(len(ids), at + width - docs, max(room, at + (not held)))
                if to > at:
                    cut_ = slice(edge[at], edge[to])
                    held.append((ids[at:to], null[at:to], n[at:to], np.diff(edge[at : to + 1]), term[cut_], tf[cut_]))
                    docs, size, at = docs + to - at, size + int(edge[to] - edge[at]), to
                if at < len(ids) or docs == width:
                    close()
                    held, docs, size = [], 0, 0
        if held:
            close()
        got = [(q, h) for q, h in zip(block["q"].tolist(), scorer.heaps) if len(h.score)]
        if got:
            q = np.repeat([q for q, _ in got], [len(h.score) for _, h in got])
            doc, null, score = (np.concatenate([getattr(h, c) for _, h in got]) for c in ("doc", "null", "score"))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(doc, mask=null), pa.array(score)], names=["q", "doc_id", "score"])

    return run


def _block(rows) -> dict:
    """One block's items: q, the vocabulary, and of each item the places of its terms and their repeats."""
    q, term, times = (rows.column(c).to_numpy() for c in ("q", "term", "times"))
    order = np.lexsort((term, q))
    q, term, times = q[order], term[order], times[order]
    vocabulary, place = np.unique(term, return_inverse=True)
    edge = _runs(q)
    return {"q": q[edge[:-1]], "first": edge, "term": place, "times": times, "vocabulary": vocabulary}


def search(docs: DataFrame, items: DataFrame, k: int = 10, width: int = WINDOW, postings: int = POSTINGS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents (doc_id, text).

    N documents have terms, L terms in all; df of them hold a term, which weighs floor(1000 ln((2 N + 2) / (2 df + 1))).
    A document of n terms has m = 25 + (75 n N) div L, and scores weight * ((10^9 tf) div (1000 tf + 8 m)) for each of
    the item's terms, repeats included; only scores above 0 are ranked, equal ones by doc_id. Null texts and texts
    without terms match nothing and are not in N. Every row of docs is a document of its own and every row of items an
    item, so repeated rows are ranked and answered each; a null doc_id comes last among equals. Empty tables give no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    asked = cut(items.select(F.monotonically_increasing_id().alias("q"), "item_id", F.coalesce("text", F.lit("")).alias("text")))
    terms = cut(asked.select("q", "text").mapInArrow(_item_terms, "q long, term long, times long"))
    blocks = max(1, math.ceil(terms.count() / block_terms))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = None
    for i in range(blocks):
        block = _block(terms.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).toArrow())
        if not len(block["q"]):
            continue
        shared = spark.sparkContext.broadcast(block)
        path = fresh_path(spark, "lexical-index")
        rows.mapInArrow(_index(shared), "doc_id long, n long, terms array<int>, tfs array<int>").write.parquet(path)
        index = spark.read.parquet(path)
        counted = index.select("n", "terms").mapInArrow(_statistics(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        known = {r["term"]: r["n"] for r in counted.collect()}  # at most one row for each term of the block
        n_docs, length = known.pop(-1, 0), known.pop(-2, 0)
        weights = np.zeros(len(block["vocabulary"]), np.int64)
        for t, df in known.items():
            weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        numbers = spark.sparkContext.broadcast((weights, n_docs, length))
        best = cut(index.mapInArrow(_score(shared, numbers, k, width, postings), "q long, doc_id long, score long"))
        remove(spark, path)
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "q long, doc_id long, score long")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", nth).where(F.col("rank") <= k).join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
