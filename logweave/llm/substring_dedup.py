"""Repeated passages by relative Lempel-Ziv parsing against everything that comes earlier.

The reference is all text before a place: documents with a smaller doc_id, and the same document's earlier words.
It is indexed in blocks: every window of WINDOW words has an anchor, the leftmost smallest hash among its
ANCHOR-word grams, and the windows that share an anchor place make one block, at most 2 * WINDOW words long. Equal
blocks meet by (anchor, block hash); of each the first place is kept as reference. A document looks up all its
blocks: one equal to an earlier one lies in a factor as a whole and refers to the first equal block. Where blocks of
one anchor differ (a factor begins or ends inside), their first places are compared window by window, and a window
refers to the first equal one.

Each document is then parsed from left to right. A factor (start, words, reference document, reference start) begins
at a window with a reference and is extended greedily, word by word, as long as the reference goes on with the same
words; the next factor begins where it ends. At such a boundary the windows across it are checked too: if one has a
reference of its own, the rest of its run follows as the next factor, however short. Factors so cover just the words
of windows that occur earlier, and are the duplicate spans.

What is shuffled is one small row per block (about an eighth of the words), aggregated by minimum; an anchor
that occurs in very many documents is only pre-aggregated or joined on its own hash. Hashes are 64 bits each and
always compared in pairs (anchor with block, anchor with window).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import words as W
from logweave.llm.graph import cut

WINDOW, ANCHOR = 20, 6


class Blocks:
    """Blocks of the texts of a slice: anchor place, first and last window, hashes, and the text each is from."""

    def __init__(self, w: W.Words, window: int = WINDOW, k: int = ANCHOR):
        h = w.hashes()
        self.run = W.gram_sums(h)
        n = len(h)
        counts = np.diff(w.first)
        width = window - k + 1
        if n < window:
            self.at = self.lo = self.hi = self.doc = np.zeros(0, np.int64)
            self.a = self.c = np.zeros(0, np.int64)
            return
        i = np.arange(n - k + 1)
        gram = W.span_hash(self.run, i, i + k)
        best, span = i, 1
        while span * 2 <= width:
            best = self._lower(gram, best[:-span], best[span:])
            span *= 2
        if span < width:
            best = self._lower(gram, best[: len(best) - (width - span)], best[width - span :])
        doc = np.repeat(np.arange(len(counts)), counts)
        s = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
        if not len(s):
            self.at = self.lo = self.hi = self.doc = np.zeros(0, np.int64)
            self.a = self.c = np.zeros(0, np.int64)
            return
        at, d = best[s], doc[s]
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (d[1:] != d[:-1]))))
        self.at, self.doc, self.lo = at[new], d[new], s[new]
        self.hi = s[np.concatenate((new[1:] - 1, [len(s) - 1]))]
        self.a = gram[self.at].view(np.int64)
        self.c = W.mix(W.span_hash(self.run, self.lo, self.hi + window) + (self.at - self.lo).astype(np.uint64)).view(np.int64)

    @staticmethod
    def _lower(gram: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(gram[right] < gram[left], right, left)

    def windows(self, which: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Block, start and hash of every window of the given blocks."""
        n = self.hi[which] - self.lo[which] + 1
        block = np.repeat(which, n)
        s = np.repeat(self.lo[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return block, s, W.span_hash(self.run, s, s + window).view(np.int64)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("doc_id")
        for w in W.slices(b.column("text")):
            x = Blocks(w)
            _, keep = np.unique(W.mix(x.a.view(np.uint64) + W.mix(x.c.view(np.uint64)) + W.mix(x.doc.astype(np.uint64))), return_index=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.a[keep]), pa.array(x.c[keep]), ids.take(pa.array(x.doc[keep] + w.row)), pa.array((x.at - w.first[x.doc])[keep].astype(np.int32))], names=["a", "c", "doc_id", "at"]
            )


def _marked(col: pa.Array, row: int, n: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Text and fields of the flattened lists of structs of n rows from row on."""
    part = col.slice(row, n)
    sizes = np.nan_to_num(np.asarray(pc.list_value_length(part).to_numpy(zero_copy_only=False), float)).astype(np.int64)
    flat = part.flatten()
    return np.repeat(np.arange(n), sizes), {flat.type.field(i).name: flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(flat.type.num_fields)}


def _blocks_at(x: Blocks, w: W.Words, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Indices of the blocks whose anchors lie at the given places of the given texts."""
    return np.searchsorted(x.at, w.first[doc] + at)


def _edge_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if pc.sum(pc.list_value_length(b.column("part"))).as_py():
            b = b.filter(pc.greater(pc.list_value_length(b.column("part")), 0))
            ids = b.column("doc_id")
            for w in W.slices(b.column("text")):
                x = Blocks(w)
                doc, part = _marked(b.column("part"), w.row, len(w.first) - 1)
                block, s, h = x.windows(np.unique(_blocks_at(x, w, doc, part["at"])))
                doc = x.doc[block]
                yield pa.RecordBatch.from_arrays([pa.array(x.a[block]), pa.array(h), ids.take(pa.array(doc + w.row)), pa.array((s - w.first[doc]).astype(np.int32))], names=["a", "h", "doc_id", "s"])


def _again_inside(x: Blocks) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that occur earlier in the same text, and where they occur first."""
    key = W.mix(x.a.view(np.uint64) + W.mix(x.doc.astype(np.uint64)))
    _, inv, n = np.unique(key, return_inverse=True, return_counts=True)
    which = np.flatnonzero(n[inv] > 1)
    block, s, h = x.windows(which)
    key = W.mix(h.view(np.uint64) + W.mix(x.a[block].view(np.uint64)) + W.mix(x.doc[block].astype(np.uint64)))
    _, first, inv = np.unique(key, return_index=True, return_inverse=True)
    again = np.delete(np.arange(len(s)), first)
    return s[again], s[first][inv[again]]


def factor(has: np.ndarray, ref: np.ndarray, at: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors (first word, words, first window of the run) from the reference (document, place) of each window that has one."""
    i = np.flatnonzero(has)
    if not len(i):
        return i, i, i
    goes_on = (i[1:] == i[:-1] + 1) & (doc[i[1:]] == doc[i[:-1]]) & (ref[i[1:]] == ref[i[:-1]]) & (at[i[1:]] == at[i[:-1]] + 1)
    run = i[np.concatenate(([True], ~goes_on))]
    end = i[np.concatenate((~goes_on, [True]))] + window
    start = np.maximum(run, np.concatenate(([0], np.maximum.accumulate(end)[:-1])))
    keep = end > start
    return start[keep], (end - start)[keep], run[keep]


_FACTOR = [pa.field("start", pa.int32()), pa.field("words", pa.int32()), pa.field("ref_doc", pa.int64()), pa.field("ref_start", pa.int32())]


def _factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("doc_id")
        for w in W.slices(b.column("text")):
            x, n = Blocks(w), len(w.first) - 1
            counts, words = np.diff(w.first), len(w.start)
            doc = np.repeat(np.arange(n), counts)
            has, own, ref, at = np.zeros(words, bool), np.zeros(words, bool), np.zeros(words, np.int64), np.zeros(words, np.int64)
            s, first = _again_inside(x)
            has[s] = own[s] = True
            ref[s], at[s] = doc[s], first - w.first[doc[s]]
            d, whole = _marked(b.column("whole"), w.row, n)
            block = _blocks_at(x, w, d, whole["at"])
            nth = np.zeros(len(x.at), np.int64)
            nth[block] = np.arange(len(block))
            block, s, _ = x.windows(block)
            has[s], own[s], ref[s], at[s] = True, False, whole["ref_doc"][nth[block]], whole["ref_at"][nth[block]] + s - x.at[block]
            d, edge = _marked(b.column("starts"), w.row, n)
            s = w.first[d] + edge["s"]
            has[s], own[s], ref[s], at[s] = True, False, edge["ref_doc"], edge["ref_s"]
            start, size, run = factor(has, np.where(own, ~ref, ref), at, doc)
            delta = np.zeros(words + 1, np.int64)
            delta[start] += 1
            np.subtract.at(delta, start + size, 1)
            gone = np.cumsum(delta[:-1]) > 0
            of = doc[start]
            removed = np.bincount(of, size, n).astype(np.int64)
            raw, digests = w.buf.tobytes(), []
            for i in range(n):
                text = raw[w.text[i] : w.text[i + 1]].split()
                if removed[i]:
                    text = [t for t, g in zip(text, gone[w.first[i] : w.first[i + 1]].tolist()) if not g]
                digests.append(hashlib.sha256(b" ".join(text)).hexdigest())
            source = pc.if_else(pa.array(own[run]), ids.take(pa.array(of + w.row)), pa.array(ref[run]))
            shape = [pa.array((start - w.first[of]).astype(np.int32)), pa.array(size.astype(np.int32)), source, pa.array((at[run] + start - run).astype(np.int32))]
            factors = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), pa.StructArray.from_arrays(shape, fields=_FACTOR))
            yield pa.RecordBatch.from_arrays([ids.slice(w.row, n), pa.array(counts.astype(np.int64)), pa.array(removed), pa.array(digests, pa.string()), factors], names=["doc_id", "n_words", "n_removed", "kept_sha256", "factors"])


def parse(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and factors (start, words, ref_doc, ref_start) of every document.

    Windows are judged on the input. Null and empty texts, and texts under WINDOW words, lose nothing. Rows with
    equal doc_id count as one document among themselves: neither is earlier. A null doc_id is compared with
    nothing but itself. An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = docs.mapInArrow(_index, "a long, c long, doc_id long, at int").where("doc_id is not null")
    place = F.struct("doc_id", "at")
    again = blocks.groupBy("a").agg(F.min(place).alias("first"), F.max("doc_id").alias("last"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("first.doc_id < last")
    met = blocks.join(again.select("a", "first", (F.col("c0") != F.col("c1")).alias("differ")), "a")
    whole = met.where("not differ and doc_id > first.doc_id").select("doc_id", "at", "first", F.lit(True).alias("whole"))
    part = met.where("differ").select("a", "c", "doc_id", "at")
    heads = part.groupBy("a", "c").agg(F.min(place).alias("first"))
    part = part.join(heads, ["a", "c"]).select("doc_id", "at", "first", (F.col("doc_id") > F.col("first.doc_id")).alias("whole"))
    found = F.struct("at", F.col("first.doc_id").alias("ref_doc"), F.col("first.at").alias("ref_at"))
    lists = (F.collect_list(F.when(F.col("whole"), found)).alias("whole"), F.collect_list(F.when(~F.col("whole"), F.struct("at"))).alias("part"))
    marks = cut(whole.unionByName(part).groupBy("doc_id").agg(*lists))
    marked = docs.join(marks, "doc_id", "left")
    edge = marked.mapInArrow(_edge_windows, "a long, h long, doc_id long, s int")
    earliest = edge.groupBy("a", "h").agg(F.min(F.struct("doc_id", "s")).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last")
    found = F.struct("s", F.col("first.doc_id").alias("ref_doc"), F.col("first.s").alias("ref_s"))
    starts = cut(edge.join(earliest.drop("last"), ["a", "h"]).where("doc_id > first.doc_id").groupBy("doc_id").agg(F.collect_list(found).alias("starts")))
    return marked.join(starts, "doc_id", "left").select("doc_id", "text", "whole", "starts").mapInArrow(
        _factors, "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start:int,words:int,ref_doc:long,ref_start:int>>"
    )
