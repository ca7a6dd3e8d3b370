"""N-gram Jaccard join by partitioning the universe of shingles.

Two sets of Jaccard similarity >= t differ in at most (1 - t) / (1 + t) of their summed sizes. Sets are grouped in
overlapping bands of size; in a band, every shingle is hashed into one of m segments. By the pigeonhole principle
two similar sets agree in a segment, or (where the band's plan allows one difference) one set's segment is the
other's less one shingle. Signatures are therefore the segments' contents and, for such segments, their
one-deletion neighbourhoods; the plan of each band weighs the number of signatures against expected chance
matches. Empty segments are not signed: as many segments more are signed instead, and the few sets with more
empty segments than that sign the empty ones too. Candidates are verified exactly on the whole sets.

Of the smallest documents of its signatures, a document is first verified with the one it shares most with; only
members of one signature that are still in different components are then compared with each other: first by size and
by the sketch folded to 256 bits (exact bounds, some machine instructions a pair), then by the whole sketch, then by
the sets. No pair of one component is made, and no link between components is lost.

A signature in which more than HOT_PAIRS pairs would be compared (a licence's lines in documents that share nothing
else) is not compared so. Its documents meet by rare shingles: of two similar sets, each has one of the other's among
its n - ceil(t n) + 1 rarest shingles, in whatever order they are ranked, here by how many of those documents hold
them. Shingles held once meet nothing; members of one met often are dealt out to blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm import words as W
from logweave.llm.graph import components, cut

RATIO = 1.5
SKETCH = 512  # bits at least, a power of two
HOT_PAIRS = 1 << 25  # compared in one signature; some seconds of one task
BLOCK = 1024  # members of a shingle that one task pairs with all the others


class Bands:
    """Plan of the bands for a threshold given as a fraction num / den."""

    def __init__(self, num: int, den: int, ratio: float = RATIO):
        self.num, self.den, self.ratio = num, den, ratio
        self.plan = cache(self._plan)

    def differ(self, sizes: int) -> int:
        """Most shingles in which two similar sets of this summed size can differ."""
        return (self.den - self.num) * sizes // (self.den + self.num)

    def most(self, n: int) -> int:
        """The same for a set of n with any partner that is not smaller."""
        return self.differ(n + n * self.den // self.num)

    def low(self, band: int) -> int:
        return ceil(self.ratio**band - 1e-9)

    def of(self, n: int) -> list[int]:
        """Bands of a set: its own, and the one below if a smaller partner may be there."""
        b = 0
        while self.low(b + 1) <= n:
            b += 1
        return [b] if b == 0 or -(-n * self.num // self.den) >= self.low(b) else [b, b - 1]

    def _plan(self, band: int) -> tuple[int, int, int]:
        """(segments with one-deletion neighbourhoods, all segments, spare segments for empty ones)."""
        lo, hi = self.low(band), self.low(band + 1) - 1
        need = self.differ(hi + hi * self.den // self.num) + 1
        best = None
        for ones in range(0, min(4, (need + 1) // 2) + 1):
            m = ones + max(0, need - 2 * ones)
            if m == 0:
                continue
            w = lo / m
            empty = m * exp(-w)
            spare = ceil(empty + 3 * sqrt(empty)) if m > ones and lo > m else 0
            cost = ones * (1 + w) + (m - ones) + spare + 100 * m * exp(-w)
            if best is None or cost < best[0]:
                best = (cost, ones, m + spare, spare)
        return best[1:]


def shingle_sets(w: W.Words, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice; a text of fewer words is one shingle, none has none."""
    h = w.hashes()
    run = W.gram_sums(h)
    i = np.arange(max(0, len(h) - size + 1))
    gram = W.span_hash(run, i, i + size)
    for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if z - a >= size:
            s = np.sort(gram[a : z - size + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        else:
            yield W.span_hash(run, np.array([a]), np.array([z])) if z > a else np.zeros(0, np.uint64)


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    """All signatures of a set."""
    out = []
    for band in bands.of(len(s)):
        ones, m, spare = bands.plan(band)
        salt = np.uint64((band + 1) * 0x9E3779B97F4A7C15 >> 8)
        x = W.mix(s + salt)
        seg = ((x >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
        total = np.zeros(m, np.uint64)
        np.add.at(total, seg, x)
        held = np.bincount(seg, minlength=m)
        # Segments count 1, or 2 with deletions; the first ones that count enough for this size suffice.
        need = bands.most(len(s)) + 1
        use = min(m, max(ones, need - ones) + spare if need > ones else max(1, need))
        place = W.mix(np.arange(m, dtype=np.uint64) ^ (salt >> np.uint64(1)))
        whole = W.mix(total + place)
        plain = np.arange(min(ones, use), use)
        empty = held[plain] == 0
        out.append(whole[plain if empty.sum() > spare else plain[~empty]])
        if ones:
            out.append(whole[: min(ones, use)])
            near = seg < min(ones, use)
            out.append(W.mix(total[seg[near]] - x[near] + place[seg[near]]))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _sketch(s: np.ndarray) -> np.ndarray:
    """Parity sketch of about as many bits as shingles: bit b is the parity of the shingles hashed to it; two sets differ in at least as many shingles as their sketches in bits."""
    bits = SKETCH
    while bits < len(s):
        bits *= 2
    odd = np.bincount((W.mix(s ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_FOLDS = ("w0", "w1", "w2", "w3")
_INFO = "doc_id long, n long, f1 long, f2 long, sketch array<long>, " + ", ".join(f"{w} long" for w in _FOLDS)


def _info(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            for w in W.slices(b.column("text"), lower=True):
                n, f1, f2, sketches = [], [], [], []
                for s in shingle_sets(w, size):
                    n.append(len(s))
                    f1.append(int(W.mix(s).sum(dtype=np.uint64).view(np.int64)))
                    f2.append(int(W.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)))
                    sketches.append(_sketch(s))
                folds = np.array([np.bitwise_xor.reduce(x.reshape(-1, len(_FOLDS)), axis=0) for x in sketches]).T
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in sketches]))).astype(np.int32)), pa.array(np.concatenate(sketches)))
                cols = [ids.slice(w.row, len(n)), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), lists, *map(pa.array, folds)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "f1", "f2", "sketch", *_FOLDS])

    return run


def _sign(size: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for b in batches:
            ids = b.column("doc_id")
            for w in W.slices(b.column("text"), lower=True):
                sig = [signatures(s, bands) if len(s) else s for s in shingle_sets(w, size)]
                at = np.repeat(np.arange(len(sig)), [len(x) for x in sig]) + w.row
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), ids.take(pa.array(at))], names=["sig", "doc_id"])

    return run


def _prefix_sets(size: int):
    """Every shingle of every set, with the set's size and a hash that tells apart the sets of repeated ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            for w in W.slices(b.column("text"), lower=True):
                sets = list(shingle_sets(w, size))
                n = np.array([len(s) for s in sets], np.int64)
                f1 = np.array([W.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                at = np.repeat(np.arange(len(sets)), n)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + w.row)), pa.array(f1[at]), pa.array(n[at]), pa.array(np.concatenate(sets).view(np.int64))], names=["doc_id", "f1", "n", "gram"])

    return run


def _rare_meetings(docs: DataFrame, hot: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b), a < b, of the documents (doc_id, part) of hot signatures, of different parts, that share a shingle among their rarest; repeats stay."""
    sets = cut(docs.join(hot, "doc_id", "left_semi").mapInArrow(_prefix_sets(size), "doc_id long, f1 long, n long, gram long"))
    held = sets.groupBy("gram").agg(F.count("*").alias("df"))
    order = Window.partitionBy("doc_id", "f1").orderBy("df", "gram")
    ranked = sets.join(held, "gram").withColumn("nth", F.row_number().over(order))
    rare = ranked.where((F.col("df") > 1) & (F.col("nth") <= F.col("n") - F.ceil(F.col("n") * num / den) + 1))
    rare = cut(rare.select("gram", "doc_id").distinct().join(hot, "doc_id"))
    blocks = rare.groupBy("gram").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("part").alias("p0"), F.max("part").alias("p1")).where("p0 < p1")
    rare = rare.join(blocks.select("gram", "blocks"), "gram")
    x = rare.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).alias("x")
    y = rare.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    met = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.part") != F.col("y.part")))
    return met.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))


def _verify(size: int, num: int, den: int):
    """Keeps the pairs of texts that are similar, on their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            left = (s for w in W.slices(b.column("text_a"), lower=True) for s in shingle_sets(w, size))
            right = (s for w in W.slices(b.column("text_b"), lower=True) for s in shingle_sets(w, size))
            for s, t in zip(left, right):
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(den * both >= num * (len(s) + len(t) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _possible(num: int, den: int, a: str, b: str) -> Column:
    """Exact bounds: sizes in proportion, sketches no farther apart than similar sets can be. A sketch twice as long as the other is folded; if more, only sizes tell."""
    p, q = F.col(f"{a}.sketch"), F.col(f"{b}.sketch")
    k = F.least(F.size(p), F.size(q))
    xor = lambda x, y: x.bitwiseXOR(y)
    half = lambda c: F.when(F.size(c) == k, c).otherwise(F.zip_with(F.slice(c, 1, k), F.slice(c, k + 1, k), xor))
    apart = F.aggregate(F.zip_with(half(p), half(q), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return _near(num, den, a, b) & ((F.greatest(F.size(p), F.size(q)) > 2 * k) | (apart * (num + den) <= (n + m) * (den - num)))


def _near(num: int, den: int, a: str, b: str) -> Column:
    """The same by sizes and folded sketches alone; a fold of a sketch is a sketch of fewer bits, whatever its length."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in _FOLDS), F.lit(0))
    return (n * den >= m * num) & (m * den >= n * num) & (apart * (num + den) <= (n + m) * (den - num))


def join(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of every document; links are Jaccard >= num / den on shingles of size words.

    class_id is the smallest doc_id with the same shingle set, component_id the smallest doc_id reachable by links.
    Null, empty and wordless texts have an empty set and link with nothing, so both are their own doc_id. Rows
    with equal doc_id are joined by it. A null doc_id is returned with null ids and links with nothing. An empty
    table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    info = cut(docs.mapInArrow(_info(size), _INFO))
    known = info.where("n > 0 and doc_id is not null")
    classes = known.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    rep = known.join(classes, ["n", "f1", "f2"]).select("doc_id", "class_id").distinct()
    heads = known.join(rep.where("doc_id = class_id").select("doc_id"), "doc_id", "left_semi").select("doc_id", "n", "sketch", *_FOLDS).dropDuplicates(["doc_id"])
    signed = docs.where("doc_id is not null").mapInArrow(_sign(size, num, den), "sig long, doc_id long")
    met = signed.groupBy("sig").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("sig", "low")
    members = signed.join(met, "sig")

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of class heads that pass the bounds and the exact test."""
        x, y = heads.alias("x"), heads.alias("y")
        able = pairs.join(x, F.col("a") == F.col("x.doc_id")).join(y, F.col("b") == F.col("y.doc_id")).where(_possible(num, den, "x", "y")).select("a", "b")
        got = able.join(docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        return got.mapInArrow(_verify(size, num, den), "a long, b long")

    # Members by class: (sig, class) once each, and the smallest class of each signature.
    groups = members.join(rep, "doc_id").select("sig", F.col("class_id").alias("doc_id")).distinct()
    low = groups.groupBy("sig").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("sig", "low")
    groups = cut(groups.join(low, "sig"))
    # One edge per class to begin with: to that smallest class with which it shares most signatures.
    shared = groups.where("doc_id > low").groupBy("low", "doc_id").agg(F.count("*").alias("n"))
    star = cut(shared.groupBy(F.col("doc_id").alias("b")).agg(F.max_by("low", F.struct("n", -F.col("low"))).alias("a")).select("a", "b"))
    first = cut(verified(star))
    parts = components(first)
    placed = groups.join(parts, groups["doc_id"] == parts["node"], "left").select("sig", "doc_id", F.coalesce("root", "doc_id").alias("part"))
    split = placed.groupBy("sig").agg(F.min("part").alias("p0"), F.max("part").alias("p1")).where("p0 < p1").select("sig")
    crossing = cut(placed.join(split, "sig"))
    # Pairs to compare in a signature: all of its members less those of one part.
    sizes = crossing.groupBy("sig", "part").agg(F.count("*").alias("n")).groupBy("sig").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"))
    hot = cut(sizes.where((F.col("n") * F.col("n") - F.col("inside")) / 2 > HOT_PAIRS).select("sig"))
    few = hot.isEmpty()
    open_ = cut((crossing if few else crossing.join(hot, "sig", "left_anti")).join(heads, "doc_id"))
    x, y = open_.alias("x"), open_.alias("y")
    across = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.part") != F.col("y.part")) & _possible(num, den, "x", "y"))
    across = across.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    if not few:
        across = across.unionByName(_rare_meetings(docs, cut(crossing.join(hot, "sig", "left_semi").select("doc_id", "part").distinct()), size, num, den))
    across = across.distinct().join(star, ["a", "b"], "left_anti")
    links = first.unionByName(verified(cut(across)))
    roots = components(links)
    named = rep.join(roots, rep["class_id"] == roots["node"], "left").select("doc_id", "class_id", F.coalesce("root", "class_id").alias("component_id")).dropDuplicates(["doc_id"])
    return info.select("doc_id", F.col("n").alias("n_shingles")).join(named, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The documents, all columns kept, that are first of their component; documents without words and with null doc_id all stay.

    Rows that repeat a doc_id stay once, with the least text.
    """
    named = join(docs, size, num, den)
    heads = named.where("doc_id is not null and doc_id = component_id").select(F.col("doc_id").alias("_head")).distinct()
    kept = docs.join(heads, docs["doc_id"] == heads["_head"], "left_semi")
    again = kept.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_again"))
    once = kept.join(again, kept["doc_id"] == again["_again"], "left_anti")
    names = [c for c in docs.columns if c != "doc_id"]
    least = kept.join(again, kept["doc_id"] == again["_again"], "left_semi").groupBy("doc_id").agg(F.min(F.struct(F.col("text").alias("c_text"), *(F.col(c).alias(f"c_{c}") for c in names if c != "text"))).alias("r"))
    least = least.select(*(F.col("doc_id") if c == "doc_id" else F.col(f"r.c_{c}").alias(c) for c in docs.columns))
    return once.unionByName(least).unionByName(docs.where("doc_id is null"))
