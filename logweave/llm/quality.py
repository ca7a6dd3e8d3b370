"""Quality by pairwise ranking: Bradley-Terry scores learned from preferences, and a threshold at a quantile of the scores.

A preference says that one document is better than another. Labels give preferences: each document of a bounded
sample meets a few of the other label, chosen by seeded hashes, so their number grows with the documents and not with
their product. P(a before b) = 1 / (1 + exp(-(s(a) - s(b)))) with s(d) = w . x(d), fitted by Newton steps on the
penalised logistic loss of the feature differences. x(d) are shares of the whole text (symbols, capitals, repeated
words and the like), each by its place among the sample's quantiles and as a number.

The threshold is the quantile of the scores of all labelled documents, not only the sample's, at the share of worse
ones among them. A document's score is its probability to come before one at the threshold, moved so that the
threshold has ACCEPT.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.quantiles import exact_quantile
from logweave.llm import words as W
from logweave.llm.graph import cut

#: Bounds of what fitting looks at: labelled documents, and opponents of each.
TRAIN_ROWS, OPPONENTS = 20_000, 4
BINS, RIDGE, ACCEPT = 8, 1.0, 0.3
FEATURES = ("words", "word_length", "symbols", "marks", "digits", "capitals", "wide", "repeated", "distinct", "commonest", "no_letters", "ends_odd", "lines", "long_words")


def _classes() -> np.ndarray:
    """Of each byte: 1 a small letter, 2 a capital, 3 a digit, 4 a mark of ordinary prose, 5 another symbol, 6 white space, 7 part of a wider character."""
    out = np.full(256, 5, np.uint8)
    out[[*range(0x61, 0x7B)]], out[[*range(0x41, 0x5B)]], out[[*range(0x30, 0x3A)]] = 1, 2, 3
    out[[ord(c) for c in ".,;:!?'\"()-"]] = 4
    out[[*range(0x09, 0x0E), 0x20]] = 6
    out[0x80:] = 7
    return out


_CLASS = _classes()


def features(col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """First row and the feature rows of successive slices of whole texts."""
    for w in W.slices(col):
        kind = _CLASS[w.buf]
        n = len(w.text) - 1
        words = np.diff(w.first)
        some, of = np.maximum(words, 1), np.repeat(np.arange(n), words)
        run = [np.concatenate(([0], np.cumsum(kind == k))) for k in range(8)]
        count = lambda k: np.diff(run[k][w.text])
        letters, size = count(1) + count(2), np.maximum(np.diff(w.text) - count(6), 1)
        per_word = lambda which: np.bincount(of, which, n)
        length = w.end - w.start
        plain = sum(run[k][w.end] - run[k][w.start] for k in (1, 2, 7))
        h = w.hashes()
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        # Different words of each text, and how often its commonest one stands.
        order = np.lexsort((h, of))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
        at = np.flatnonzero(new)
        most = np.zeros(n)
        np.maximum.at(most, of[order][at], np.diff(np.append(at, len(h))))
        last = kind[w.end - 1] if len(h) else np.zeros(0, np.uint8)
        before = np.where(length > 1, kind[np.maximum(w.end - 2, 0)] if len(h) else 0, 1)
        x = np.empty((n, len(FEATURES)))
        x[:, 0] = np.log1p(words)
        x[:, 1] = np.diff(np.concatenate(([0], np.cumsum(length)))[w.first]) / some
        for j, k in ((2, 5), (3, 4), (4, 3)):
            x[:, j] = count(k) / size
        x[:, 5] = count(2) / np.maximum(letters, 1)
        x[:, 6] = count(7) / size
        x[:, 7] = per_word(again) / some
        x[:, 8] = per_word(new[np.argsort(order)] if len(h) else new) / some**0.8
        x[:, 9] = most / some * np.minimum(1, some / 20)
        x[:, 10] = per_word(plain == 0) / some
        x[:, 11] = per_word((last == 5) | ((last == 4) & np.isin(before, (4, 5)))) / some
        newline = np.concatenate(([0], np.cumsum(w.buf == 10)))
        x[:, 12] = np.diff(newline[w.text]) / some
        x[:, 13] = per_word(length > 24) / some
        yield w.row, x


_COLUMNS = ", ".join(f"{f} double" for f in FEATURES)


def _featured(keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, x in features(b.column("text")):
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(row, len(x)) for c in keep), *(pa.array(c) for c in x.T)], names=[*keep, *FEATURES])

    return run


@dataclass
class Ranking:
    """s(d) = weights . expand(x(d))."""

    edges: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Standardised features and, of each, one column for every edge that it is above."""
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        above = x[:, :, None] > self.edges[None, :, :]
        return np.hstack([z, above.reshape(len(x), -1)])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.expand(x[i : i + 4096]) @ self.weights for i in range(0, len(x), 4096)] or [np.zeros(0)])


def fit_pairs(x: np.ndarray, better: np.ndarray, worse: np.ndarray, bins: int = BINS, ridge: float = RIDGE) -> Ranking:
    """The ranking of documents with features x from preferences, given by row numbers; without preferences all score 0."""
    n = x.shape[1]
    if not len(better):
        return Ranking(np.zeros((n, 0)), np.zeros(n), np.ones(n), np.zeros(n))
    edges = np.quantile(x, np.arange(1, bins) / bins, axis=0).T
    model = Ranking(edges, x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9), np.zeros(n * bins))
    z = model.expand(x)
    for _ in range(40):
        s = z @ model.weights
        p = 1 / (1 + np.exp(np.clip(s[better] - s[worse], -30, 30)))  # of the wrong order
        # With one row per document in each sum, differences need not be laid out: grad = Z'g, Hessian = D'(v D) in blocks.
        g = np.bincount(better, p, len(x)) - np.bincount(worse, p, len(x))
        grad, hess = z.T @ g - ridge * model.weights, ridge * np.eye(z.shape[1])
        for i in range(0, len(better), 4096):
            d = z[better[i : i + 4096]] - z[worse[i : i + 4096]]
            q = p[i : i + 4096]
            hess += (d * (q * (1 - q))[:, None]).T @ d
        step = np.linalg.solve(hess, grad)
        step /= max(1.0, np.abs(step).max() / 2)
        model.weights += step
        if np.abs(step).max() < 1e-6:
            break
    return model


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def known_labels(labels: DataFrame) -> DataFrame:
    """One label (doc_id, good) per document outside the held-out fifth; the lowest of contradicting ones."""
    some = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality").where(~held_out())
    return some.groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))


def preferences(known: DataFrame, train_rows: int = TRAIN_ROWS, opponents: int = OPPONENTS, seed: int = 11) -> DataFrame:
    """Distinct (better, worse) ids of labelled documents (doc_id, good): each of a sample against a few of the other label.

    The sample takes the train_rows lowest seeded hashes; opponents are found by number, so no pairs but these are made.
    """
    chosen = cut(known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(train_rows))
    numbered = chosen.withColumn("nth", F.row_number().over(Window.partitionBy("good").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id")))  # train_rows at most
    size = {r["good"]: r["count"] for r in chosen.groupBy("good").count().collect()}
    if len(size) < 2:
        return chosen.select(F.col("doc_id").alias("better"), F.col("doc_id").alias("worse")).limit(0)
    drawn = chosen.select("doc_id", "good", F.explode(F.sequence(F.lit(1), F.lit(opponents))).alias("turn"))
    others = F.when(F.col("good"), size[False]).otherwise(size[True])
    drawn = drawn.select("doc_id", "good", (F.pmod(F.xxhash64(F.lit(seed + 2), "doc_id", "turn"), others) + 1).cast("int").alias("nth"))
    met = drawn.join(numbered.select((~F.col("good")).alias("good"), "nth", F.col("doc_id").alias("other")), ["good", "nth"])
    return met.select(F.when(F.col("good"), F.col("doc_id")).otherwise(F.col("other")).alias("better"), F.when(F.col("good"), F.col("other")).otherwise(F.col("doc_id")).alias("worse")).distinct()


def fit(docs: DataFrame, pairs: DataFrame) -> Ranking:
    """The ranking learned from preferences (better, worse) between ids of documents (doc_id, text).

    What comes to the driver is the pairs, and the features of the documents in them; bound their number. Of texts that
    share an id the least is taken; pairs with an id that has no text, and of an id with itself, are left out.
    """
    pairs = cut(pairs.where("better <> worse").distinct())
    ids = pairs.select(F.col("better").alias("doc_id")).union(pairs.select("worse")).distinct()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")  # as many as the pairs, which come to the driver too
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    x = texts.mapInArrow(_featured(("doc_id",)), f"doc_id long, {_COLUMNS}").toPandas().sort_values("doc_id")
    both = pairs.toPandas().sort_values(["better", "worse"])
    both = both[both["better"].isin(x["doc_id"]) & both["worse"].isin(x["doc_id"])]
    at = lambda c: np.searchsorted(x["doc_id"].to_numpy(), both[c].to_numpy())
    return fit_pairs(x[list(FEATURES)].to_numpy(), at("better"), at("worse"))


def rank(docs: DataFrame, model: Ranking) -> DataFrame:
    """doc_id, held_out and the ranking's value of every document; a null text is as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, x in features(b.column("text")):
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(row, len(x)) for c in ("doc_id", "held_out")), pa.array(model.scores(x))], names=["doc_id", "held_out", "value"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out().alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, value double")


def threshold(ranked: DataFrame, known: DataFrame, quantile: float | None = None) -> float:
    """The value at a quantile of all labelled documents; by default at the share of worse ones, halfway to the next better value.

    0 where no labelled document has a text.
    """
    labelled = cut(ranked.join(known, "doc_id").select("value", "good"))
    if quantile is None:
        n, bad = labelled.agg(F.count("*"), F.sum((~F.col("good")).cast("long"))).first()
        if not n:
            return 0.0
        # Between the ranks bad - 1 and bad.
        quantile = min(1.0, max(0.0, (bad - 0.5) / (n - 1))) if n > 1 else 0.0
    row = exact_quantile(labelled, F.col("value"), quantile).first()
    return row["quantile"] if row else 0.0


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, opponents: int = OPPONENTS, quantile: float | None = None, accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= accept) of every document (doc_id, text).

    Labels are learned from outside the held-out fifth; labels, language, source and id enter no score. Null and empty
    texts are scored by the features of an empty text. Repeated rows are all scored, alike if their texts are. Without
    labels of both kinds every score is accept, so nothing is refused. An empty table gives no rows; other columns are
    ignored.
    """
    known = cut(known_labels(labels))
    pairs = preferences(known, train_rows, opponents)
    model = fit(docs, pairs)
    ranked = cut(rank(docs, model))
    level = threshold(ranked, known, quantile) if model.weights.any() else 0.0
    move = level - math.log(accept / (1 - accept))
    # The logistic function of a difference of 0 may round below accept.
    value = F.when(F.col("value") == level, accept).otherwise(1 / (1 + F.exp(F.lit(move) - F.col("value"))))
    got = ranked.select("doc_id", "held_out", value.alias("score"))
    return got.withColumn("predicted", F.when(F.col("score") >= accept, 1).otherwise(0))
