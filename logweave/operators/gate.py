"""Novelty of formats: TF-IDF of character n-grams, distance to the nearest known lines, and a family classifier."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.quantiles import exact_quantile
from logweave.functions.text import settled
from logweave.sources.shared import cut, spread

GRAMS, MIN_DOCUMENTS, MOST_TERMS, NEIGHBOURS, FLOOR = (2, 3, 4), 2, 10_000, 3, 0.02
#: Rarest terms by which a bound is found, and how common they may be.
PROBES, PROBED = 8, 1000
#: Known vectors that one task multiplies, queries that it takes at least and at most, and numbers in one of its matrices.
KNOWN_ROWS, QUERY_ROWS, MOST_QUERIES, CELLS = 8192, 2048, 16384, 1 << 22
#: Texts that one task takes apart: each has some hundreds of n-grams.
TEXTS = 2000


def grams(text: Column) -> Column:
    """Character n-grams within words; a word has a space on either side."""
    words = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(n: int) -> Column:
        return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))))

    return F.concat(*map(of, GRAMS))


def vocabulary(lines: DataFrame, text: str = "text", copies: Column | None = None) -> DataFrame:
    """Terms of at least MIN_DOCUMENTS lines, at most MOST_TERMS, with idf = ln((1 + n) / (1 + df)) + 1; a row stands for copies lines."""
    copies = F.lit(1) if copies is None else copies
    n = lines.agg(F.sum(copies)).first()[0] or 0
    lines = spread(lines.select(copies.alias("copies"), text), rows=TEXTS)
    df = lines.select("copies", F.explode(F.array_distinct(grams(F.col(text)))).alias("term")).groupBy("term").agg(F.sum("copies").alias("df"))
    return df.where(F.col("df") >= MIN_DOCUMENTS).orderBy(F.desc("df"), "term").limit(MOST_TERMS).select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(lines: DataFrame, terms: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Unit vectors as rows (key, term, w); counts enter as 1 + ln. The vocabulary has at most MOST_TERMS rows and is broadcast."""
    # Texts are shuffled once, and their terms not.
    tf = spread(lines.select(key, text), key, rows=TEXTS).select(key, F.explode(grams(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    w = tf.join(F.broadcast(terms), "term").withColumn("w", (1 + F.log("n")) * F.col("idf"))
    return w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") ** 2).over(Window.partitionBy(key)))).select(key, "term", "w")


def _exact(pairs: DataFrame, query: DataFrame, known: DataFrame) -> DataFrame:
    """(q, x, dot) of pairs (q, x), rounded to what sums in any order agree on."""
    met = pairs.join(query.select(F.col("id").alias("q"), "term", F.col("w").alias("a")), "q").join(known.select(F.col("id").alias("x"), "term", F.col("w").alias("b")), ["x", "term"])
    return met.groupBy("q", "x").agg(F.round(F.sum(F.col("a") * F.col("b")), 9).alias("dot"))


def candidates(query: DataFrame, known: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """Pairs (q, x) among which are the k nearest of every query, and all as near as the last of them.

    The rarest terms of a query find some known vectors, and the k-th best of these is a bound: what comes in must reach
    it. Terms can add at most the sum of their weights times the largest in any known vector, and, as known vectors have
    unit length, the root of the sum of their squares. The commonest terms that together can not reach the bound need
    not be looked up, as a vector that has none but these is too far; theirs are the long lists.
    """
    terms = known.groupBy("term").agg(F.max("w").alias("most"), F.count("*").alias("df"))  # a row for each term of the vocabulary
    asked = query.join(F.broadcast(terms), "term").select(F.col("id").alias("q"), "term", "w", (F.col("w") * F.col("most")).alias("gain"), "df")
    asked = cut(asked)
    lists = known.select(F.col("id").alias("x"), "term")
    rare = asked.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("df", "term"))).where((F.col("nth") <= PROBES) & (F.col("df") <= PROBED))
    first = rare.join(lists, "term").groupBy("q", "x").agg(F.sum("gain").alias("gain"))
    first = first.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("gain"), "x"))).where(F.col("nth") <= 2 * k).select("q", "x")
    some = cut(_exact(first, query, known))
    bound = some.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("dot"), "x"))).where(F.col("nth") == k).select("q", F.col("dot").alias("bound"))
    longest_first = Window.partitionBy("q").orderBy(F.desc("df"), "term")
    reach = F.least(F.sum("gain").over(longest_first), F.sqrt(F.sum(F.col("w") ** 2).over(longest_first)))
    needed = asked.withColumn("reach", reach).join(bound, "q", "left").where(F.col("bound").isNull() | (F.col("reach") >= F.col("bound") - 1e-6))
    return needed.select("q", "term").join(lists, "term").select("q", "x").distinct()


def _placed(terms: DataFrame) -> DataFrame:
    """Different terms, at most MOST_TERMS, with their places in order."""
    return cut(terms.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("at")))


def _packed(vectors: DataFrame, places: DataFrame) -> DataFrame:
    """A row for each vector: id, and its terms' places with their weights. A tenth of the size of rows by term."""
    one = vectors.join(F.broadcast(places), "term").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "w"))).alias("v"))
    return cut(one.select("id", F.col("v.at").alias("at"), F.col("v.w").alias("w")))


def _dense(at: pa.Array, w: pa.Array, first: int, size: int, width: int) -> np.ndarray:
    """size vectors from the first on as rows of a matrix."""
    at, w = at.slice(first, size), w.slice(first, size)
    n = np.diff(at.offsets.to_numpy())
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), at.flatten().to_numpy()] = w.flatten().to_numpy()
    return out


def _products(query: DataFrame, known: DataFrame, width: int, k: int) -> DataFrame:
    """(q, x, dot) with, of each query and each block of known vectors, the k nearest of dot above 0, rounded to what sums in any order agree on.

    Every block of queries meets every block of known vectors in a task of its own as a sparse matrix times dense ones, so memory
    is bounded by CELLS, and what is shuffled by the vectors times the other side's blocks; no pairs are. Blocks of queries
    are as small as it takes to keep the cores busy.
    """
    width, x_blocks, n, cores = max(1, width), max(1, -(-known.count() // KNOWN_ROWS)), query.count(), query.sparkSession.sparkContext.defaultParallelism
    q_blocks = max(1, -(-n // MOST_QUERIES), min(-(-n // QUERY_ROWS), -(-cores // x_blocks)))
    dealt = lambda rows, n, others: rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    xs, qs = dealt(known, x_blocks, q_blocks), dealt(query, q_blocks, x_blocks)

    def best(q: pa.Table, x: pa.Table) -> pa.Table:
        found = [[], [], []]
        if len(q) and len(x):
            order = np.argsort(x.column("id").to_numpy(), kind="stable")
            x, q = x.take(order).combine_chunks(), q.combine_chunks()
            names, asked = x.column("id").to_numpy(), q.column("id").to_numpy()
            step, slab = max(1, CELLS // width), 256
            column = lambda t, c: t.column(c).chunk(0)
            at, w = column(q, "at"), column(q, "w")
            begins, at, w = at.offsets.to_numpy() - at.offsets[0].as_py(), at.flatten().to_numpy(), w.flatten().to_numpy()
            for b in range(0, len(x), step):
                right, kept = np.ascontiguousarray(_dense(column(x, "at"), column(x, "w"), b, step, width).T), []
                for a in range(0, len(q), slab):
                    # A query has few of the terms, so it takes their rows only.
                    ranges = [slice(begins[i], begins[i + 1]) for i in range(a, min(a + slab, len(q)))]
                    dot = np.round(np.stack([w[r] @ right[at[r]] for r in ranges]), 9)
                    m = min(k, dot.shape[1])
                    # Ties are broken by id: all above the m-th value, and the first of those equal to it.
                    bound = np.partition(dot, dot.shape[1] - m, axis=1)[:, -m][:, None]
                    equal = dot == bound
                    take = (dot > bound) | (equal & (np.cumsum(equal, axis=1) <= m - (dot > bound).sum(axis=1)[:, None]))
                    r, c = np.nonzero(take & (dot > 0))
                    kept.append((asked[a + r], names[b + c], dot[r, c]))
                for i, parts in enumerate(zip(*kept)):
                    found[i].extend(parts)
        return pa.table({n: pa.array(np.concatenate(v) if v else [], t) for n, v, t in zip(("q", "x", "dot"), found, (pa.int64(), pa.int64(), pa.float64()))})

    return qs.groupBy("block", "other").cogroup(xs.groupBy("other", "block")).applyInArrow(best, "q long, x long, dot double")


def nearest(query: DataFrame, known: DataFrame, k: int = NEIGHBOURS, copies: DataFrame | None = None) -> DataFrame:
    """Of each query vector the k nearest known ones: rows (q, x, dot, take); vectors are rows (id, term, w) of unit length.

    copies has rows (id, copies) where a known vector stands for more than one line, each of them a neighbour; take is
    how many of them count. Exact: all pairs are compared, block by block.
    """
    places = _placed(known.select("term").distinct())
    return _nearest(_packed(query, places), _packed(known, places), places.count(), k, copies)


def _nearest(query: DataFrame, known: DataFrame, width: int, k: int, copies: DataFrame | None) -> DataFrame:
    """nearest() of packed vectors."""
    dots = _products(query, known, width, k)
    best = Window.partitionBy("q").orderBy(F.desc("dot"), "x")
    dots = dots.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).drop("nth")  # limited before the shuffle
    dots = dots.withColumn("copies", F.lit(1)) if copies is None else dots.join(copies.select(F.col("id").alias("x"), "copies"), "x")
    before = F.coalesce(F.sum("copies").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dots.withColumn("take", F.least(F.col("copies"), k - before)).where("take > 0").select("q", "x", "dot", "take")


def distances(query: DataFrame, known: DataFrame, k: int = NEIGHBOURS, copies: DataFrame | None = None) -> DataFrame:
    """Mean Euclidean distance of each query vector to its k nearest known ones, and the nearest one.

    Distance follows from the dot product, sqrt(2) where no term is common.
    """
    places = _placed(known.select("term").distinct())
    got = _distances(_packed(query, places), _packed(known, places), places.count(), k, copies)
    return query.select("id").distinct().join(got, "id", "left").withColumn("distance", F.coalesce("distance", F.lit(round(2**0.5, 8))))


def _distances(query: DataFrame, known: DataFrame, width: int, k: int, copies: DataFrame | None) -> DataFrame:
    """distances() of packed vectors."""
    d = _nearest(query, known, width, k, copies).groupBy("q").agg(
        F.sum(F.col("take") * F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("dot")))).alias("s"), F.sum("take").alias("n"), F.max_by("x", F.struct("dot", -F.col("x"))).alias("nearest")
    )
    mean = (F.coalesce("s", F.lit(0.0)) + (k - F.coalesce("n", F.lit(0))) * 2**0.5) / k
    return query.select("id").join(d, F.col("id") == F.col("q"), "left").select("id", F.round(mean, 8).alias("distance"), "nearest")


def threshold(calibration: DataFrame, copies: Column | int = 1) -> float:
    """The 99th percentile of distances of known lines, not below FLOOR; a row stands for copies lines. Exact, and no task holds the column."""
    got = exact_quantile(calibration, F.col("distance"), 0.99, copies=F.lit(copies) if isinstance(copies, int) else copies).first()
    return max(FLOOR, got["quantile"] if got else 0.0)


def part_of(key: Column, parts: int, salt: str = "") -> Column:
    """A number below parts, by the MD5 of a key; what is dealt by it has nearly equal shares of every label."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 7), 16, 10).cast("long"), F.lit(parts)).cast("int")


def split(labelled: DataFrame, held_out: int = 5, key: str = "id", label: str = "label", buckets: int = 4096) -> DataFrame:
    """Adds held_out: of each label exactly n div held_out lines, those of the lowest hashes of label and key; keys of a label differ.

    Hashes are counted in buckets by label; lines below the bucket on the edge are in, those above out, and only the
    lines of that bucket, a few thousandths of a label, are put in order. A null label is one of its own.
    """
    name = F.concat(F.coalesce(F.col(label), F.lit("")), F.lit(":"), F.col(key).cast("string"))
    rows = labelled.withColumns({"_h": F.md5(name), "_l": F.coalesce(F.concat(F.lit("="), F.col(label)), F.lit("none"))})
    rows = rows.withColumn("_b", (F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("int"))
    w = Window.partitionBy("_l")
    counts = rows.groupBy("_l", "_b").agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_before", F.sum("_c").over(w.orderBy("_b")) - F.col("_c")).withColumn("_take", F.floor(F.sum("_c").over(w) / held_out))
    met = rows.join(counts, ["_l", "_b"])
    sure, never = F.col("_before") + F.col("_c") <= F.col("_take"), F.col("_before") >= F.col("_take")
    edge = met.where(~sure & ~never).withColumn("_nth", F.row_number().over(Window.partitionBy("_l").orderBy("_h", key)))
    edge = edge.withColumn("held_out", F.col("_nth") <= F.col("_take") - F.col("_before")).drop("_nth")
    rest = met.where(sure | never).withColumn("held_out", sure)
    return rest.unionByName(edge).drop("_h", "_l", "_b", "_c", "_before", "_take")


class Novelty:
    """A fitted gate: known masked texts with labels and copies, their vectors, the terms, and the threshold."""

    def __init__(self, known: DataFrame, calibration: DataFrame | None = None, margin: float = 1.0, limit: float | None = None, copies: Column | None = None):
        """known and calibration are rows (text, label), masked; lines that mask alike are vectors once and count as often as they occur. A row of either stands for copies lines."""
        copies = F.lit(1) if copies is None else copies
        rows = known.groupBy("text", "label").agg(F.sum(copies).alias("copies"))
        # The commonest label of a text; of equal ones the first, and null only without another.
        rows = rows.groupBy("text").agg(F.sum("copies").alias("copies"), F.min_by("label", F.struct(F.col("label").isNull().alias("a"), (-F.col("copies")).alias("b"), F.col("label"))).alias("label"))
        self.known = cut(rows.withColumn("id", F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long")))
        self.terms = vocabulary(self.known, copies=F.col("copies"))
        self.terms = cut(self.terms)
        self.places = _placed(self.terms)
        self.width = self.places.count()
        self.vectors = _packed(tfidf(self.known, self.terms), self.places)  # used for every text that is scored
        self.margin, self.limit = margin, limit
        if limit is None:
            scored = self.score(calibration.groupBy("text").agg(F.sum(copies).alias("copies")))
            self.limit = threshold(scored, F.col("copies"))

    def score(self, texts: DataFrame) -> DataFrame:
        """Adds distance and family_guess (the label of the nearest known text) to different texts (text, ...)."""
        keyed = texts.withColumn("id", F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long"))
        keyed = cut(keyed)
        found = _distances(_packed(tfidf(keyed, self.terms), self.places), self.vectors, self.width, NEIGHBOURS, self.known)
        # A text without a known term is the zero vector, at distance 1 from every unit vector.
        got = keyed.join(found, "id", "left").withColumn("distance", F.coalesce("distance", F.lit(1.0)))
        # Kept, as quantiles and reports read it several times.
        return cut(got.join(self.known.select(F.col("id").alias("nearest"), F.col("label").alias("family_guess")), "nearest", "left").drop("nearest", "id"))

    def __call__(self, masked: DataFrame) -> DataFrame:
        """(masked, novel, distance, family_guess) of different masked texts (masked), as decide() asks for."""
        got = self.score(masked.where("masked is not null").select(F.col("masked").alias("text")))
        return novel(got, self.limit, self.margin).select(F.col("text").alias("masked"), "novel", F.col("shown").alias("distance"), "family_guess")


def evaluate(scored: DataFrame, limit: float, margin: float = 1.0) -> DataFrame:
    """One row over (label, known, family_guess, distance, copies): accuracy on known labels, false alarms, and novelty caught."""
    n, flag = F.col("copies"), F.col("distance") > F.lit(limit * margin)
    share = lambda hit, of: F.sum(F.when(hit & of, n).otherwise(0)) / F.nullif(F.sum(F.when(of, n).otherwise(0)), F.lit(0))
    known = F.col("known")
    return scored.agg(share(F.col("family_guess") == F.col("label"), known).alias("accuracy"), share(flag, known).alias("false_alarm"), share(flag, ~known).alias("caught"))


class _GramParams(Params):
    inputCol = Param(Params._dummy(), "inputCol", "text", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vectors", TypeConverters.toString)
    terms = Param(Params._dummy(), "terms", "the vocabulary in order", TypeConverters.toListString)
    idf = Param(Params._dummy(), "idf", "a weight for each term", TypeConverters.toListFloat)
    copiesCol = Param(Params._dummy(), "copiesCol", "how many lines a row stands for; one without it", TypeConverters.toString)


class GramTfidfModel(Model, _GramParams, DefaultParamsReadable, DefaultParamsWritable):
    """Unit vectors of 1 + ln(count) times idf over a vocabulary of n-grams, which is kept as parameters (at most MOST_TERMS)."""

    def _transform(self, df: DataFrame) -> DataFrame:
        place = {t: i for i, t in enumerate(self.getOrDefault("terms"))}
        idf = np.array(self.getOrDefault("idf"))
        known = df.sparkSession.sparkContext.broadcast((place, idf))

        @F.udf(VectorUDT())
        def vector(terms):
            place, idf = known.value
            n = Counter(place[t] for t in terms or () if t in place)
            at = np.array(sorted(n), np.int32)
            w = (1 + np.log([n[i] for i in at.tolist()])) * idf[at] if len(at) else np.zeros(0)
            return SparseVector(len(idf), at, w / np.linalg.norm(w) if len(at) else w)

        # Settled first and after, as what follows in a pipeline would else take the function into expressions that can't run it.
        rows = settled(df.withColumn("_grams", grams(F.col(self.getOrDefault("inputCol")))))
        return settled(rows.withColumn(self.getOrDefault("outputCol"), vector("_grams")).drop("_grams"))


class GramTfidf(Estimator, _GramParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the vocabulary and its idf, ln((1 + n) / (1 + df)) + 1, by vocabulary()."""

    def __init__(self, inputCol: str = "text", outputCol: str = "x", copiesCol: str | None = None):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, copiesCol=copiesCol)

    def _fit(self, df: DataFrame) -> GramTfidfModel:
        copies = F.col(self.getOrDefault("copiesCol")) if self.isDefined("copiesCol") else None
        got = sorted((r["term"], r["idf"]) for r in vocabulary(df, self.getOrDefault("inputCol"), copies).collect())  # MOST_TERMS at most
        return GramTfidfModel()._set(inputCol=self.getOrDefault("inputCol"), outputCol=self.getOrDefault("outputCol"), terms=[t for t, _ in got], idf=[float(w) for _, w in got])


def fit_families(train: DataFrame, text: str = "text", label: str = "label", rounds: int = 100, tolerance: float = 1e-7) -> PipelineModel:
    """Family classifier: TF-IDF vectors and multinomial logistic regression, as one pipeline that can be saved.

    Equal lines are one row that weighs as many.
    """
    rows = cut(train.groupBy(text, label).agg(F.count("*").alias("_copies")))
    n = max(1, rows.agg(F.sum("_copies")).first()[0] or 0)
    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="y", handleInvalid="keep", stringOrderType="alphabetAsc"),
            GramTfidf(inputCol=text, outputCol="x", copiesCol="_copies"),
            LogisticRegression(featuresCol="x", labelCol="y", weightCol="_copies", regParam=1 / (8 * n), maxIter=rounds, tol=tolerance, standardization=False),
        ]
    ).fit(rows)


def predict(model: PipelineModel, lines: DataFrame, text: str = "text") -> DataFrame:
    """Adds family_guess."""
    names = model.stages[0].labels
    got = PipelineModel(model.stages[1:]).transform(lines)
    return got.withColumn("family_guess", F.get(F.array(*map(F.lit, names)), F.col("prediction").cast("int"))).drop("x", "rawPrediction", "probability", "prediction")


def novel(scored: DataFrame, limit: float, margin: float = 1.0) -> DataFrame:
    """Adds novel and the distance rounded to four places."""
    return scored.withColumn("novel", F.col("distance") > F.lit(limit * margin)).withColumn("shown", F.round("distance", 4))
