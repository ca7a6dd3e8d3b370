"""Near-duplicate embeddings by NN-descent.

Equal vectors of a label are one class; classes are compared. Neighbour lists start from random hyperplane cells and
are refined by joins of neighbours' neighbours: around every vector, those that list it and those it lists are
compared with each other, and each keeps its best. Lists whose members all reach the threshold are saturated and
may grow to twice their length. Edges over the threshold give components. The recall is measured with planted probes,
which needs no links in the data: about 2 sqrt(rows) vectors, each turned to a cosine just over the threshold, take part
in the search, and what counts is how many of them end in their vector's component. Rounds and cycles go on until
enough do; probes are left out of the result, and no pair is compared outside of the search.

Links are then counted exactly in each component by the angles to one member, its pivot. All members within half the
threshold's angle of the pivot are linked with each other and only counted; the others are compared, in blocks, with
those whose angle to the pivot differs by no more than the threshold's. A large group of near copies so costs one
comparison each; a component that is spread wide costs, at worst, the square of its size over BLOCK.

Cells and joins of popular vectors are split by a salted hash, so no task's share grows with a group.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.graph import components, cut

CELL, PART, BLOCK, BUCKET_ROWS = 96, 64, 256, 4096
TABLES, BITS = 4, 24
AUDIT, RECALL, SETTLED = 256, 0.99, 0.001
SLACK = 1e-6  # radians
ASK = 4096  # vectors at a time when all pairs are asked for
log = logging.getLogger(__name__)


def _unit(vectors) -> np.ndarray:
    """Unit vectors; the largest component is brought to 1 first, so that no square over- or underflows."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, initial=0.0)[:, None] if x.shape[1] else x
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def usable(embedding: str = "embedding") -> F.Column:
    """Not null, without null or non-finite components, and not zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(embedding).isNotNull() & ~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _cells(seed: int):
    """Rows (id, label, table, code) of each vector's cells; the label's number of bits comes with the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            ids, label, bits = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "bits"))
            vectors = b.column("embedding").to_pylist()
            code = np.zeros((TABLES, len(ids)), np.int64)
            dims = np.array([len(v) for v in vectors])
            for d in np.unique(dims):
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), TABLES * BITS))
                at = np.flatnonzero(dims == d)
                sign = (_unit([vectors[i] for i in at]) @ planes[d]).reshape(len(at), TABLES, BITS) > 0
                use = np.arange(BITS)[None, :] < bits[at][:, None]
                code[:, at] = (np.where(use[:, None, :], sign, False) * (1 << np.arange(BITS))).sum(axis=2).T
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label), pa.array(np.full(len(ids), t, np.int32)), pa.array(code[t])], names=["id", "label", "t", "code"])

    return run


_EDGE = "u long, v long, sim double"


def _best(ids: np.ndarray, s: np.ndarray, k: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the k[i] largest similarities above its floor, without itself."""
    np.fill_diagonal(s, -2.0)
    order = np.argsort(-s, axis=1, kind="stable")
    n = len(ids)
    ok = (np.arange(n)[None, :] < k[:, None]) & (np.take_along_axis(s, order, 1) > floor[:, None])
    i, r = np.nonzero(ok)
    j = order[i, r]
    return ids[i], ids[j], s[i, j]


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Best pairs within every group (g, salt, label, dims) of a bucket; rows carry id, embedding, k and the similarity to beat."""
    out = []
    for _, g in pdf.groupby(["g", "salt", "label", "dims"], sort=False):
        if len(g) > 1:
            x = _unit(g["embedding"])
            out.append(_best(g["id"].to_numpy(), x @ x.T, g["k"].to_numpy(), g["floor"].to_numpy()))
    u, v, s = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pd.DataFrame({"u": u, "v": v, "sim": s})


def _counting(compared):
    """_compare, and adds the pairs compared."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.groupby(["g", "salt", "label", "dims"]).size()
        compared.add(int((sizes * (sizes - 1) // 2).sum()))
        return _compare(pdf)

    return run


def _grouped(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """Splits groups g above most rows by a salted hash, and deals groups into buckets of about BUCKET_ROWS rows."""
    sizes = rows.groupBy("g").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("parts"))
    n = rows.count()
    salt = F.pmod(F.xxhash64(F.lit(seed), "id"), "parts").cast("int")
    return rows.join(sizes, "g").withColumn("salt", salt).withColumn("bucket", F.pmod(F.xxhash64("g", "salt"), F.lit(1 + n // BUCKET_ROWS)))


def _top(edges: DataFrame, state: DataFrame) -> DataFrame:
    """Of each u the k best distinct v."""
    w = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    one = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    return one.join(state.select(F.col("id").alias("u"), "k"), "u").withColumn("nth", F.row_number().over(w)).where("nth <= k").select("u", "v", "sim")


def _state(vectors: DataFrame, lists: DataFrame, threshold: float, k: int) -> DataFrame:
    """Per vector: length of its list (twice what it holds if saturated) and the similarity that a newcomer must beat."""
    have = lists.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("n"), F.min("sim").alias("least"))
    grow = (F.col("n") >= k) & (F.col("least") >= threshold)
    return vectors.join(have, "id", "left").select(
        "id",
        F.when(grow, 2 * F.col("n")).otherwise(F.greatest(F.coalesce("n", F.lit(0)), F.lit(k))).cast("int").alias("k"),
        F.when((F.col("n") >= k) & ~grow, F.col("least")).otherwise(F.lit(-2.0)).alias("floor"),
    )


def _round(vectors: DataFrame, lists: DataFrame, threshold: float, k: int, seed: int, compare) -> DataFrame:
    """The lists after comparing, around every vector, those that list it and those it lists."""
    state = cut(_state(vectors, lists, threshold, k))
    both = lists.select(F.col("u").alias("g"), F.col("v").alias("id")).unionByName(lists.select(F.col("v").alias("g"), F.col("u").alias("id")))
    around = cut(both.unionByName(lists.select(F.col("u").alias("g"), F.col("u").alias("id"))).distinct())
    rows = _grouped(around, PART, seed).join(vectors.join(state, "id"), "id")
    found = rows.groupBy("bucket").applyInPandas(compare, _EDGE).distinct().join(lists.select("u", "v"), ["u", "v"], "left_anti")
    return cut(_top(lists.unionByName(found), state))


def start(vectors: DataFrame, threshold: float, k: int, seed: int, compare, before: DataFrame | None = None) -> DataFrame:
    """Neighbour lists (u, v, sim) of vectors (id, label, dims, embedding) from random hyperplane cells, and of before."""
    per_label = vectors.groupBy("label").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / F.lit(CELL)))).cast("int").alias("bits"))
    cells = vectors.join(per_label, "label").select("id", "label", F.least("bits", F.lit(BITS)).alias("bits"), "embedding").mapInArrow(_cells(seed), "id long, label long, t int, code long")
    cells = cells.select("id", F.xxhash64("label", "t", "code").alias("g"))
    rows = _grouped(cells, 4 * CELL, seed).join(vectors, "id").withColumn("k", F.lit(k)).withColumn("floor", F.lit(-2.0))
    lists = rows.groupBy("bucket").applyInPandas(compare, _EDGE)
    lists = lists if before is None else lists.unionByName(before)
    return cut(_top(lists, _state(vectors, before if before is not None else vectors.select(F.col("id").alias("u"), F.lit(0.0).alias("sim")).limit(0), threshold, k)))


def probes(vectors: DataFrame, threshold: float, seed: int) -> DataFrame:
    """A seeded sample of the vectors, each turned at random to a cosine just over threshold; its id is -1 - the vector's.

    About 2 sqrt(rows) and at least AUDIT (all of a smaller table), so their share falls as the table grows. A vector
    of one component can't be turned and is planted as it is.
    """
    n = vectors.count()
    every = max(1, n // max(AUDIT, math.ceil(2 * n**0.5)))
    turn = math.acos(min(1.0, threshold + 0.02 * (1 - threshold)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for i, v in zip(pdf["id"], pdf["embedding"]):
                x = _unit([v])[0]
                r = np.random.default_rng([seed, int(i)]).standard_normal(len(x))
                r -= (r @ x) * x
                size = np.linalg.norm(r)
                made.append(math.cos(turn) * x + math.sin(turn) * r / size if size > 1e-6 else x)
            yield pdf.assign(id=-1 - pdf["id"], embedding=made)

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.where(F.pmod(F.xxhash64(F.lit(seed), F.lit("probe"), "id"), F.lit(every)) == 0).mapInPandas(run, f"id long, label long, dims int, embedding {kind}")


def joined_recall(lists: DataFrame, parts: DataFrame, planted: DataFrame, threshold: float) -> float:
    """The share of probes that are linked to their vector or to one of its component."""
    root = parts.select(F.col("node").alias("v"), "root")
    links = lists.where(F.col("sim") >= threshold)
    mine = links.where("u < 0 and v >= 0").select(F.col("u").alias("probe"), "v").unionByName(links.where("v < 0 and u >= 0").select(F.col("v").alias("probe"), F.col("u").alias("v")))
    mine = mine.distinct().join(root, "v", "left").withColumn("root", F.coalesce("root", "v")).withColumn("own", -1 - F.col("probe"))
    own = root.select(F.col("v").alias("own"), F.col("root").alias("own_root"))
    found = mine.join(own, "own", "left").where(F.col("root") == F.coalesce("own_root", "own")).select("probe").distinct()
    n = planted.count()
    return found.count() / n if n else 1.0


def every_pair(vectors: DataFrame, threshold: float) -> DataFrame:
    """All links (a, b), by comparing every vector with every other of its label: for audits, quadratic.

    ASK vectors at a time are sent to all tasks.
    """
    n = vectors.count()
    turns = max(1, math.ceil(n / ASK))
    out = None
    for i in range(turns):
        asked = vectors.where(F.pmod(F.xxhash64("id"), F.lit(turns)) == i).toPandas()
        shared = vectors.sparkSession.sparkContext.broadcast({key: (g["id"].to_numpy(), _unit(g["embedding"])) for key, g in asked.groupby(["label", "dims"])})

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for key, g in pdf.groupby(["label", "dims"]):
                    if key in shared.value:
                        ids, q = shared.value[key]
                        i, j = np.nonzero(_unit(g["embedding"]) @ q.T >= threshold)
                        a, b = g["id"].to_numpy()[i], ids[j]
                        yield pd.DataFrame({"a": a, "b": b})[a != b]

        links = cut(vectors.mapInPandas(run, "a long, b long"))
        out = links if out is None else out.unionByName(links)
    return out


def search(vectors: DataFrame, threshold: float, k: int = 8, rounds: int = 4, seed: int = 1, max_cycles: int = 3, compared=None) -> tuple[DataFrame, DataFrame, float]:
    """Links (a, b) found by NN-descent, components (node, root) of them, and the recall of planted probes.

    Probes take part in the search and are then left out. A round is the last if it linked hardly a
    vector (SETTLED of the linked ones) for the first time; a cycle, if enough probes are linked into their vector's component. Further cycles begin with
    new cells and the lists held. compared: an accumulator of the pairs compared.
    """
    compare = _compare if compared is None else _counting(compared)
    planted = cut(probes(vectors, threshold, seed))
    everyone = cut(vectors.unionByName(planted))
    lists, recall, parts = None, 0.0, None
    for cycle in range(max_cycles):
        at = seed + 1000 * cycle
        lists = start(everyone, threshold, k, at, compare, lists)
        linked = lists.where(F.col("sim") >= threshold).select("u").distinct().count()
        for turn in range(rounds):
            lists = _round(everyone, lists, threshold, k, at + 100 + turn, compare)
            before, linked = linked, lists.where(F.col("sim") >= threshold).select("u").distinct().count()
            if linked - before <= SETTLED * linked:
                break
        edges = cut(lists.where((F.col("sim") >= threshold) & (F.col("u") >= 0) & (F.col("v") >= 0)).select(F.col("u").alias("a"), F.col("v").alias("b")))
        parts = edges.select(F.col("a").alias("node"), F.col("a").alias("root")) if edges.isEmpty() else components(edges)
        recall = joined_recall(lists, parts, planted, threshold)
        log.info("cycle %d: recall %.4f of planted probes", cycle + 1, recall)
        if recall >= RECALL:
            break
    else:
        log.warning("recall %.4f of planted probes after %d cycles", recall, max_cycles)
    if not parts.isEmpty():
        more = at_borders(vectors, lists, parts, threshold)
        if not more.isEmpty():
            edges = edges.unionByName(more)
            parts = components(edges)
    return edges, parts, recall


def _link_counts(threshold: float):
    """Linked vectors (copies counted) of each class in the block pairs of a bucket."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, counts = [], []
        for (_, lo, hi), g in pdf.groupby(["root", "lo", "hi"], sort=False):
            x, copies, i = _unit(g["embedding"]), g["copies"].to_numpy(), g["id"].to_numpy()
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            block = g["block"].to_numpy()
            if lo != hi:
                near &= block[:, None] != block[None, :]
            ids.append(i)
            counts.append(near @ copies)
        return pd.DataFrame({"id": np.concatenate(ids), "links": np.concatenate(counts)})

    return run


def _angles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds to (root, id, copies, embedding, pivot) the angle between the two vectors; an arc tangent, exact for small angles."""
    for pdf in batches:
        out = []
        for _, g in pdf.groupby(pdf["embedding"].map(len), sort=False):
            x, p = _unit(g["embedding"]), _unit(g["pivot"])
            out.append(g.drop(columns="pivot").assign(angle=2 * np.arctan2(np.linalg.norm(x - p, axis=1), np.linalg.norm(x + p, axis=1))))
        if out:
            yield pd.concat(out)


def _around_pivots(inside: DataFrame) -> DataFrame:
    """Rows (root, id, copies, embedding) with their angle to the root's vector; every root must be a row of its own."""
    pivots = inside.where("id = root").select("root", F.col("embedding").alias("pivot"))
    return inside.join(pivots, "root").mapInPandas(_angles, "root long, id long, copies long, embedding array<double>, angle double")


def _bins(placed: DataFrame, theta: float) -> DataFrame:
    """Bin -1: within half the angle of the pivot, less what rounding could change; others by whole angles."""
    core = F.col("angle") <= max(0.0, theta / 2 - SLACK)
    return placed.withColumn("bin", F.when(core, -1).otherwise(F.floor(F.col("angle") / (theta + SLACK)).cast("int")))


def _place(b: F.Column, i: F.Column) -> F.Column:
    """One number for a block of a bin."""
    return b.cast("long") * F.lit(1 << 40) + i


def _dealt(rows: DataFrame, sizes: DataFrame, others: DataFrame, reach: F.Column) -> DataFrame:
    """Rows (root, bin, id, ...) in blocks of their bin, once for each block (other) of the others' bins in reach.

    sizes and others: (root, bin, blocks); reach is told of bin and obin.
    """
    near = sizes.withColumnRenamed("blocks", "own").join(others.select("root", F.col("bin").alias("obin"), "blocks"), "root").where(reach)
    near = near.groupBy("root", "bin", "own").agg(F.collect_list(F.struct("obin", "blocks")).alias("near"))
    rows = rows.join(near, ["root", "bin"]).withColumn("block", _place(F.col("bin"), F.pmod(F.xxhash64("id"), "own")))
    return rows.withColumn("o", F.explode("near")).withColumn("other", F.explode(F.transform(F.sequence(F.lit(0), F.col("o.blocks") - 1), lambda i: _place(F.col("o.obin"), i)))).drop("near", "o", "own")


def _block_counts(placed: DataFrame, *more: F.Column) -> DataFrame:
    return placed.groupBy("root", "bin").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"), *more)


def counts_inside(heads: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """Rows (id, links): the vectors, copies counted, to which each class of a component is linked."""
    theta = math.acos(max(-1.0, min(1.0, threshold)))
    inside = heads.join(parts, heads["id"] == parts["node"]).select("root", "id", "copies", "embedding")
    placed = cut(_bins(_around_pivots(inside), theta))
    sizes = cut(_block_counts(placed, F.sum("copies").alias("held")))
    # Half the angle and less can reach bins 0 and 1; a bin reaches its neighbours. Bin -1 is not compared with itself.
    reach = F.when(F.col("bin") < 0, F.col("obin").isin(0, 1)).when(F.col("obin") < 0, F.col("bin") <= 1).otherwise(F.abs(F.col("bin") - F.col("obin")) <= 1)
    rows = _dealt(placed, sizes.drop("held"), sizes, reach)
    pairs = rows.select("root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "copies", "embedding")
    buckets = 1 + placed.count() // 1024
    counted = pairs.withColumn("bucket", F.pmod(F.xxhash64("root", "lo", "hi"), F.lit(buckets))).groupBy("bucket").applyInPandas(_link_counts(threshold), "id long, links long")
    together = placed.where("bin < 0").join(sizes.where("bin < 0").select("root", "held"), "root").select("id", (F.col("held") - F.col("copies")).alias("links"))
    return counted.unionByName(together).groupBy("id").agg(F.sum("links").alias("links"))


def at_borders(vectors: DataFrame, lists: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between a component and vectors outside that have one of its members in their list, or are in one's.

    A list full of a large group's members may hold none of those that are linked. Such a vector is compared with the
    members whose angle to the component's pivot allows a link, in blocks; one link for each block that has any.
    """
    theta = math.acos(max(-1.0, min(1.0, threshold)))
    root = parts.select(F.col("node").alias("v"), "root")
    both = lists.where("u >= 0 and v >= 0").select("u", "v")
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met = both.join(root, "v").select("u", "root").distinct().join(root.select(F.col("v").alias("u"), F.col("root").alias("own")), "u", "left").where("own is null or own <> root")
    flat = vectors.select("id", F.lit(1).cast("long").alias("copies"), F.col("embedding").cast("array<double>").alias("embedding"))
    inside = flat.join(parts, flat["id"] == parts["node"]).select("root", "id", "copies", "embedding")
    members = cut(_bins(_around_pivots(inside), theta))
    outside = met.select(F.col("u").alias("id"), "root").join(flat, "id").join(inside.where("id = root").select("root", F.col("embedding").alias("pivot")), "root")
    outside = outside.select("root", "id", "copies", "embedding", "pivot").mapInPandas(_angles, "root long, id long, copies long, embedding array<double>, angle double")
    radius = members.groupBy("root").agg(F.max("angle").alias("radius"))
    visitors = outside.join(radius, "root").where(F.col("angle") <= F.col("radius") + theta + SLACK).drop("radius").withColumn("bin", F.floor(F.col("angle") / (theta + SLACK)).cast("int"))
    visitors = cut(visitors)
    if visitors.isEmpty():
        return visitors.select(F.col("id").alias("a"), F.col("id").alias("b"))
    reach = F.when((F.col("bin") < 0) | (F.col("obin") < 0), F.greatest("bin", "obin") <= 1).otherwise(F.abs(F.col("bin") - F.col("obin")) <= 1)
    there, here = _block_counts(members), _block_counts(visitors)
    rows = _dealt(members, there, here, reach).withColumn("visits", F.lit(False)).unionByName(_dealt(visitors, here, there, reach).select("*", F.lit(True).alias("visits")))
    own = F.when(F.col("visits"), F.col("other")).otherwise(F.col("block")).alias("lo")
    rows = rows.select("root", own, F.when(F.col("visits"), F.col("block")).otherwise(F.col("other")).alias("hi"), "visits", "id", "embedding")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby(["root", "lo", "hi"], sort=False):
            v, m = g[g["visits"]], g[~g["visits"]]
            if len(v) and len(m):
                s = _unit(v["embedding"]) @ _unit(m["embedding"]).T
                best = s.argmax(axis=1)
                ok = s[np.arange(len(v)), best] >= threshold
                out.append(pd.DataFrame({"a": v["id"].to_numpy()[ok], "b": m["id"].to_numpy()[best[ok]]}))
        return pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})

    buckets = 1 + visitors.count() // 256 + members.count() // 1024
    return cut(rows.withColumn("bucket", F.pmod(F.xxhash64("root", "lo", "hi"), F.lit(buckets))).groupBy("bucket").applyInPandas(run, "a long, b long"))


def link(vectors: DataFrame, threshold: float = 0.8, k: int = 8, seed: int = 1, max_cycles: int = 3, exact: bool = False, compared=None) -> DataFrame:
    """vec_id, n_links, component_id, kept and recall of every row (vec_id, label, embedding).

    Vectors are linked if their labels are equal and not null and their cosine in double precision is at least
    threshold. Null, zero and not finite vectors link with nothing; neither do vectors of different lengths. Rows that
    repeat vec_id, label and vector count once and are all returned; rows of one vec_id with other vectors are vectors
    of their own. recall is that of the search, the share of planted probes (vectors turned to a cosine just over the
    threshold) that it linked; links are found by the search alone, and with exact, for audits, by comparing all pairs.
    An empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    good = rows.where(usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    keyed = good.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(3), "embedding"))
    key = ["label", "h1", "h2"]
    classes = keyed.select("vec_id", *key).distinct().groupBy(*key).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    heads = keyed.join(classes, ["vec_id", *key]).dropDuplicates(key)
    heads = cut(heads.select(F.monotonically_increasing_id().alias("id"), "vec_id", *key, F.size("embedding").alias("dims"), "embedding", "copies"))
    flat = heads.select("id", "label", "dims", "embedding")
    edges, parts, recall = search(flat, threshold, k, seed=seed, max_cycles=max_cycles, compared=compared)
    if exact:
        edges = every_pair(flat, threshold)
        parts = components(edges)
    inside = heads.select("id", "copies", F.col("embedding").cast("array<double>").alias("embedding"))
    counted = inside.select("id", F.lit(0).cast("long").alias("links")).limit(0) if parts.isEmpty() else counts_inside(inside, parts, threshold)
    known = heads.select("id", "vec_id", "copies", *key).join(parts, heads["id"] == parts["node"], "left").withColumn("root", F.coalesce("root", "id"))
    least = known.groupBy("root").agg(F.min("vec_id").alias("c"))
    named = known.join(counted, "id", "left").join(least, "root").select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "c")
    got = rows.withColumn("h1", F.when(usable(), F.xxhash64("embedding"))).withColumn("h2", F.when(usable(), F.xxhash64(F.lit(3), "embedding"))).drop("embedding")
    # A null vec_id is in no class of its own, whatever its vector.
    n, c = (F.when(F.col("vec_id").isNotNull(), F.col(x)) for x in "nc")
    return got.join(named, key, "left").select(
        "vec_id",
        F.coalesce(n, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(c, "vec_id").alias("component_id"),
        F.coalesce(F.coalesce(c, "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
        F.lit(recall).alias("recall"),
    )
