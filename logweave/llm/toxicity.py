"""Toxicity from a learned lexicon, matched by a Levenshtein automaton over the lexicon's trie.

The lexicon is learned from a bounded sample of labelled documents: word beginnings that are frequent in toxic and
rare in clean ones. All terms form one trie; the automaton of edit distance 1 is run over the trie as a whole and
made deterministic, so a word is looked up in one pass: exact for a word that begins with a term, fuzzy for a whole
word one edit away from a term of at least FUZZY_FROM letters, or for one that begins so with a term of at least
STEM_FROM. Scripts written without spaces have a word at every character. Hits inside quotation marks and hits with
others in their window of words are counted apart, and a logistic model of the counts gives the score.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import words as W
from logweave.llm.graph import cut

#: Bound of what fitting looks at: labelled documents.
TRAIN_ROWS = 20_000
#: Letters of a term: at least, and at most; a longer word is learned by its beginning. Scripts without spaces: 2, and at most.
SHORTEST, LONGEST, LONGEST_UNSPACED = 3, 32, 8
#: Edges that an automaton may have (some 100 MB while it is made); entries of a table of all classes.
MOST_EDGES, DENSE = 4_000_000, 4_000_000
SLICE_BYTES = 1 << 18
FUZZY_FROM, STEM_FROM = 5, 7
MIN_WEIGHT, LEAST, LEAST_SHARE, NEAR_WORDS = 3.0, 3, 0.015, 8
WORD = re.compile(r"[^\W_]+")
#: Thai to Burmese, Khmer, kana, ideographs.
UNSPACED = ((0x0E00, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
FEATURES = ("exact", "quoted", "fuzzy", "fuzzy_quoted", "dense")
_POINTS = 0x110000


@dataclass
class Automaton:
    """States are numbers; 0 is the dead state, 1 the first. A letter's class is its place in letters, from 1; all others have 0.

    default: where a state goes by any letter without an edge of its own; edge: state * classes + class in order, and to
    where it leads. table has the same for all classes, where that is small. exact: a term was read; near: a word ending
    here is one edit from a term; stem: so is what was read of a long term.
    """

    letters: list[str]
    default: np.ndarray
    edge: np.ndarray
    to: np.ndarray
    exact: np.ndarray
    near: np.ndarray
    stem: np.ndarray

    @cached_property
    def classes(self) -> np.ndarray:
        out = np.zeros(_POINTS, np.int32)
        out[[ord(c) for c in self.letters]] = np.arange(1, len(self.letters) + 1)
        return out

    @cached_property
    def table(self) -> np.ndarray | None:
        n = len(self.letters) + 1
        if len(self.default) * n > DENSE:
            return None
        out = np.repeat(self.default[:, None], n, axis=1)
        out.ravel()[self.edge] = self.to
        return out

    def step(self, state: np.ndarray, kind: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[state, kind]
        key = state.astype(np.int64) * (len(self.letters) + 1) + kind
        at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        return np.where(self.edge[at] == key, self.to[at], self.default[state])

    def run(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """1 for exact, 2 for fuzzy, 0 for other words given as ranges of code points."""
        out = np.zeros(len(start), np.int8)
        live, state = np.arange(len(start)), np.ones(len(start), np.int32)
        at = 0
        while len(live):
            over = start[live] + at == end[live]
            done = live[over]
            out[done[self.near[state[over]]]] = 2
            live, state = live[~over], state[~over]
            state = self.step(state, self.classes[points[start[live] + at]])
            hit = self.exact[state]
            out[live[self.stem[state]]] = 2
            out[live[hit]] = 1
            go = (state > 0) & ~hit
            live, state = live[go], state[go]
            at += 1
        return out


def automaton(terms: list[str], fuzzy_from: int = FUZZY_FROM, stem_from: int = STEM_FROM, most_edges: int = MOST_EDGES) -> Automaton:
    """The deterministic automaton of a lexicon; states are sets of (trie node, edits).

    What all letters have in common is made once for a state, and further targets only for letters with an edge from
    one of its nodes. Nodes that only short terms pass need no edited states. More than most_edges edges raise.
    """
    nodes: list[dict[str, int]] = [{}]
    ends: dict[int, int] = {}
    longest = [0]
    for t in terms:
        at = 0
        longest[0] = max(longest[0], len(t))
        for c in t:
            if c not in nodes[at]:
                nodes[at][c] = len(nodes)
                nodes.append({})
                longest.append(0)
            at = nodes[at][c]
            longest[at] = max(longest[at], len(t))
        ends[at] = len(t)
    letters = sorted({c for n in nodes for c in n})
    kind = {c: i + 1 for i, c in enumerate(letters)}
    fuzzy = [longest[n] >= fuzzy_from for n in range(len(nodes))]
    # The nodes one edit away by a letter left out, or written for another.
    below = [tuple((m, 1) for m in n.values() if fuzzy[m]) for n in nodes]

    known: dict[frozenset, int] = {frozenset(): 0}
    order: list[frozenset] = [frozenset()]
    default, edge, to = [], [], []

    def number(states: set) -> int:
        key = frozenset(states)
        if key not in known:
            known[key] = len(order)
            order.append(key)
        return known[key]

    number({(0, 0), *below[0]})
    for i, states in enumerate(order):
        common: set = set()
        by_letter: dict[str, set] = {}
        for n, e in states:
            if e == 0:
                common.update(below[n])
                if fuzzy[n]:
                    common.add((n, 1))
            for c, m in nodes[n].items():
                if e == 0:
                    by_letter.setdefault(c, set()).update(((m, 0), *below[m]))
                elif fuzzy[m]:
                    by_letter.setdefault(c, set()).add((m, 1))
        default.append(number(common))
        for c in sorted(by_letter):
            edge.append(i * (len(letters) + 1) + kind[c])
            to.append(number(common | by_letter[c]))
        if len(edge) > most_edges:
            raise ValueError(f"the automaton of {len(terms)} terms has more than {most_edges} edges; fit with a larger LEAST_SHARE or MIN_WEIGHT")
    rank = np.argsort(np.array(edge, np.int64))
    flags = [np.array([any(test(n, e) for n, e in s) for s in order]) for test in (lambda n, e: e == 0 and n in ends, lambda n, e: ends.get(n, 0) >= fuzzy_from, lambda n, e: ends.get(n, 0) >= stem_from)]
    return Automaton(letters, np.array(default, np.int32), np.array(edge, np.int64)[rank], np.array(to, np.int32)[rank], *flags)


_KIND = np.full(_POINTS, -1, np.int8)  # 0 no letter, 1 a letter, 2 one of a script without spaces; filled as code points are met


def kinds(points: np.ndarray) -> np.ndarray:
    out = _KIND[points]
    for c in np.unique(points[out < 0]).tolist():
        _KIND[c] = 0 if not WORD.match(chr(c)) else 2 if any(a <= c <= z for a, z in UNSPACED) else 1
    return _KIND[points] if (out < 0).any() else out


_MARKS = [ord(c) for c in "\"“”«»„"]


def features(col: pa.Array, a: Automaton) -> Iterator[tuple[int, np.ndarray]]:
    """First row and the feature rows of successive slices of texts."""
    for w in W.slices(col, limit=SLICE_BYTES):
        raw = w.buf.tobytes()
        texts = [raw[x:y].decode("utf-8", "replace").lower() for x, y in zip(w.text[:-1], w.text[1:])]
        n = len(texts)
        edge = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = kinds(points)
        step = np.diff(np.concatenate(([0], (kind > 0).view(np.int8), [0])))
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if (kind == 2).any():
            every = np.union1d(start, np.flatnonzero(kind == 2))
            start, end = every, end[np.searchsorted(start, every, "right") - 1]
        got = a.run(points, start, end)
        hit = np.flatnonzero(got)
        out = np.zeros((n, len(FEATURES)))
        if len(hit):
            doc = np.searchsorted(edge, start[hit], "right") - 1
            # Inside quotation: an odd number of marks since the line began.
            marks = np.concatenate(([0], np.cumsum(np.isin(points, _MARKS))))
            line = np.maximum.accumulate(np.where(points == 10, np.arange(len(points)) + 1, 0))
            before = start[hit]
            since = np.where(before > 0, line[np.maximum(before - 1, 0)], 0)
            quoted = (marks[before] - marks[since]) % 2 == 1
            fuzzy = got[hit] == 2
            for k, which in enumerate((~fuzzy & ~quoted, ~fuzzy & quoted, fuzzy & ~quoted, fuzzy & quoted)):
                out[:, k] = np.log1p(np.bincount(doc[which], minlength=n))
            close = (np.diff(hit) <= NEAR_WORDS) & (np.diff(doc) == 0)
            out[:, 4] = np.log1p(np.bincount(doc[1:][close], minlength=n))
        yield w.row, out


@dataclass
class Beginnings:
    """Different beginnings of the words of a slice of texts: document, hash, where and how long."""

    points: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    at: np.ndarray
    size: np.ndarray

    def text(self, i: int) -> str:
        return self.points[self.at[i] : self.at[i] + self.size[i]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def beginnings(col: pa.Array) -> Iterator[tuple[int, Beginnings]]:
    """First row and the beginnings of successive slices of whole texts, hashed as arrays: SHORTEST to LONGEST letters of a
    word, and 2 to LONGEST_UNSPACED code points from each one of a script without spaces."""
    for w in W.slices(col, limit=SLICE_BYTES):
        raw = w.buf.tobytes()
        texts = [raw[x:y].decode("utf-8", "replace").lower() for x, y in zip(w.text[:-1], w.text[1:])]
        edge = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = kinds(points)
        step = np.diff(np.concatenate(([0], (kind > 0).view(np.int8), [0])))
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        free = np.flatnonzero(kind == 2)
        room = end[np.searchsorted(start, free, "right") - 1] - free
        p, inv = W.powers(0xD1342543DE82EF95, len(points) + 1)
        run = np.concatenate(([np.uint64(0)], np.cumsum(W.mix(points.astype(np.uint64) + np.uint64(1)) * p[: len(points)])))
        doc, hashed, at, size = [], [], [], []
        for k in range(2, LONGEST + 1):
            here = [start[end - start >= k]] if k >= SHORTEST else []
            if k <= LONGEST_UNSPACED:
                here.append(free[room >= k])
            a = np.unique(np.concatenate(here)) if here else np.zeros(0, np.int64)
            if not len(a):
                continue
            h = W.mix((run[a + k] - run[a]) * inv[a] + np.uint64(k))
            d = np.searchsorted(edge, a, "right") - 1
            first = np.lexsort((h, d))  # once for each document
            new = np.ones(len(first), bool)
            new[1:] = (h[first][1:] != h[first][:-1]) | (d[first][1:] != d[first][:-1])
            keep = first[new]
            doc.append(d[keep])
            hashed.append(h[keep].view(np.int64))
            at.append(a[keep])
            size.append(np.full(len(keep), k))
        none = np.zeros(0, np.int64)
        yield w.row, Beginnings(points, *(np.concatenate(c) if c else none for c in (doc, hashed, at, size)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic and clean documents per beginning, summed by task in runs of about a million."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, of = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
        n = np.concatenate([c for _, c in held])
        return key, *(np.bincount(of, c, len(key)).astype(np.int64) for c in n.T)

    for b in batches:
        toxic = b.column("toxic").to_numpy(zero_copy_only=False)
        for row, x in beginnings(b.column("text")):
            is_toxic = toxic[row + x.doc] == 1
            key, of = np.unique(x.hash, return_inverse=True)
            held.append((key, np.stack([np.bincount(of, c, len(key)) for c in (is_toxic, ~is_toxic)], axis=1)))
            size += len(key)
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([*map(pa.array, summed())], names=["f", "toxic", "clean"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([*map(pa.array, summed())], names=["f", "toxic", "clean"])


def _spelled(hashes: np.ndarray):
    """(f, term) of the beginnings with these hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, str] = {}
        for b in batches:
            for _, x in beginnings(b.column("text")):
                for i in np.flatnonzero(np.isin(x.hash, hashes)).tolist():
                    if x.hash[i] not in seen:
                        seen[int(x.hash[i])] = x.text(i)
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.string())], names=["f", "term"])

    return run


def lexicon(toxic: dict[str, int]) -> list[str]:
    """Terms from the toxic document counts of telling word beginnings.

    The shortest beginning that tells toxic from clean is extended letter by letter while one longer beginning keeps
    nine tenths of its documents, so a word is learned whole and a word family by its common part.
    """
    longer = defaultdict(list)
    for f in toxic:
        longer[f[:-1]].append(f)
    found, seen = [], set()
    for f in sorted(toxic, key=lambda f: (len(f), f)):
        if any(f[:k] in seen for k in range(2, len(f))):
            continue
        seen.add(f)
        while best := [g for g in longer[f] if toxic[g] >= 0.9 * toxic[f]]:
            f = max(best, key=lambda g: (toxic[g], g))
        found.append(f)
    return found


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the constant last) by Newton steps on the penalised likelihood."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        step /= max(1.0, np.abs(step).max() / 5)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[Automaton, np.ndarray | None, list[str]]:
    """Automaton, weights and lexicon from at most train_rows labelled documents outside the held-out fifth.

    The sample takes the lowest seeded hashes of doc_id; contradicting labels of one document count as toxic, and of
    texts that share a doc_id the least is taken. A term is in at least LEAST toxic documents of the sample and in
    LEAST_SHARE of them, with log-odds of MIN_WEIGHT at least. Without labels of both kinds there are no terms and no
    weights, and every score is 0.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = known.where(~held_out()).orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(train_rows)
    # At most train_rows rows of two numbers are broadcast.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = cut(rows)
    size = dict(rows.groupBy("toxic").count().collect())
    if not size.get(0) or not size.get(1):
        return automaton([]), None, []
    counts = rows.select("text", "toxic").mapInArrow(_count, "f long, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = lambda c, n: F.log((F.col(c) + 0.5) / (n + 1))
    telling = counts.where((F.col("toxic") >= max(LEAST, LEAST_SHARE * size[1])) & (share("toxic", size[1]) - share("clean", size[0]) >= MIN_WEIGHT))
    often = {r["f"]: r["toxic"] for r in telling.select("f", "toxic").collect()}
    spelled = rows.where("toxic = 1").select("text").mapInArrow(_spelled(np.array(sorted(often), np.int64)), "f long, term string").groupBy("f").agg(F.min("term").alias("term"))
    terms = lexicon({r["term"]: often[r["f"]] for r in spelled.collect()})
    a = automaton(terms)
    seen = rows.mapInArrow(_features_of(a), "toxic int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    seen = seen.sort_values(list(seen.columns))
    return a, fit_logistic(seen[list(FEATURES)].to_numpy(), seen["toxic"].to_numpy(float)), terms


def _features_of(a: Automaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, x in features(b.column("text"), a):
                yield pa.RecordBatch.from_arrays([b.column("toxic").slice(row, len(x)), *(pa.array(c) for c in x.T)], names=["toxic", *FEATURES])

    return run


_SCORES = "score double, predicted int, n_exact int, n_quoted int, n_fuzzy int"


def _scored(a: Automaton, weights: np.ndarray | None, keep: list[str]):
    """Batches of the columns in keep and the scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, x in features(b.column("text"), a):
                score = np.zeros(len(x)) if weights is None else 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
                n = (np.expm1(x[:, k]).round().astype(np.int32) for k in range(3))
                made = [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), *map(pa.array, n)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(row, len(x)) for c in keep), *made], names=[*keep, "score", "predicted", "n_exact", "n_quoted", "n_fuzzy"])

    return run


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_exact, n_quoted and n_fuzzy of every document.

    A null text is scored as an empty one, by the constant alone. Repeated rows are all scored; an empty table
    gives no rows. Without labels of both kinds all scores are 0. Labels, language, source and id enter no score;
    other columns are ignored.
    """
    a, weights, _ = fit(docs, labels, train_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out().alias("held_out"))
    return rows.mapInArrow(_scored(a, weights, ["doc_id", "held_out"]), f"doc_id long, held_out boolean, {_SCORES}")


def keep_clean(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents not predicted toxic, all columns kept, whatever their names; null texts stay null.

    Every row is judged by its own text, so repeated rows and rows with null or equal doc_id stay or go one by one.
    Without labels of both kinds all stay; an empty table gives no rows.
    """
    a, weights, _ = fit(docs, labels, train_rows)
    inner = {c: c if c == "text" else f"c_{c}" for c in docs.columns}
    rows = docs.withColumnsRenamed(inner)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    got = rows.mapInArrow(_scored(a, weights, rows.columns), f"{schema}, {_SCORES}").where("predicted = 0")
    return got.select(*(F.col(f"`{inner[c]}`").alias(c) for c in docs.columns))
