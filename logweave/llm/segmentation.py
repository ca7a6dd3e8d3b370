"""SentencePiece encoding by distinct sampled segmentations, and decoding.

A text's segmentations into pieces of a given SentencePiece vocabulary form a lattice. Piece probabilities follow
Zipf's law over the model's own ranking; pieces never cross the boundary between a word and the space before the
next, so the lattice is a chain of word lattices, each built once per batch for all its occurrences.

Gumbel top-k without replacement: the whole lattice gets one Gumbel variable, the largest of all its paths'. Going
down a path, the chosen edge inherits it, and all other edges of a node together get a Gumbel truncated at it, with
the log-probability of their total mass for location. The queue of these rests is an A* search with exact bounds:
its largest is the next best segmentation, entered at that node by another edge. The k results are distinct, in
the order of their perturbed scores, and the (k+1)th score gives each its inclusion probability. Random numbers
come from a hash of the row key and a counter, so a row's result depends on nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from math import exp, inf, log
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import words as W

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, LITERAL = 0x2581, 0xF2581  # the mark for a space; stands in for the mark where the text has it itself
ZIPF_SHIFT = 10.0
_SLOT_BITS = 19
#: Texts are sampled together in runs of about this size; a task holds some hundred times as much for a while.
SLICE_BYTES = 512 << 10
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """piece: bytes of each id; logp of each id; byte: id of each byte; the trie, whose child by class c of node x is base[x] + c if that slot's parent is x; kind: class of each code point (0: in no piece); ends: piece that ends at a node, else -1."""

    piece: list[bytes]
    logp: np.ndarray
    byte: np.ndarray
    kind: np.ndarray
    base: np.ndarray
    parent: np.ndarray
    ends: np.ndarray

    def __post_init__(self):
        self.size = np.array(list(map(len, self.piece)), np.int32)
        self.at, self.flat = np.cumsum(self.size, dtype=np.int32) - self.size, np.frombuffer(b"".join(self.piece), np.uint8)
        self.score = np.append(self.logp, 3 * self.logp.min())  # the last, by -1: a code point without a piece
        self.prob = np.exp(self.score)


def _slots(nodes: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, parent, slot of each node) of a trie as a double array: many children first, single ones in the gaps; the root has slot 0, classes are from 1 on."""
    low = max((c for after in nodes for c in after), default=0) + 1
    free = np.ones(low + 2 * len(nodes) + max(map(len, nodes)), bool)
    by = {}
    order = sorted((x for x, after in enumerate(nodes) if after), key=lambda x: -len(nodes[x]))
    begin, last = low, 0
    for x in (x for x in order if len(nodes[x]) > 1):
        c = np.array(sorted(nodes[x]))
        if len(c) != last:
            begin, last = low, len(c)
        while True:
            if len(free) < begin + 512 + low:
                free = np.append(free, np.ones(len(free), bool))
            base = begin + np.flatnonzero(free[begin : begin + 512]) - c[0]
            fits = np.flatnonzero(free[base[:, None] + c].all(1))
            if len(fits):
                break
            begin += 512
        by[x] = int(base[fits[0]])
        free[by[x] + c] = False
    gaps = iter((low + np.flatnonzero(free[low:])).tolist())
    for x in (x for x in order if len(nodes[x]) == 1):
        by[x] = next(gaps) - next(iter(nodes[x]))
    slot = np.zeros(len(nodes), np.int32)
    for x, b in by.items():
        for c, to in nodes[x].items():
            slot[to] = b + c
    base, parent = np.zeros(int(slot.max()) + 1, np.int32), np.full(int(slot.max()) + 2 * low, -1, np.int32)
    for x, b in by.items():
        base[slot[x]] = b
        for to in nodes[x].values():
            parent[slot[to]] = slot[x]
    return base, parent, slot


def vocabulary(model: str | Path = MODEL) -> Vocabulary:
    """Read from a SentencePiece model file; pieces may hold the space mark only at their start."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=str(model))
    n = sp.get_piece_size()
    byte = np.full(256, -1, np.int32)
    pieces, nodes, ends, kinds = [], [{}], [-1], {}
    rank = sorted((i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))), key=lambda i: (-sp.get_score(i), i))
    logp = np.full(n, -np.log(n + ZIPF_SHIFT))
    logp[rank] = -np.log(np.arange(len(rank)) + ZIPF_SHIFT)
    for i in range(n):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte[int(p[1:-1], 16)] = i
            pieces.append(bytes([int(p[1:-1], 16)]))
            continue
        if sp.is_control(i) or sp.is_unknown(i):
            pieces.append(b"")
            continue
        if "▁" in p.lstrip("▁"):
            raise ValueError(f"piece {p!r} crosses a word boundary")
        pieces.append(p.replace("▁", " ").encode())
        at = 0
        for c in map(ord, p):
            c = kinds.setdefault(c, len(kinds) + 1)
            if c not in nodes[at]:
                nodes[at][c] = len(nodes)
                nodes.append({})
                ends.append(-1)
            at = nodes[at][c]
        ends[at] = i
    if (byte < 0).any():
        raise ValueError("the model has no byte pieces")
    base, parent, slot = _slots(nodes)
    kind, by_slot = np.zeros(0x110000, np.int32), np.full(len(base), -1, np.int32)
    kind[list(kinds)] = list(kinds.values())
    by_slot[slot] = ends
    return Vocabulary(pieces, logp - np.log(np.exp(logp).sum()), byte, kind, base, parent, by_slot)


class Lattices:
    """Lattices of many words: of each position the first edge and, per edge, source, target, piece, probability given the position and the running sum of these. Piece -1 stands for the bytes of a code point without a piece.

    Positions are numbered by their distance from the end of their word, so that sums run backwards over whole ranges: first the ends of all words, then all last code points, and so on. Longer words come first, so those that reach a distance are the first of it.
    """

    def __init__(self, v: Vocabulary, points: np.ndarray, end: np.ndarray, size: np.ndarray):
        """points: code points; end, size: where each word ends in them and how long it is. start: each word's first position."""
        self.words = words = len(size)
        rank = np.argsort(-size, kind="stable")
        size, end = size[rank], end[rank]
        count = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")  # words that reach a distance
        count = np.append(words, count)
        level = np.append(0, np.cumsum(count))
        self.start = np.empty(words, np.int32)
        self.start[rank] = level[size] + np.arange(words)
        n = int(level[-1])
        back = np.repeat(np.append(0, count[:-1]).astype(np.int32), count)  # from a position to the next one of its word
        nth = np.arange(n, dtype=np.int32) - np.repeat(level[:-1].astype(np.int32), count)
        self.points = points[end.astype(np.int32)[nth] - np.repeat(np.arange(len(count), dtype=np.int32), count).clip(1)]
        kind = v.kind[self.points]
        kind[:words] = 0
        src, node, cur = np.arange(words, n, dtype=np.int32), np.int32(0), slice(words, n)
        edges, fan = [], np.zeros(n, np.int32)
        while len(src):
            to = v.base[node] + kind[cur]
            ok = np.flatnonzero(v.parent[to] == node)
            src, node = src[ok], to[ok]
            cur = src - back[src] if isinstance(cur, slice) else cur[ok] - back[cur[ok]]
            piece = v.ends[node]
            done = np.flatnonzero(piece >= 0)
            at = src[done]
            place = fan[at]
            fan[at] = place + 1
            edges.append((at, place, cur[done], piece[done]))
        lone = (words + np.flatnonzero(fan[words:] == 0)).astype(np.int32)
        fan[lone] = 1
        letter = self.points[lone]
        edges.append((lone, np.zeros(len(lone), np.int32), lone - back[lone], np.where(letter < 128, v.byte[np.minimum(letter, 127)], -1)))
        self.first = np.zeros(n + 1, np.int32)
        np.cumsum(fan, out=self.first[1:])
        self.to, self.piece = np.empty(self.first[-1], np.int32), np.empty(self.first[-1], np.int32)
        for at, place, to, piece in edges:
            at = self.first[at] + place
            self.to[at], self.piece[at] = to, piece
        # Sums of probabilities as they are near the ends of words, as logarithms where they could be too small.
        cut = self.first[level]
        near = min(len(count), 2 + int(650 / -v.score[-1]))
        mass, p = np.ones(n), v.prob[self.piece]
        for d in range(1, near):
            a, z = cut[d], cut[d + 1]
            p[a:z] *= mass[self.to[a:z]]
            mass[level[d] : level[d + 1]] = np.add.reduceat(p[a:z], self.first[level[d] : level[d + 1]] - a)
        p[: cut[near]] /= np.repeat(mass[: level[near]], fan[: level[near]])
        if near < len(count):
            np.log(mass[: level[near]], out=mass[: level[near]])
            score = v.score[self.piece[cut[near] :]]
            for d in range(near, len(count)):
                a, z = cut[d], cut[d + 1]
                x = score[a - cut[near] : z - cut[near]] + mass[self.to[a:z]]
                g = self.first[level[d] : level[d + 1]] - a
                top = np.maximum.reduceat(x, g)
                many = fan[level[d] : level[d + 1]]
                mass[level[d] : level[d + 1]] = top = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, many)), g))
                p[a:z] = np.exp(x - np.repeat(top, many))
        self.p, self.src = p, np.repeat(np.arange(n, dtype=np.int32), fan)
        run = np.zeros(len(p) + 1)
        np.cumsum(p, out=run[1:])
        before = run[self.first[words:-1]]
        self.run = run[1:]
        self.run -= np.repeat(before, fan[words:])
        self.run[self.first[words + 1 :] - 1] = np.inf

    def choose(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        e = self.first[at]
        low = np.flatnonzero(u >= self.run[e])
        own, u = e[low], u[low]
        while len(low):
            own += 1
            e[low] = own
            go = np.flatnonzero(u >= self.run[own])
            low, own, u = low[go], own[go], u[go]
        return e

    def walk(self, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of the sampled paths from the given positions to the ends of their words, and the number of each path's."""
        live, who, steps = at, np.arange(len(at), dtype=np.int32), []
        length = np.zeros(len(at), np.int64)
        while len(live):
            e = self.choose(live, uniform(key, np.uint64(len(steps))))
            steps.append((who, e))
            length[who] = len(steps)
            live = self.to[e]
            go = np.flatnonzero(live >= self.words)
            live, who, key = live[go], who[go], key[go]
        begin = np.cumsum(length) - length
        took = np.empty(int(length.sum()), np.int32)
        for i, (who, e) in enumerate(steps):
            took[begin[who] + i] = e
        return took, length


def mix2(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(key: np.ndarray, salt: np.uint64) -> np.ndarray:
    """Numbers in (0, 1) from keys."""
    x = mix2(key + np.uint64(int(salt) * int(_SPREAD) & (2**64 - 1))) >> np.uint64(11)
    return (x.astype(float) + 0.5) * (1 / (1 << 53))


def _below(location: float, bound: float, u: float) -> float:
    """A Gumbel variable of the given location, truncated at bound."""
    return location - log(exp(min(700.0, location - bound)) - log(u)) if location > -inf else -inf


class Rest:
    """All paths that leave a found path at its node start or later, but by none of the tried edges: one Gumbel variable for their total mass.

    The mass that leaves at each node falls with the probability of the path so far, so only the nodes before
    it is below the precision of a double beside the first are listed.
    """

    def __init__(self, x: Lattices, number: int, path: np.ndarray, start: int, before: float, tried: tuple, bound: float, u: float):
        self.number, self.start, self.before, self.tried = number, start, before, tried
        span = 64
        while True:
            head = path[start : start + span]
            p = x.p[head]
            after = p.cumprod()
            if len(head) < span or after[-1] < 1e-19:
                break
            span *= 4
        mass = 1.0 - p  # an only edge has exactly 1
        if tried and len(head):
            node = x.src[head[0]]
            mass[0] = max(0.0, mass[0] - sum(x.p[e] for e in tried)) if x.first[node + 1] - x.first[node] > len(tried) + 1 else 0.0
        mass[1:] *= after[:-1]
        self.mass = mass
        self.draw(bound, u)

    def draw(self, bound: float, u: float) -> None:
        self.run = self.mass.cumsum()
        total = float(self.run[-1]) if len(self.run) else 0.0
        self.value = _below(self.before + log(total), bound, u) if total > 0 else -inf


def sample(x: Lattices, word: np.ndarray, first: np.ndarray, keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k distinct segmentations: (edges, log-probability, perturbed score, inclusion).

    word: first positions of all words of all texts; first: the index of each text's first word, one more at the end.
    All texts of a batch walk together, each by the random numbers of its own key.
    """
    n = len(first) - 1
    base = mix2(keys.astype(np.int64).view(np.uint64))
    spare = uniform(base[:, None] + np.arange(1, 4 * k + 2, dtype=np.uint64)[None, :] * np.uint64(0xBF58476D1CE4E5B9), np.uint64(1 << 40))
    text_of = np.repeat(np.arange(n), np.diff(first))
    place = (np.arange(len(word)) - first[text_of]).astype(np.uint64)
    took, length = x.walk(word, base[text_of] + place * np.uint64(0x94D049BB133111EB))
    who, cut = np.repeat(np.arange(len(word), dtype=np.int32), length), np.append(0, np.cumsum(length))[first]
    sums = np.append(0.0, np.cumsum(np.log(x.p[took])))
    found, rests = [], []
    for d in range(n):
        a, z = cut[d], cut[d + 1]
        path, bound = took[a:z], -log(-log(spare[d, 0]))
        found.append([(path, who[a:z], float(sums[z] - sums[a]), bound)])
        rests.append([Rest(x, 0, path, 0, 0.0, (), bound, spare[d, 1])])
    open_ = range(n)
    for turn in range(1, k):
        plans, states, state_text, state_word = [], [], [], []
        for d in open_:
            best = max(rests[d], key=lambda r: r.value)
            if best.value == -inf:
                continue
            u1, u2, u3, u4 = spare[d, 4 * turn - 2 : 4 * turn + 2]
            score = best.value
            at = min(int(best.run.searchsorted(u1 * best.run[-1], "right")), len(best.run) - 1)
            old, own, *_ = found[d][best.number]
            j = best.start + at
            used = (*(best.tried if at == 0 else ()), int(old[j]))
            best.mass[at] = 0.0
            best.draw(score, u2)
            node = x.src[old[j]]
            edges = [e for e in range(x.first[node], x.first[node + 1]) if e not in used]
            run = x.p[edges].cumsum()
            e = edges[min(len(edges) - 1, int(run.searchsorted(u3 * run[-1], "right")))]
            w = int(own[j])
            inside = bool(x.to[e] >= x.words)
            plans.append((d, best.number, j, e, w, used, score, u4))
            if inside:
                states.append(np.array([x.to[e]]))
                state_word.append(np.array([w]))
            states.append(word[w + 1 : first[d + 1]])
            state_word.append(np.arange(w + 1, first[d + 1]))
            state_text.append(np.full(first[d + 1] - w - 1 + inside, d))
        if not plans:
            break
        states, state_text, state_word = map(np.concatenate, (states, state_text, state_word))
        salt = np.uint64(turn) << np.uint64(48)
        took, length = x.walk(states, (base[state_text] ^ salt) + (state_word - first[state_text]).astype(np.uint64) * np.uint64(0x94D049BB133111EB))
        sums = np.append(0.0, np.cumsum(np.log(x.p[took])))
        cut = np.append(0, np.cumsum(length))[np.searchsorted(state_text, [p[0] for p in plans] + [n])]
        own_new = np.repeat(state_word.astype(np.int32), length)
        for (d, number, j, e, w, used, score, u4), a, z in zip(plans, cut[:-1], cut[1:]):
            old, own, *_rest = found[d][number]
            path = np.concatenate((old[:j], [e], took[a:z]))
            before = float(np.log(x.p[old[:j]]).sum())
            found[d].append((path, np.concatenate((own[:j], [w], own_new[a:z])), before + log(x.p[e]) + float(sums[z] - sums[a]), score))
            rests[d].append(Rest(x, len(found[d]) - 1, path, j, before, used, score, u4))
        open_ = [p[0] for p in plans]
    out = []
    for d in range(n):
        edge = max(r.value for r in rests[d])
        out.append([(path, lp, g, float(-np.expm1(-np.exp(min(50.0, lp - edge)))) if edge > -inf else 1.0) for path, _, lp, g in found[d]])
    return out


def decoded(v: Vocabulary, ids: np.ndarray, begin: np.ndarray) -> Iterator[bytes]:
    """The UTF-8 texts of sequences of ids, which begin at the given places and end with the last; the space before the first word goes."""
    size = v.size[ids]
    run = np.append(np.int32(0), np.cumsum(size, dtype=np.int32))
    every = v.flat[np.repeat(v.at[ids] - run[:-1], size) + np.arange(run[-1], dtype=np.int32)].tobytes()
    cut = run[begin].tolist()
    return (every[a + 1 : z] for a, z in zip(cut[:-1], cut[1:]))


def decode_bytes(v: Vocabulary, ids) -> bytes:
    """The UTF-8 text of a sequence of ids; the space before the first word goes."""
    return next(decoded(v, np.asarray(ids, np.int32), np.array([0, len(ids)])))


def decode(v: Vocabulary, ids) -> str:
    return decode_bytes(v, ids).decode("utf-8", "replace")


def _ids(v: Vocabulary, x: Lattices, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of edges, and where each edge's ids begin, with the end of all."""
    ids = x.piece[edges]
    bare = ids < 0
    if not bare.any():
        return ids, np.arange(len(ids) + 1)
    letter = x.points[x.src[edges[bare]]].astype("<u4")
    letter[letter == LITERAL] = SPACE
    many = np.ones(len(ids), np.int64)
    many[bare] = 1 + (letter >= 0x80).astype(np.int64) + (letter >= 0x800) + (letter >= 0x10000)
    out = np.repeat(ids, many)
    out[np.repeat(bare, many)] = v.byte[np.frombuffer(letter.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)]
    return out, np.append(0, np.cumsum(many))


_SAMPLE = [pa.field(n, t) for n, t in (("n_ids", pa.int32()), ("ids_sha256", pa.string()), ("log_prob", pa.float64()), ("score", pa.float64()), ("inclusion", pa.float64()), ("decodes", pa.bool_()), ("ids", pa.list_(pa.int32())))]
_SAMPLE_SQL = "array<struct<n_ids:int,ids_sha256:string,log_prob:double,score:double,inclusion:double,decodes:boolean,ids:array<int>>>"


@dataclass
class Samples:
    """Samples of some texts in a row: ids of all, where each sample's begin, each text's number of samples, and of each log-probability, perturbed score and inclusion."""

    ids: np.ndarray
    begin: np.ndarray
    many: list[int]
    values: list[tuple[float, float, float]]


def sample_texts(v: Vocabulary, texts: list[str], keys: np.ndarray, k: int) -> Samples:
    marked = [("▁" + t.replace("▁", chr(LITERAL)).replace(" ", "▁")) if t else "" for t in texts]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.int32)
    edge = np.append(0, np.cumsum([len(t) for t in marked]))
    if not len(points):
        return Samples(np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), [1] * len(texts), [(0.0, 0.0, 1.0)] * len(texts))
    space, line = points == SPACE, points == 10
    begin = np.zeros(len(points), bool)
    begin[edge[:-1][edge[:-1] < len(points)]] = True
    begin[1:] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    start = np.flatnonzero(begin)
    end = np.append(start[1:], len(points))
    # One lattice per different word of the batch.
    p, inv = W.powers(0xD1342543DE82EF95, len(points) + 1)
    run = np.append(np.uint64(0), np.cumsum(W.mix(points.astype(np.uint64) + np.uint64(1)) * p[: len(points)]))
    h = W.mix((run[end] - run[start]) * inv[start] + (end - start).astype(np.uint64))
    order = np.argsort(h)
    new = np.append(True, np.diff(h[order]) != 0)
    where, which = order[new], np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    x = Lattices(v, points, end[where], (end - start)[where])
    got = sample(x, x.start[which], np.searchsorted(start, edge), keys, k)
    paths = [e for samples in got for e, *_ in samples]
    ids, at = _ids(v, x, np.concatenate(paths))
    return Samples(ids, at[np.append(0, np.cumsum(list(map(len, paths))))], list(map(len, got)), [tuple(rest) for samples in got for _, *rest in samples])


def encode_texts(v: Vocabulary, texts: list[str], keys: np.ndarray, k: int) -> Iterator[list[tuple[np.ndarray, float, float, float]]]:
    """Of each text the samples as (ids, log-probability, perturbed score, inclusion)."""
    got = sample_texts(v, texts, keys, k)
    each = zip(got.begin[:-1], got.begin[1:], got.values)
    for n in got.many:
        yield [(got.ids[a:z], *rest) for a, z, rest in islice(each, n)]


def _encode(shared: Broadcast, k: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            buf, off = W.text_buffers(b.column("text"))
            at = 0
            while at < len(b):
                to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE_BYTES, "right")) - 1)
                parts = [buf[a:z].tobytes() for a, z in zip(off[at:to], off[at + 1 : to + 1])]
                keys = b.column("key").slice(at, to - at).to_numpy(zero_copy_only=False)
                got = sample_texts(v, [t.decode("utf-8", "replace") for t in parts], keys, k)
                raw, written = memoryview(got.ids.astype("<i4").tobytes()), decoded(v, got.ids, got.begin)
                own = [t for t, n in zip(parts, got.many) for _ in range(n)]
                lp, g, q = zip(*got.values)
                columns = (
                    np.diff(got.begin).astype(np.int32),
                    [hashlib.sha256(raw[4 * a : 4 * z]).hexdigest() for a, z in zip(got.begin[:-1].tolist(), got.begin[1:].tolist())],
                    lp,
                    g,
                    q,
                    [t == w for t, w in zip(own, written)],
                )
                arrays = [pa.array(c, f.type) for c, f in zip(columns, _SAMPLE)]
                arrays.append(pa.ListArray.from_arrays(pa.array(got.begin, pa.int32()), pa.array(got.ids, pa.int32())) if with_ids else pa.nulls(len(own), pa.list_(pa.int32())))
                samples = pa.StructArray.from_arrays(arrays, fields=_SAMPLE)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, to - at), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(got.many)), pa.int32()), samples)], names=["doc_id", "samples"])
                at = to

    return run


def share(spark: SparkSession, model: str | Path = MODEL) -> Broadcast:
    """The vocabulary (bounded by the model file) for all tasks."""
    return spark.sparkContext.broadcast(vocabulary(model))


def encode(docs: DataFrame, k: int = 3, seed: int = 5, model: str | Path = MODEL, with_ids: bool = False, copies: bool = False) -> DataFrame:
    """doc_id, samples and ids (of the first sample) of every document; ids are given if asked for.

    samples has the k best of all perturbed segmentations in order, fewer if the text has fewer; each with its
    ids, their number, their digest (SHA-256 of little-endian int32), log-probability, perturbed score, inclusion
    probability and whether decoding gives the text back. The row key is a hash of doc_id, seed and text, so repeated
    rows get equal samples; with copies, also of a number from 1 on that tells them apart (rows are then counted by
    doc_id and text before they are numbered, so no task holds a group). Null and empty texts have one sample without
    ids. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = [F.lit(seed), F.col("doc_id"), F.col("text")]
    if copies:
        rows = rows.groupBy("doc_id", "text").agg(F.count("*").cast("int").alias("n")).select("doc_id", "text", F.explode(F.sequence(F.lit(1), "n")).alias("nth"))
        key.append(F.col("nth"))
    rows = rows.select("doc_id", "text", F.xxhash64(*key).alias("key"))
    return rows.mapInArrow(_encode(share(docs.sparkSession, model), k, with_ids), f"doc_id long, samples {_SAMPLE_SQL}").withColumn("ids", F.col("samples")[0]["ids"])
