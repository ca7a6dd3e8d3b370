"""Alignment of two tokenizers' segmentations of the same text.

The bytes of a run of texts are one packed bitset for each tokenizer, a bit where a token ends. AND leaves the cuts
that both share; popcounts over whole words and below the cut's bit give the rank of a cut among either's ends, so the
tokens between two cuts are ranges without any search. Tokens of a range pair are linked, each with each, and how many
documents link a pair of ids is counted over the corpus.

A pair of ids is one number below 2^31. Each task sums the documents of its pairs before they are dealt out. Links
are then looked up in two ways: pairs in at least the HEAVY-th part of all (document, pair) rows are fewer than HEAVY,
however large the corpus, and go to every task; each of the others has few rows by the same bound, and meets its count
in a join. The highest count of each id of the first vocabulary is an array as long as that vocabulary.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import words as W
from logweave.llm.graph import fresh_path

FOLDER = "/opt/tokenizers"
FIRST, SECOND = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
#: Pairs that are sent to every task, at most; 12 bytes each.
HEAVY = 1 << 18
SLICE_BYTES = 1 << 19
LINKS = 1 << 20  # links expanded at a time
PIECE = 1 << 18  # pairs of stored rows that a task looks at together
#: The byte-level vocabulary's split of a text; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones themselves, others from U+0100 on in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level BPE vocabulary file; encode() gives the ids of texts, special tokens' strings as plain text."""

    def __init__(self, content: bytes):
        import tiktoken

        known = json.loads(content)
        letters = _byte_letters()
        special = {t["id"] for t in known.get("added_tokens", ())}
        ranks = {bytes(letters[c] for c in t): i for t, i in known["model"]["vocab"].items() if i not in special}
        joined = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in known["model"]["merges"]]
        by = [known["model"]["vocab"]["".join(m)] for m in joined]
        if by != sorted(by):
            raise ValueError("ids of this vocabulary do not follow its merges")
        self.bytes = [b""] * (1 + max(known["model"]["vocab"].values()))
        for b, i in ranks.items():
            self.bytes[i] = b
        self._encoding = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list:
        # As little-endian uint32 in a buffer, so no list of numbers is made.
        return [self._encoding.encode_to_numpy(t, disallowed_special=()) for t in texts]


class Pieces:
    """A SentencePiece model file, which adds the first space itself."""

    def __init__(self, content: bytes):
        import sentencepiece

        self._model = m = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.bytes = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())]

    def encode(self, texts: list[str]) -> list:
        return [np.array(ids, np.uint32) for ids in self._model.encode(texts, num_threads=1)]


class Table:
    """What is needed of a vocabulary beside encode(): bytes of the tokens, and the tokens' numbers as text with a mark after."""

    def __init__(self, tokens: list[bytes], inner: str, last: str):
        self.bytes = pa.array(tokens, pa.large_binary())
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.shown = [f"{i}{mark}".encode() for mark in (inner, last) for i in range(len(tokens))]


_loaded: dict[bytes, tuple] = {}


def _tokenizers(shared: Broadcast) -> tuple:
    """Both tokenizers, their tables and the shown numbers; made once per process."""
    files = shared.value
    key = hashlib.sha256(files[0] + files[1]).digest()
    if key not in _loaded:
        a, b = ByteLevel(files[0]), Pieces(files[1])
        ta, tb = Table(a.bytes, ",", "|"), Table(b.bytes, ",", ";")
        _loaded[key] = (a, b, ta, tb, pa.array(ta.shown + tb.shown, pa.large_binary()))
    return _loaded[key]


def share(spark, first: str | Path = FIRST, second: str | Path = SECOND) -> Broadcast:
    """Both vocabulary files (bounded by their size) for all tasks."""
    return spark.sparkContext.broadcast(tuple(Path(p).read_bytes() for p in (first, second)))


def bitset(ends: np.ndarray, n: int) -> np.ndarray:
    """Bits ends of n bits, in 64-bit words."""
    bits = np.zeros((n // 64 + 1) * 64, bool)
    bits[ends] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def select(words: np.ndarray) -> np.ndarray:
    """Places of all set bits."""
    some = np.flatnonzero(words)
    bits = np.unpackbits(words[some].view(np.uint8), bitorder="little").reshape(-1, 64)
    row, bit = np.nonzero(bits)
    return some[row] * 64 + bit


def rank(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits up to and with each place are set."""
    before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
    mask = ~np.uint64(0) >> (np.uint64(63) - (at & 63).astype(np.uint64))
    return before[at >> 6] + np.bitwise_count(words[at >> 6] & mask)


def shared_ranges(ends_a: np.ndarray, ends_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of two segmentations of n bytes, given by the bytes at which tokens end: token counts up to each shared cut, from 0."""
    a, b = bitset(ends_a, n), bitset(ends_b, n)
    cuts = select(a & b)
    return np.concatenate(([0], rank(a, cuts))), np.concatenate(([0], rank(b, cuts)))


def _same_bytes(table: Table, ids: np.ndarray, first: np.ndarray, data: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Whether each text's tokens join to its bytes."""
    ends = np.concatenate(([0], np.cumsum(table.size[ids])))[first]
    same = np.diff(ends) == np.diff(edge)
    joined = np.frombuffer(table.bytes.take(pa.array(ids)).buffers()[2] or b"", np.uint8)[: ends[-1]]
    if same.all():
        unlike = np.concatenate(([0], np.cumsum(joined != data[edge[0] : edge[-1]])))
        return np.diff(unlike[edge - edge[0]]) == 0
    return np.array([bool(s) and np.array_equal(joined[x:y], data[u:v]) for s, x, y, u, v in zip(same, ends[:-1], ends[1:], edge[:-1], edge[1:])], bool)


def _counted(doc: np.ndarray, pair: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, pair) in order, and the sum of their times."""
    key = doc.astype(np.int64) << 31 | pair
    if times is None:
        key, n = np.unique(key, return_counts=True)
    else:
        key, of = np.unique(key, return_inverse=True)
        n = np.bincount(of, times, len(key)).astype(np.int64) if len(key) else np.zeros(0, np.int64)
    return key >> 31, key & ((1 << 31) - 1), n


def _links(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, pair) and how many links each has, of groups with the token ranges ra, rb; LINKS are expanded at a time.

    A long group is expanded by its different ids only, with their counts, and in runs of its first ids.
    """
    na, nb = np.diff(ra), np.diff(rb)
    out = []
    wide = (na > 64) & (nb > 64)
    short = np.flatnonzero(~wide)
    size = (na * nb)[short]
    run = np.cumsum(size)
    at = 0
    while at < len(short):
        to = max(at + 1, int(np.searchsorted(run, (run[at - 1] if at else 0) + LINKS, "right")))
        g = short[at:to]
        own = np.repeat(np.arange(len(g)), size[at:to])
        k = np.arange(len(own)) - np.repeat(np.cumsum(size[at:to]) - size[at:to], size[at:to])
        i, j = ra[g][own] + k // nb[g][own], rb[g][own] + k % nb[g][own]
        out.append(_counted(doc[g][own], a[i].astype(np.int64) * width + b[j]))
        at = to
    for g in np.flatnonzero(wide).tolist():
        (x, nx), (y, ny) = (np.unique(t[r[g] : r[g + 1]], return_counts=True) for t, r in ((a, ra), (b, rb)))
        step = max(1, LINKS // len(y))
        for s in range(0, len(x), step):
            pair = (x[s : s + step].astype(np.int64)[:, None] * width + y[None, :]).ravel()
            out.append((np.full(len(pair), doc[g]), pair, (nx[s : s + step, None] * ny[None, :]).ravel()))
    if len(out) == 1:
        return out[0]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _counted(*(np.concatenate(c) for c in zip(*out)))


_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<long>"


def _align(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, ta, tb, shown = _tokenizers(shared)
        width = len(tb.size)
        for batch in batches:
            for w in W.slices(batch.column("text"), limit=SLICE_BYTES):
                raw = w.buf.tobytes()
                n = len(w.text) - 1
                texts = [raw[x:y].decode("utf-8") for x, y in zip(w.text[:-1], w.text[1:])]
                ids_a = first.encode([" " + t if t else "" for t in texts])
                ids_b = second.encode(texts)
                edge = w.text + np.concatenate(([0], np.cumsum(np.diff(w.text) > 0)))  # a space before each text that is not empty
                data = np.full(edge[-1], 0x20, np.uint8)
                data[np.arange(len(w.buf)) + np.repeat(np.cumsum(np.diff(w.text) > 0), np.diff(w.text))] = w.buf
                fa, fb = (np.concatenate(([0], np.cumsum([len(x) for x in ids]))) for ids in (ids_a, ids_b))
                a, b = (np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int64) for ids in (ids_a, ids_b))
                good = _same_bytes(ta, a, fa, data, edge) & _same_bytes(tb, b, fb, data, edge)
                if not good.all():
                    a, b = a[np.repeat(good, np.diff(fa))], b[np.repeat(good, np.diff(fb))]
                    fa, fb, edge = (np.concatenate(([0], np.cumsum(np.where(good, np.diff(x), 0)))) for x in (fa, fb, edge))
                # Texts end with a token of both, so none shares a group with the next.
                ra, rb = shared_ranges(np.cumsum(ta.size[a]) - 1, np.cumsum(tb.size[b]) - 1, int(edge[-1]))
                na, nb = np.diff(ra), np.diff(rb)
                doc = np.searchsorted(fa, ra[1:] - 1, "right") - 1
                group = lambda x: np.bincount(doc, x, n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)
                # The groups as text: each token's number with its mark, in the order of the groups.
                order = np.empty(len(a) + len(b), np.int64)
                last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
                last_a[ra[1:] - 1] = last_b[rb[1:] - 1] = True
                order[np.arange(len(a)) + np.repeat(rb[:-1], na)] = a + len(ta.size) * last_a
                order[np.arange(len(b)) + np.repeat(ra[1:], nb)] = 2 * len(ta.size) + b + width * last_b
                text = shown.take(pa.array(order))
                at = np.frombuffer(text.buffers()[1], np.int64)[: len(order) + 1][fa + fb] if len(order) else np.zeros(n + 1, np.int64)
                said = text.buffers()[2].to_pybytes() if len(order) else b""
                digest = [hashlib.sha256(said[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                d, pair, times = _links(a, b, ra, rb, doc, width)
                lists = pa.array(np.searchsorted(d, np.arange(n + 1)).astype(np.int32))
                numbers = (np.diff(fa), np.diff(fb), np.bincount(doc, minlength=n), group(na * nb))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(w.row, n) for c in ("row", "doc_id")), *(pa.array(x.astype(np.int64)) for x in numbers), pa.array(digest, pa.string()),
                     pa.ListArray.from_arrays(lists, pa.array(pair.astype(np.int32))), pa.ListArray.from_arrays(lists, pa.array(times))],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about PIECE pairs each."""
    for b in batches:
        edge = b.column("pairs").offsets.to_numpy().astype(np.int64)
        at = 0
        while at < len(b):
            to = max(at + 1, int(np.searchsorted(edge, edge[at] + PIECE, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each pair, summed by task over about a million rows at a time."""
    keys, sums, held = [], [], 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        key, of = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(of, np.concatenate(sums), len(key)).astype(np.int64)

    for b in _pieces(batches):
        key, n = np.unique(b.column("pairs").flatten().to_numpy(zero_copy_only=False), return_counts=True)
        keys.append(key)
        sums.append(n)
        held += len(key)
        if held > 1 << 20:
            key, n = summed()
            if len(key) > 1 << 19:
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])
                keys, sums, held = [], [], 0
            else:
                keys, sums, held = [key], [n], len(key)
    if keys:
        key, n = summed()
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])


def _places(heavy: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each pair among the heavy ones, and whether it is one."""
    at = np.minimum(np.searchsorted(heavy, pair), max(0, len(heavy) - 1))
    return at, heavy[at] == pair if len(heavy) else np.zeros(len(pair), bool)


def _looked_up(known: Broadcast, width: int):
    """The rows with what their heavy pairs contribute."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, count, best = known.value
        for b in _pieces(batches):
            pair, times = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
            row = np.repeat(np.arange(len(b)), np.diff(b.column("pairs").offsets.to_numpy()))
            at, ours = _places(heavy, pair)
            row, times, n, top = row[ours], times[ours], count[at[ours]], best[pair[ours] // width]
            total, n_best = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            np.add.at(total, row, times * n)
            np.add.at(n_best, row, times * (n == top))
            rest = [c for c in b.schema.names if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*map(b.column, rest), pa.array(total), pa.array(n_best)], names=[*rest, "count_sum", "n_best"])

    return run


def _others(known: Broadcast):
    """(row, pair, times) of the other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = known.value[0]
        for b in _pieces(batches):
            pair, times = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
            row = np.repeat(b.column("row").to_numpy(zero_copy_only=False), np.diff(b.column("pairs").offsets.to_numpy()))
            rare = ~_places(heavy, pair)[1]
            yield pa.RecordBatch.from_arrays([pa.array(x[rare]) for x in (row, pair, times)], names=["row", "pair", "times"])

    return run


def align(docs: DataFrame, first: str | Path = FIRST, second: str | Path = SECOND, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document (doc_id, text).

    Texts are encoded with a space before them, by a byte-level BPE vocabulary (a) and a SentencePiece model (b). A
    group is what lies between two byte places where tokens of both end; all its a and b tokens are linked. The count
    of a pair of ids is the number of rows that hold it linked; count_sum adds it up over links, n_best counts the links
    whose count is the highest of their a id. Null and empty texts, and those whose tokens do not join to their bytes,
    have no tokens: zeros and an empty digest. Repeated rows are documents of their own, also with a null doc_id. An
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    files = share(spark, first, second)
    width = len(Pieces(files.value[1]).bytes)
    n_first = len(ByteLevel(files.value[0]).bytes)
    if n_first * width >= 1 << 31:
        raise ValueError("the vocabularies are too large for a pair in 31 bits")
    path, counts_path = fresh_path(spark, "aligned"), fresh_path(spark, "pair-counts")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows.mapInArrow(_align(files), _ALIGNED).write.parquet(path)
    aligned = spark.read.parquet(path)
    aligned.select("pairs").mapInArrow(_pair_counts, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).write.parquet(counts_path)
    counts = spark.read.parquet(counts_path)
    least = (counts.agg(F.sum("n")).first()[0] or 0) // heavy + 1  # so there are fewer than heavy pairs of that many documents
    often = counts.where(F.col("n") >= least).toPandas().sort_values("pair")
    best = np.zeros(n_first, np.int64)
    for r in counts.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("n").alias("n")).collect():  # a row per id of the first vocabulary at most
        best[r["a"]] = r["n"]
    known = spark.sparkContext.broadcast((often["pair"].to_numpy(np.int64), often["n"].to_numpy(np.int64), best))
    top = F.broadcast(spark.createDataFrame(pa.table({"a": np.flatnonzero(best), "top": best[best > 0]})))
    rare = aligned.select("row", "pairs", "times").mapInArrow(_others(known), "row long, pair int, times long").join(counts.where(F.col("n") < least), "pair")
    rare = rare.join(top, F.expr(f"pair div {width}") == top["a"]).groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("more_best"))
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]
    looked = aligned.mapInArrow(_looked_up(known, width), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema.fields if f.name in kept) + ", count_sum long, n_best long")
    got = looked.join(rare, "row", "left")
    sums = [(F.col(c) + F.coalesce(more, F.lit(0))).alias(c) for c, more in (("n_best", "more_best"), ("count_sum", "more"))]
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *sums, "groups_sha256")
