"""Personal data: patterns, and terms that disclose what the patterns find.

Patterns give the protected entities. Entities and terms outside them are counted over the whole corpus by documents,
wherever in a document they stand; a term t discloses an entity e if P(e | t) is high and the information log2(P(e | t) / P(e)) makes up most of the entity's
own -log2 P(e). P(e | t) is drawn towards P(e) as if PRIOR more documents held t and knew nothing of e, so entities
and terms of one or two documents are judged too, with less trust. Such terms are generalised, or removed when they give nearly all of it, wherever they occur.

Corpus counts are aggregated by 64-bit term hash. Entities, and terms, of the same documents have the same counts, so
pairs are counted by such classes. A term too frequent for any entity it stands with is left out by an exact bound.
Documents with entities keep their terms' places. In the others, disclosing terms are found with a bit table of fixed
size (bounded broadcast) and confirmed by an exact join, so the number of such terms is not bounded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import words as W
from logweave.llm.graph import cut

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SALTS = 16  # tasks over which the documents of a frequent term or entity are spread
PRIOR = 1.0  # documents; with one, P(e | t) reaches one half where more than half of a term's documents hold the entity
MIN_GIVEN, GENERALISE, REMOVE = 0.5, 0.8, 0.97
TABLE_BITS = 1 << 24


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    low = 0
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        low = at + 1
        if found:
            yield start, found.end()
            low = end = found.end()
        at = text.find("@", max(at + 1, end))


def _octets(match: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in match.split(".")))


def _luhn(match: str) -> bool:
    digits = [int(c) for c in match if c.isdigit()]
    return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _octets(m[0])]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 14 and _luhn(m[0])]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_PLACE = pa.list_(pa.struct([("t", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
_SPAN_SQL, _PLACE_SQL = "array<struct<start:int,kind:int,end:int>>", "array<struct<t:long,start:int,end:int>>"


def _points(w: W.Words) -> np.ndarray:
    """Code points before each byte of a slice."""
    return np.concatenate(([0], np.cumsum((w.buf & 0xC0) != 0x80)))


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its base spans and, where there are any, the entities, the terms outside spans and those only inside."""
    for b in batches:
        for w in W.slices(b.column("text"), space_bytes=W.TERM_SPACE):
            raw, spans, ents, places, inside = w.buf.tobytes(), [], [], [], []
            h = points = None
            for d in range(len(w.first) - 1):
                text = raw[w.text[d] : w.text[d + 1]].decode("utf-8", "replace")
                found, values, outer, inner = base_spans(text), set(), [], []
                if found and h is None:
                    low = W.Words(w.row, W._LOWER[w.buf], w.text, w.start, w.end, w.first)
                    h, points = low.hashes().view(np.int64), _points(w)
                if found:
                    a, z, zero = w.first[d], w.first[d + 1], points[w.text[d]]
                    begin, end, t = points[w.start[a:z]] - zero, points[w.end[a:z]] - zero, h[a:z]
                    free = np.ones(z - a, bool)
                    for s, k, e in found:
                        free[np.searchsorted(end, s, "right") : np.searchsorted(begin, e)] = False
                        values.add(int.from_bytes(hashlib.blake2b(f"{k}:{text[s:e].lower()}".encode(), digest_size=8).digest(), "big", signed=True))
                    outer = [{"t": x, "start": p, "end": q} for x, p, q in zip(t[free].tolist(), begin[free].tolist(), end[free].tolist())]
                    inner = np.setdiff1d(t[~free], t[free]).tolist()
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
                ents.append(sorted(values))
                places.append(outer)
                inside.append(inner)
            n, longs = len(spans), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(w.row, n), b.column("h").slice(w.row, n), pa.array(spans, _SPAN), pa.array(ents, longs), pa.array(places, _PLACE), pa.array(inside, longs)],
                names=["doc_id", "h", "base", "ents", "places", "inside"],
            )


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per term, summed by slice."""
    for b in batches:
        for w in W.slices(b.column("text"), lower=True, space_bytes=W.TERM_SPACE):
            h = w.hashes()
            order = np.argsort(h, kind="stable")
            h = h[order]
            doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))[order]
            if not len(h):
                continue
            new = np.concatenate(([True], h[1:] != h[:-1]))
            other = new.copy()
            other[1:] |= doc[1:] != doc[:-1]
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.add.reduceat(other.astype(np.int64), at))], names=["t", "n"])


def _occurrences(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, np.uint8)
        for b in batches:
            for w in W.slices(b.column("text"), lower=True, space_bytes=W.TERM_SPACE):
                h = w.hashes()
                at = h & np.uint64(TABLE_BITS - 1)
                hit = np.flatnonzero((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
                if not len(hit):
                    continue
                points = _points(w)
                doc = np.searchsorted(w.first, hit, "right") - 1
                zero = points[w.text[doc]]
                row = pa.array(doc + w.row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[hit].view(np.int64)), b.column("doc_id").take(row), b.column("h").take(row), pa.array((points[w.start[hit]] - zero).astype(np.int32)), pa.array((points[w.end[hit]] - zero).astype(np.int32))],
                    names=["t", "doc_id", "h", "start", "end"],
                )

    return run


def _salted(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Join on key of rows, of which one key may have very many, with few, which has one row per key."""
    spread = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(spread, [key, "salt"]).drop("salt")


def disclosing_terms(found: DataFrame, docs: DataFrame, n_docs: int) -> DataFrame:
    """Rows (t, share, stray) of the terms over the thresholds.

    share is the part of the entity's information they give; stray terms also stand in documents without entities.
    """
    all_docs = F.lit(float(n_docs))
    smooth = lambda both, given, n_e: (both + PRIOR * n_e / all_docs) / (given + PRIOR)
    terms = F.array_distinct(F.transform("places", lambda p: p["t"])).alias("terms")
    texts = cut(found.where("size(ents) > 0").select("h", "ents", terms, "inside").groupBy("h").agg(*(F.first(c).alias(c) for c in ("ents", "terms", "inside")), F.count("*").alias("m")))
    ents = texts.select("h", "m", F.explode("ents").alias("e"))
    n_e = ents.groupBy("e").agg(F.sum("m").alias("n_e"), F.bit_xor(F.xxhash64("h")).alias("e_docs"))
    ents = cut(_salted(ents, n_e, "e").select("h", "m", "n_e", "e_docs").distinct())
    most = ents.groupBy("h").agg(F.max("n_e").alias("most"))
    held = texts.join(most, "h").select("h", "m", "most", F.explode("terms").alias("t")).groupBy("t").agg(F.sum("m").alias("held"), F.max("most").alias("most"), F.bit_xor(F.xxhash64("h")).alias("t_docs"))
    inside = texts.select("m", F.explode("inside").alias("t")).groupBy("t").agg(F.sum("m").alias("inside"))
    whole = docs.mapInArrow(_term_counts, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))
    given = held.join(whole, "t").join(inside, "t", "left").withColumn("given", F.col("n") - F.coalesce("inside", F.lit(0)))
    # No entity of n_e <= most documents can have more documents in common with the term than either has.
    rare = cut(given.where(smooth(F.least("held", "most"), F.col("given"), F.col("most")) >= MIN_GIVEN).select("t", "t_docs", "held", "given"))
    alike = ["t_docs", "held", "given"]
    one = rare.groupBy(*alike).agg(F.min("t").alias("t"))
    joint = ents.join(_salted(texts.select("h", F.explode("terms").alias("t")), one, "t").select("h", *alike), "h").groupBy("n_e", "e_docs", *alike).agg(F.sum("m").alias("both"))
    scored = joint.withColumn("p", smooth(F.col("both"), F.col("given"), F.col("n_e"))).withColumn(
        "share", F.when(F.col("n_e") < n_docs, 1 + F.log2("p") / -F.log2(F.col("n_e") / all_docs)).otherwise(F.lit(0.0))
    )
    best = scored.where((F.col("p") >= MIN_GIVEN) & (F.col("share") >= GENERALISE)).groupBy(*alike).agg(F.max("share").alias("share"))
    return rare.join(best, alike).select("t", "share", (F.col("given") > F.col("held")).alias("stray"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), base (start, kind, end) and terms (start, end, share) of every document.

    Null text is empty. Rows with equal doc_id and text share their spans; with equal doc_id and other texts each
    has its own. Terms inside a base span are not reported. An empty table gives no rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    found = cut(docs.mapInArrow(_entities, f"doc_id long, h long, base {_SPAN_SQL}, ents array<long>, places {_PLACE_SQL}, inside array<long>"))
    terms = cut(disclosing_terms(found, docs, found.count()))
    # The table has TABLE_BITS bits whatever the corpus; a full one only lets more words through to the exact join.
    place = F.col("t").bitwiseAND(F.lit(TABLE_BITS - 1))
    stray = terms.where("stray").drop("stray")
    words = stray.select(F.shiftright(place, 6).alias("i"), F.expr(f"shiftleft(1L, cast((t & {TABLE_BITS - 1}) % 64 as int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(TABLE_BITS // 64, np.int64)
    bits[words["i"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    table = docs.sparkSession.sparkContext.broadcast(bits.tobytes())
    hits = docs.mapInArrow(_occurrences(table), "t long, doc_id long, h long, start int, end int").join(stray, "t")
    placed = found.where("size(ents) > 0").select("doc_id", "h", F.inline("places"))
    columns = ["doc_id", "h", "start", "end", "share"]
    hits = hits.select(*columns).unionByName(_salted(placed, terms, "t").select(*columns))
    by_doc = hits.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("k")).agg(F.array_sort(F.collect_set(F.struct("start", "end", "share"))).alias("hits"))
    free = lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    return (
        found.drop("ents", "places", "inside")
        .join(by_doc, found["doc_id"].eqNullSafe(by_doc["d"]) & (found["h"] == by_doc["k"]), "left")
        .select("doc_id", "h", "base", F.filter(F.coalesce("hits", F.array().cast("array<struct<start:int,end:int,share:double>>")), free).alias("terms"))
    )


def _count(kind: int) -> F.Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_term from find()'s rows."""
    name = F.array(*map(F.lit, KINDS))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    name = F.array(*map(F.lit, (*KINDS, "term")))
    whole = F.array_sort(F.concat("base", F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(4).alias("kind"), t["end"].alias("end")))))
    return found.select(
        "doc_id",
        *(_count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
        F.sha2(shown(F.col("base")), 256).alias("base_sha256"),
        shown(whole).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )


def rewrite(text: str, base, terms) -> str:
    """The text with entities replaced by their kind, disclosing terms generalised or removed; of overlapping spans the first holds."""
    cuts = [(s["start"], s["end"], f"[{KINDS[s['kind']].upper()}]") for s in base] + [(t["start"], t["end"], "" if t["share"] >= REMOVE else "[TERM]") for t in terms]
    out, at = [], 0
    for a, z, new in sorted(cuts):
        if a >= at:
            out += [text[at:a], new]
            at = z
        else:
            at = max(at, z)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents, all columns kept, with texts rewritten and n_chars (where present) brought up to date."""
    found = find(docs).where("size(base) > 0 or size(terms) > 0").select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "base", "terms").dropDuplicates(["_d", "_h"])
    rows = docs.withColumnsRenamed({c: f"c_{c}" for c in docs.columns})
    rows = rows.join(found, rows["c_doc_id"].eqNullSafe(found["_d"]) & (F.xxhash64("c_text") == found["_h"]), "left")

    @F.pandas_udf("string")
    def clean(text: pd.Series, base: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([rewrite(t, x, y) if x is not None else t for t, x, y in zip(text, base, terms)], dtype=object)

    rows = rows.withColumn("new", F.when(F.col("base").isNotNull(), clean("c_text", "base", "terms")).otherwise(F.col("c_text")))
    of = {"text": F.col("new"), "n_chars": F.when(F.col("base").isNotNull(), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("c_n_chars"))} if "n_chars" in docs.columns else {"text": F.col("new")}
    return rows.select(*(of.get(c, F.col(f"c_{c}")).alias(c) for c in docs.columns))
