"""The whole pipeline against plain Python over a small table, and its stages on odd rows."""

import math
import random
import re

import pytest

import corpus_pipeline
from logweave.llm import pii, segmentation

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMAIL = re.compile(r"[a-z]+@[a-z]+\.org")
TERM = re.compile(r"[0-9A-Za-z_\u0080-\U0010ffff]+")


def made():
    r = random.Random(12)
    words = [f"word{i}" for i in range(90)]
    texts = [" ".join(r.choices(words, k=r.randint(20, 60))) for _ in range(150)]
    for i in range(0, 150, 5):
        texts[i] += f" you {r.choice(['vorpling', 'grobwit'])} fool"
    texts += [texts[1]] * 6 + [texts[2] + " tail", texts[3] + " more tail", texts[4].upper()]
    texts[7] += " ask zorblax at joe@host.org"
    texts[8] += " joe@host.org knows zorblax"
    texts += ["", None, "one", " \t"]
    sources = ["hot" if i % 3 else ("mid", None)[i % 2] for i in range(len(texts))]
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, (t, s) in enumerate(zip(texts, sources))]
    return rows, [(i, 1, int(i % 5 == 0)) for i in range(150)]


def without_toxic(rows):
    return [r for r in rows if not re.search("vorpling|grobwit", r[1] or "")]


def one_of_each(rows):
    kept, sets = [], {}
    for r in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {r[0]: r[0] for r in rows}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in root:
        for b in root:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [r for r in rows if find(r[0]) == r[0]]


def sanitised(rows):
    both, n_e, docs, n = {}, {}, {}, len(rows)
    for r in rows:
        ents, terms = set(EMAIL.findall(r[1] or "")), {t.lower() for t in TERM.findall(EMAIL.sub(" ", r[1] or ""))}
        for e in ents:
            n_e[e] = n_e.get(e, 0) + 1
        for t in terms:
            docs[t] = docs.get(t, 0) + 1
        for e in ents:
            for t in terms:
                both[e, t] = both.get((e, t), 0) + 1
    share = {}
    for (e, t), x in both.items():
        prior = n_e[e] / n
        p = (x + prior) / (docs[t] + 1)
        if p >= pii.MIN_GIVEN:
            share[t] = max(share.get(t, 0), 1 + math.log2(p) / -math.log2(prior))
    new = lambda m: "" if share.get(m[0].lower(), 0) >= pii.REMOVE else "[TERM]" if share.get(m[0].lower(), 0) >= pii.GENERALISE else m[0]
    clean = lambda t: "[EMAIL]".join(TERM.sub(new, part) for part in EMAIL.split(t))
    return [(i, None if t is None else clean(t), lang, s, None if t is None else len(clean(t))) for i, t, lang, s, _ in rows]


def targets(rows):
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    fixed, free = {}, set(sizes)
    while free:
        left = sum(sizes.values()) - sum(fixed.values())
        over = {s for s in free if left * weights[s] / sum(weights[x] for x in free) > 3 * sizes[s]}
        if not over:
            break
        fixed |= {s: 3 * sizes[s] for s in over}
        free -= over
    return sizes, fixed | {s: left * weights[s] / sum(weights[x] for x in free) for s in free}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, (rows, labels) = tmp_path_factory.mktemp("pipeline"), made()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_run_equals_brute_force(spark, folder):
    rows = sanitised(one_of_each(without_toxic(made()[0])))
    assert {r[0] for r in rows} >= {1, 7, 8} and not {156, 157, 158} & {r[0] for r in rows}
    assert "zorblax" not in rows[[r[0] for r in rows].index(7)][1]
    texts, (sizes, target) = {r[0]: r for r in rows}, targets(rows)
    got, again = (corpus_pipeline.run(spark, folder) for _ in range(2))
    v, copies = segmentation.vocabulary(), {}
    for r in got.collect():
        assert segmentation.decode(v, r["ids"]) == (texts[r["doc_id"]][1] or "")
        copies.setdefault(r["doc_id"], []).append(r["samples"][0]["ids_sha256"])
    taken = {s: 0 for s in sizes}
    for i, _, _, s, _ in rows:
        n, size = len(copies.get(i, ())), len(WORD.findall(texts[i][1] or ""))
        assert not sizes[s] or math.floor(target[s] / sizes[s]) <= n <= math.ceil(target[s] / sizes[s])
        taken[s] += n * size
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(len(WORD.findall(r[1] or "")) for r in rows if r[3] == s)
    again_cut = [len(set(x)) > 1 for x in copies.values() if len(x) > 1]
    assert sum(again_cut) > len(again_cut) / 2  # most copies are cut otherwise
    assert sorted((r["doc_id"], r["samples"][0]["ids_sha256"]) for r in got.collect()) == sorted((r["doc_id"], r["samples"][0]["ids_sha256"]) for r in again.collect())


def test_stages_keep_columns_and_bear_odd_rows(spark, folder):
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a text of no one", "en", "s", 16), (1, "", "en", "s", 0), (1, "same id other text", None, None, 18), (1, "same id other text", None, None, 18)], DOCS)
    odd = odd.selectExpr("*", "1 as size", "'x' as score", "2 as predicted", "3 as target", "4 as times", "5 as h", "6 as base", "7 as class_id", "8 as key", "9 as n")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, folder)
        assert got.columns == odd.columns and got.dtypes == odd.dtypes, name
        assert stage(spark, odd.limit(0), folder).count() == 0, name
        assert name == "mixing" or got.where("doc_id is null").count() == 2, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, odd, folder).count() == 5 and last(spark, odd.limit(0), folder).count() == 0
