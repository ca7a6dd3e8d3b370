"""The automaton against plain edit distance; quotation, scripts without spaces, labels that are missing."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from logweave.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain(word, terms):
    if any(word.startswith(t) for t in terms):
        return 1
    near = any(len(t) >= toxicity.FUZZY_FROM and distance(word, t) <= 1 for t in terms)
    stem = any(len(t) >= toxicity.STEM_FROM and distance(word[:k], t) <= 1 for t in terms for k in range(len(word) + 1))
    return 2 if near or stem else 0


def looked_up(words, terms):
    a = toxicity.automaton(terms)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    end = np.cumsum([len(w) for w in words])
    return a.run(points, np.concatenate(([0], end[:-1])), end).tolist()


def test_automaton_equals_edit_distance():
    r = random.Random(4)
    for alphabet in ("ab", "abcé漢\U0001f600"):
        terms = sorted({"".join(r.choices(alphabet, k=r.randint(3, 10))) for _ in range(8)})
        words = ["".join(r.choices(alphabet, k=r.randint(1, 14))) for _ in range(1500)]
        for t in terms:
            i = r.randrange(len(t))
            words += [t, t + "ab", t[:i] + t[i + 1 :], t[:i] + "b" + t[i:], t[:i] + "a" + t[i + 1 :] + "ba"]
        assert looked_up(words, terms) == [plain(w, terms) for w in words]
    assert looked_up(["abc"], []) == [0]


def counts(texts, terms):
    a = toxicity.automaton(terms)
    return [row for _, x in toxicity.features(pa.array(texts), a) for row in np.expm1(x).round().astype(int).tolist()]


def test_quotation_and_density_and_scripts_without_spaces():
    got = counts(['he said "scumbag" twice', "scumbag!\nscumbags", "scumbga", "scumbagg and scumbag", '"scumbga"', None, ""], ["scumbag"])
    assert got == [[0, 1, 0, 0, 0], [2, 0, 0, 0, 1], [0, 0, 1, 0, 0], [2, 0, 0, 0, 1], [0, 0, 0, 1, 0], [0] * 5, [0] * 5]
    assert counts(["scumbg", 'x "scumbxg"', "sscumbag", "scmbagging"], ["scumbag"]) == [[0, 0, 1, 0, 0], [0, 0, 0, 1, 0], [0, 0, 1, 0, 0], [0, 0, 1, 0, 0]]
    assert counts(["前漢字語後。漢字語", "漢字、漢字", "\U0001f600漢字語\U0001f600"], ["漢字語"]) == [[2, 0, 0, 0, 1], [0] * 5, [1, 0, 0, 0, 0]]
    begun = lambda t: {x.text(i) for _, x in toxicity.beginnings(pa.array([t])) for i in range(len(x.hash))}
    assert {"漢字", "漢字語", "字語"} <= begun("漢字語") and "de" not in begun("def")
    assert "x" * toxicity.LONGEST in begun("x" * 100_000)


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(80)]
    texts, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        text = " ".join(r.choices(words, k=20))
        texts.append(text + (f" you {r.choice(['vorpling', 'vorplings', '漢字語的'])} " if bad else " fine"))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learned_terms_catch_held_out_documents(spark, labelled):
    docs, labels = labelled
    terms = toxicity.fit(docs, labels)[2]
    assert any(t.startswith("vorpling") for t in terms) and any("漢" in t for t in terms)
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert all(r["predicted"] == int(i % 3 == 0) for i, r in got.items()) and any(r["held_out"] for r in got.values())
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(300) if i % 3}


def test_without_labels_of_both_kinds_nothing_is_toxic(spark, labelled):
    docs, labels = labelled
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "again vorpling", "en", "s", 14)], DOCS).selectExpr("*", "1.5D as score", "7 as predicted", "'x' as held_out", "'y' as c_text")
    for some in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1"), labels.selectExpr("doc_id", "quality", "cast(null as int) as toxic")):
        assert {(r["score"], r["predicted"]) for r in toxicity.score(odd, some).collect()} == {(0.0, 0)}
        kept = toxicity.keep_clean(odd, some)
        assert kept.columns == odd.columns and kept.count() == 3
        assert kept.where("doc_id is null").first()["text"] is None
    assert toxicity.keep_clean(odd.limit(0), labels).count() == 0 == toxicity.score(odd.limit(0), labels).count()


def test_repeated_ids_are_judged_by_their_own_texts(spark, labelled):
    docs, labels = labelled
    more = docs.unionByName(docs.where("doc_id < 6").selectExpr("doc_id", "'fine' as text", "lang", "source", "n_chars"))
    assert toxicity.keep_clean(more, labels).where("doc_id = 0").collect()[0]["text"] == "fine"
    assert toxicity.score(more, labels).count() == 306



def test_an_automaton_of_two_thousand_letters_equals_plain_edit_distance():
    r = random.Random(8)
    letters = [chr(0x4E00 + i) for i in range(2000)]
    terms = ["".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(300)]
    a = toxicity.automaton(terms)
    assert a.table is None and len(a.letters) > 1000
    words = []
    for t in terms:
        i = r.randrange(len(t))
        words += [t, t[:i] + t[i + 1 :], t[:i] + r.choice(letters) + t[i:], t[:i] + r.choice(letters) + t[i + 1 :], t + r.choice(letters) * 3, r.choice(letters) + t[1:] + "xy"]
    words = [w for w in words if w]
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    edge = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    assert a.run(points, edge[:-1], edge[1:]).tolist() == [plain(w, terms) for w in words]
    with pytest.raises(ValueError, match="edges"):
        toxicity.automaton(terms, most_edges=1000)


def test_beginnings_of_a_megabyte_without_spaces_are_few_and_those_of_plain_text():
    r = random.Random(9)
    text = "".join(chr(0x4E00 + r.randrange(2000)) for _ in range(350_000))
    ((_, got),) = toxicity.beginnings(pa.array([text]))
    assert len(got.hash) <= 7 * 350_000
    ((_, got),) = toxicity.beginnings(pa.array(["The theme, 漢字漢 abc漢", None, ""]))
    want = {"the", "the", "them", "theme", "漢字", "漢字漢", "字漢", "abc", "abc漢"}
    assert {got.text(i) for i in range(len(got.hash))} == want and set(got.doc.tolist()) == {0} and len(got.hash) == len(want)


def test_scores_equal_a_plain_reading(spark):
    r = random.Random(10)
    terms = ["blork", "snargle", "zib", "漢字"]
    parts = ["blork", "blorx", "snarglex", "snargl", "zib", "zab", "漢字", "漢X", "plain", "words", '"', "“", "\n", "x" * 40]
    texts = [" ".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(60)] + ["", None]
    a = toxicity.automaton(terms)
    weights = np.array([1.0, -0.5, 0.7, -0.2, 0.4, -1.0])
    rows = []
    for t in texts:
        t = (t or "").lower()
        hits, nth, counts = [], 0, [0, 0, 0, 0, 0]
        for m in re.finditer(r"[^\W_]+", t):
            starts = [m.start()] + [i for i in range(m.start() + 1, m.end()) if "一" <= t[i] <= "鿿"]
            for i in starts:
                kind = plain(t[i : m.end()], terms)
                if kind:
                    quoted = len(re.findall("[\"“”«»„]", t[t.rfind("\n", 0, i) + 1 : i])) % 2
                    counts[2 * (kind == 2) + quoted] += 1
                    counts[4] += bool(hits) and nth - hits[-1] <= toxicity.NEAR_WORDS
                    hits.append(nth)
                nth += 1
        x = np.log1p(counts)
        rows.append(1 / (1 + math.exp(-(x @ weights[:-1] + weights[-1]))))
    batch = pa.RecordBatch.from_arrays([pa.array([t or "" for t in texts])], names=["text"])
    got = [s for b in toxicity._scored(a, weights, [])(iter([batch])) for s in b.column("score").to_pylist()]
    assert np.allclose(got, rows)
