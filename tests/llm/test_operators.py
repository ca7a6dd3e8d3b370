"""The ten operators against brute force on small tables of nulls, empties, repeats, long texts and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import embedding_dedup, jaccard_join, merkle, mixing, pii, registry, segmentation, sharding, substring_dedup, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts, sources=None):
    sources = sources or [("a", "b", "c", None)[i % 4] for i in range(len(texts))]
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, (t, s) in enumerate(zip(texts, sources))], DOCS)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    made = [" ".join(r.choices(vocabulary, k=r.randint(1, 90))) for _ in range(60)]
    passage = " ".join(r.choices(vocabulary, k=40))
    made += [f"{made[i]} {passage} {made[i + 1]}" for i in range(6)]
    made += [made[20]] * 4 + [made[21] + " tail", made[22].upper()]
    made += ["same " * 70, "", None, " \t\n", "one", "two words", "é ü ß 漢字 \U0001f600", passage * 30]
    return made


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def rows_of(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is None, r[key]))


def test_jaccard_join_links_what_brute_force_links(spark, texts):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    roots = components(len(texts), links)
    got = rows_of(jaccard_join.join(table(spark, texts), size=4, num=17, den=20))
    assert [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got] == [(i, len(s), roots[i]) for i, s in enumerate(sets)]
    kept = rows_of(jaccard_join.one_of_each(table(spark, texts), size=4, num=17, den=20))
    assert [r["doc_id"] for r in kept] == [i for i in range(len(texts)) if roots[i] == i]


def test_jaccard_join_of_hot_signatures(spark, texts, monkeypatch):
    """Every signature treated as a hot one, in blocks of two, gives what comparing its pairs gives; unlike documents under one licence text meet seldom."""
    columns = ("doc_id", "n_shingles", "component_id")
    near = [" ".join(w for i, w in enumerate(texts[k].split()) if i != j) for k in range(12) for j in (3, 40)]
    docs = table(spark, texts + near)
    expected = [tuple(r[c] for c in columns) for r in rows_of(jaccard_join.join(docs))]
    seen, meetings = [], jaccard_join._rare_meetings

    def counted(*a):
        got = meetings(*a)
        seen.append((a[1].count(), got.count()))
        return got

    monkeypatch.setattr(jaccard_join, "HOT_PAIRS", 0)
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    monkeypatch.setattr(jaccard_join, "_rare_meetings", counted)
    assert [tuple(r[c] for c in columns) for r in rows_of(jaccard_join.join(docs))] == expected
    licence = " ".join(f"clause{i}" for i in range(60))
    r = random.Random(9)
    unlike = [f"{licence} {' '.join(f'u{r.random()}' for _ in range(40))}" for _ in range(300)] + ["\u00e9 " * 3 + licence]
    seen.clear()
    got = rows_of(jaccard_join.join(table(spark, [*unlike, unlike[7] + " tail"])))
    assert [x["component_id"] for x in got] == [*range(301), 7]
    assert seen and seen[0][0] > 200 and seen[0][1] < 3000  # of some 45,000 pairs


def test_substring_dedup_removes_what_brute_force_removes(spark, texts):
    seen, expected = {}, []
    words = [WORD.findall(t or "") for t in texts]
    gone = [set() for _ in texts]
    for d, w in enumerate(words):
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[d].update(range(i, i + 20))
            seen.setdefault(key, (d, i))
    for d, w in enumerate(words):
        kept = " ".join(x for i, x in enumerate(w) if i not in gone[d])
        expected.append((d, len(w), len(gone[d]), hashlib.sha256(kept.encode()).hexdigest()))
    got = rows_of(substring_dedup.parse(table(spark, texts)))
    assert [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got] == expected
    for r, w, g in zip(got, words, gone):
        covered = []
        for f in r["factors"]:
            source, a, b = words[f["ref_doc"]], f["ref_start"], f["start"]
            assert (f["ref_doc"], a) < (r["doc_id"], b) and source[a : a + f["words"]] == w[b : b + f["words"]]
            covered += range(b, b + f["words"])
        assert covered == sorted(g)


def test_factors_run_as_long_as_their_reference(spark):
    """A document made of two passages of others, and one whose factors meet inside a window: equal blocks refer to the first such block, other windows to the first such window."""
    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    lines = [a, b, [*c[:5], *a[10:50], *c[5:9], *b[:30]], [*a[20:45], *b[12:40]], [*a[20:45], *b[12:24], *c[20:60]]]
    got = rows_of(substring_dedup.parse(table(spark, [" ".join(x) for x in lines])))
    shown = [[tuple(f) for f in r["factors"]] for r in got]
    assert shown == [[], [], [(5, 40, 0, 10), (49, 30, 1, 0)], [(0, 25, 0, 20), (25, 28, 1, 12)], [(0, 24, 3, 0), (24, 1, 0, 44), (25, 12, 3, 25)]]


def test_mixing_fills_targets_and_caps(spark, texts):
    sources = ["hot"] * (len(texts) // 3 * 2) + ["mid"] * (len(texts) // 4)
    sources += [None] * (len(texts) - len(sources))
    got = rows_of(mixing.mix(table(spark, texts, sources)))
    sizes, weights = {}, {}
    for t, s in zip(texts, sources):
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        weights[s] = (5, 2, 1)[i % 3]
    target, free = {}, set(sizes)
    while True:
        left = sum(sizes.values()) - sum(target.values())
        over = {s for s in free if left * weights[s] / sum(weights[x] for x in free) > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3 * sizes[s] for s in over}
        free -= over
    target |= {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
    taken = {}
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["times"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["times"] * r["size"]
    for s in sizes:
        biggest = max(r["size"] for r in got if r["source"] == s)
        assert abs(taken[s] - target[s]) <= biggest
    assert got == rows_of(mixing.mix(table(spark, texts, sources)))


def test_urls_follow_the_longest_rule(spark):
    rules = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("allow", "example.net", "/de/8"), ("block", "org", "/es/"))
    given = [None, "", "nothing", "http://A.Example.COM/en/71?x", "http://xcom/en/", "https://example.com/en/8#f", "ftp://example.net", "http://x.net/de/9", "http://a.org?/es/", "http://a.org/es/x", "http://a.org/es/x", "http://notexample.com/en/7"]
    expected = []
    for i, u in enumerate(given):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        expected.append((i, host, path, *(max(fits)[1:] if fits else (None, "allow"))))
    got = rows_of(urls.filter_urls(spark.createDataFrame(list(enumerate(given)), "page_id long, url string")), "page_id")
    assert [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == expected


def test_url_rules_are_the_contracts(spark):
    """Block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/."""
    given = {
        "http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/71": ("example.com/en/7", "allow"), "http://x.net/de/9": ("net/de/", "allow"), "http://example.net/de/9": ("net/de/", "allow"),
        "http://example.net/de/8": ("example.net/de/8", "block"), "http://a.example.net/de/81?x": ("example.net/de/8", "block"), "http://a.org/es/x": ("org/es/", "block"), "http://z.io/de/8": (None, "allow"),
    }
    got = rows_of(urls.filter_urls(spark.createDataFrame(list(enumerate(given)), "page_id long, url string")), "page_id")
    assert [(r["rule"], r["verdict"]) for r in got] == list(given.values())


def test_urls_by_shard_equal_urls_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(urls, "KEYS_PER_SHARD", 40)
    r = random.Random(2)
    hosts, given = ["a.com", "example.com", "x.net", "example.net", "y.org", "z.io"], ["http://a.com/en/hot"] * 90 + [None, "", "no scheme"]
    given += [f"http://{r.choice(hosts)}/{r.choice(['en', 'de', 'es'])}/{r.randint(0, 80)}" for _ in range(250)]
    rows = [(i, u, f"h{i}", {"k": i}) for i, u in enumerate(given)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, extra map<string,int>")
    one, other = (rows_of(urls.filter_urls(pages, broadcast_bytes=b, group_rows=25), "page_id") for b in (1 << 20, 0))
    assert one == other and len(one) == len(given) and {x["verdict"] for x in one} == {"allow", "block"}
    assert urls.filter_urls(pages.limit(0), broadcast_bytes=-1).count() == 0


def luhn(digits):
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def test_pii_base_spans_equal_plain_regexes(spark):
    given = [
        "mail a.b@c.de, and x@y.z.w! ip 10.0.0.255 or 10.0.0.256; card 4111 1111 1111 1111 call +49 (30) 123-4567 89.",
        "漢字 \U0001f600 me@host.org +1 2", "1.2.3.4.5.6.7.8 4111111111111112 4111-1111-1111-1111", "", None, "@ + . a@b", "+1234567890123456 +12 345 678 90",
        "long " * 3000 + "end@of.text",
    ]
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub("[^0-9]", "", s)
    holds = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s)), "phone": lambda s: 10 <= len(digits(s)) <= 15}
    got = rows_of(pii.report(pii.find(table(spark, given))))
    for r, t in zip(got, given):
        spans = sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(patterns.items()) for m in re.finditer(p, t or "") if holds[kind](m[0]))
        shown = ",".join(f"{kind}:{a}:{z}" for a, _, kind, z in spans)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest(), (t, shown, r)
        assert {k: r[f"n_{k}"] for k in patterns} == {k: sum(s[2] == k for s in spans) for k in patterns}
    out = rows_of(pii.sanitise(table(spark, given)))
    assert len(out) == len(given) and not any("a.b@c.de" in (r["text"] or "") or "end@of.text" in (r["text"] or "") for r in out)


def disclosed(pairs, given, n_docs):
    """Terms that disclose an entity, from (entity, term): documents, term: documents and the entities' own counts."""
    both, n_e = pairs
    out = set()
    for (e, t), n in both.items():
        prior = n_e[e] / n_docs
        p = (n + prior) / (given[t] + 1)
        if p >= 0.5 and n_e[e] < n_docs and 1 + math.log2(p) / -math.log2(prior) >= 0.8:
            out.add(t)
    return out


def test_pii_terms_of_rare_entities_equal_brute_force(spark):
    """Entities of one and two documents, all terms near them."""
    r = random.Random(5)
    given = [" ".join(r.choices([f"w{i}" for i in range(40)], k=9)) for _ in range(300)]
    given[7] += " zorblax a1@host.org"
    given[8] += " quimby a2@host.org"
    given[9] += " quimby a2@host.org"
    given[10] += " strayed a3@host.org"
    given[11] += " strayed"
    email = re.compile(r"a[0-9]@host\.org")
    both, n_e, docs = {}, {}, {}
    for text in given:
        es, ts = set(email.findall(text)), set(email.sub(" ", text).split())
        for e in es:
            n_e[e] = n_e.get(e, 0) + 1
        for t in ts:
            docs[t] = docs.get(t, 0) + 1
        for e in es:
            for t in ts:
                both[e, t] = both.get((e, t), 0) + 1
    expected = disclosed((both, n_e), docs, len(given))
    assert expected == {"zorblax", "quimby"}
    for row, text in zip(rows_of(pii.find(table(spark, given))), given):
        assert {text[t["start"] : t["end"]] for t in row["terms"]} == expected & set(text.split())


def test_pii_counts_terms_and_entities_over_the_same_documents(spark):
    """Terms anywhere in a document of the entity, two-character names, terms inside spans, copies and a frequent entity."""
    r = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    given = [" ".join(r.choices(words, k=30)) for _ in range(400)]
    for i in range(10):
        given[i] = f"{'zorblax ' if i < 4 else ''}a1@host.org {given[i]} {'' if i < 4 else 'zorblax'} {'mostly' if i < 6 else ''} {'half' if i < 5 else ''}"
    for i in range(10, 15):
        given[i] += " half"
    given[15] += " mostly"
    given[20] = f"\u674e\u96f7 {given[20]} a2@host.org"
    given[21] = f"Qi {given[21]} a3@host.org a4@host.org"
    given[22] += " a5@wide.org"
    given[23] += " wide"
    given[24:28] = [f"copied {given[24]} a6@host.org"] * 4
    for i in range(30, 170):
        given[i] = f"tail {given[i]} a7@host.org"
    email = re.compile(r"a[0-9]@[a-z]+\.org")
    both, n_e, docs = {}, {}, {}
    for text in given:
        es, ts = set(email.findall(text)), set(email.sub(" ", text).lower().split())
        for e in es:
            n_e[e] = n_e.get(e, 0) + 1
        for t in ts:
            docs[t] = docs.get(t, 0) + 1
        for e in es:
            for t in ts:
                both[e, t] = both.get((e, t), 0) + 1
    expected = disclosed((both, n_e), docs, len(given))
    assert {"zorblax", "mostly", "\u674e\u96f7", "qi", "copied", "tail"} <= expected and not {"half", "wide", *words} & expected
    for row, text in zip(rows_of(pii.find(table(spark, given))), given):
        found = sorted(text[t["start"] : t["end"]].lower() for t in row["terms"])
        assert found == sorted(t for t in email.sub(" ", text).lower().split() if t in expected)


def test_sharding_is_gapless_and_grows_into_the_new_shard_only(spark, texts):
    got = rows_of(sharding.assign(table(spark, texts)))
    places = {}
    for r, t in zip(got, texts):
        raw = (t or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_sharding_is_decided_by_id_and_shard_count_alone(spark, texts):
    docs = table(spark, texts)
    grown = {r["doc_id"]: r["grown_shard"] for r in sharding.assign(docs, n_shards=16).collect()}
    assert grown == {r["doc_id"]: r["shard"] for r in sharding.assign(docs, n_shards=17).collect()}
    for n in (1, 2, 5, 16):
        slots, more = sharding.first_map(n), sharding.first_map(n + 1)
        assert all(b in (a, n) for a, b in zip(slots, more)) and max(map(slots.count, range(n))) - min(map(slots.count, range(n))) <= 4096 // n // 8 + 1


def test_sharding_versions_are_kept_and_edited_by_bytes(spark, texts, tmp_path):
    docs = table(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 3")).unionByName(docs.limit(5).selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars"))
    got, path = sharding.assign(docs, n_shards=4, n_slots=64, map_path=str(tmp_path / "m")).collect(), str(tmp_path / "m")
    one, two, three = (sharding.read_map(spark, path, v) for v in (1, 2, 3))
    assert one == sharding.first_map(4, 64) and sorted(map(one.count, range(4))) == [16] * 4 and sharding.read_map(spark, path) == three
    assert all(b in (a, 4) for a, b in zip(one, two)) and abs(two.count(4) - 64 // 5) <= 1
    held, places = {}, {}
    for r in got:
        held[r["vslot"]] = held.get(r["vslot"], 0) + r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
        assert (r["shard"], r["grown_shard"], r["rebalanced_shard"]) == (one[r["vslot"]], two[r["vslot"]], three[r["vslot"]])
    assert all(r["vslot_bytes"] == held[r["vslot"]] for r in got) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert len({r["vslot"] for r in got if r["doc_id"] is None}) == 1 and len({r["shard"] for r in got if r["doc_id"] == 3}) == 1
    load = lambda m: [sum(held.get(i, 0) for i in range(64) if m[i] == s) for s in range(4)]
    assert max(load(three)) <= max(load(one)) and three == sharding.rebalance(one, held)
    with pytest.raises(Exception, match="exists"):
        sharding.write_map(spark, path, 3, one)


def test_rebalancing_moves_slots_off_a_hot_shard():
    slots, held = [i % 4 for i in range(32)], {i: 10 for i in range(32)} | {0: 100, 4: 90}
    after = sharding.rebalance(slots, held)
    load = [sum(held[i] for i in range(32) if after[i] == s) for s in range(4)]
    assert max(load) < 190 and sum(load) == sum(held.values()) and max(load) - min(load) <= 100
    assert sharding.rebalance(slots, {}) == slots and sharding.rebalance(slots, {0: 1000}) == slots


def paragraphs(text):
    return [hashlib.md5(m.encode()).hexdigest() for m in re.findall(merkle.PARAGRAPH.replace("\\z", "\\Z"), text)]


def sections(leaves):
    return [hashlib.md5(x.encode()).hexdigest() for x in "".join(h + "." if h < "4" else h for h in leaves).split(".")]


def test_fingerprints_tell_equality_and_edits(spark, texts):
    texts = [*texts, "no stops here " * 60, "漢字。" * 90, ("a line. " * 3 + "\n") * 20]
    got = rows_of(merkle.compare_with_edit(table(spark, texts)))
    prints = {}
    for i, (r, t) in enumerate(zip(got, texts)):
        t, following = t or "", texts[i - 1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"] and 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        mine, other = sections(paragraphs(t)), sections(paragraphs(edited))
        assert r["edited_sections"] == ",".join(str(k) for k, h in enumerate(mine) if h not in other)
        assert r["fingerprint"].split(":")[0] == hashlib.md5("".join(mine).encode()).hexdigest()
    assert len(set(prints.values())) == len(prints)


def test_embedding_links_equal_brute_force(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(40, 16)).astype(np.float32)
    vectors = [v for v in base] + [b + r.normal(size=16).astype(np.float32) * 0.05 for b in base for _ in range(3)] + [base[0]] * 30
    labels = [i % 40 % 3 if i < 40 else (i - 40) // 3 % 3 if i < 160 else 0 for i in range(len(vectors))]
    rows = [(i, [float(x) for x in v], l) for i, (v, l) in enumerate(zip(vectors, labels))]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, rows[0][1], None), (504, [], 0)]
    m = np.array(vectors, dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = (m @ m.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    roots = components(len(m), [(int(a), int(b)) for a, b in np.argwhere(np.tril(near, -1))])
    got = rows_of(embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), threshold=0.98), "vec_id")
    expected = [(i, int(near[i].sum()) - 1, roots[i], roots[i] == i) for i in range(len(m))] + [(i, 0, i, True) for i in range(500, 505)]
    found = sum(g["n_links"] for g in got)
    assert found >= 0.9 * sum(e[1] for e in expected)
    assert [(g["vec_id"], g["n_links"], g["component_id"], g["kept"]) for g in got] == expected


def test_embedding_counts_of_tight_and_wide_groups_and_repeated_ids(spark):
    r = np.random.default_rng(7)
    base = r.normal(size=(3, 12))
    tight = base[0] + r.normal(size=(400, 12)) * 0.02  # nearly all within half the angle of any
    chain = [base[1] / np.linalg.norm(base[1])]
    for _ in range(60):  # neighbours link, ends do not
        v = chain[-1] + 0.04 * (base[2] / np.linalg.norm(base[2]))
        chain.append(v / np.linalg.norm(v))
    wide = base[0] + r.normal(size=(80, 12)) * 0.16
    x = np.concatenate([tight, chain, wide, [base[0] * 1e200, base[1] * 1e-200]])
    m = x / np.abs(x).max(axis=1, keepdims=True)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.98
    roots = components(len(m), [(int(a), int(b)) for a, b in np.argwhere(np.tril(near, -1))])
    frame = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = rows_of(embedding_dedup.link(frame, threshold=0.98), "vec_id")
    assert [(g["n_links"], g["component_id"]) for g in got] == [(int(near[i].sum()) - 1, roots[i]) for i in range(len(m))]
    assert all(0 <= g["recall"] <= 1 for g in got)
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.001], 0), (3, [0.001, 1.0], 0), (3, [0.001, 1.0], 0), (None, [1.0, 0.0], 0), (4, [1.0, 0.0, 0.0], 0)]
    got = embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), threshold=0.98)
    shown = sorted((g["vec_id"] or 0, g["n_links"], g["component_id"] or 0, g["kept"]) for g in got.collect())
    assert shown == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]


@pytest.mark.parametrize("pairs", [0, 5, 500])
def test_embedding_search_tells_its_recall_and_compares_few_pairs(spark, pairs):
    """Whatever the number of links in the data, the search is the same and what it misses shows in its own recall."""
    r = np.random.default_rng(2 + pairs)
    x = r.normal(size=(6000, 24))
    x[3000 : 3000 + pairs] = x[:pairs] + r.normal(size=(pairs, 24)) * 0.02
    frame = spark.createDataFrame([(i, 0, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    compared = spark.sparkContext.accumulator(0)
    got = rows_of(embedding_dedup.link(frame, threshold=0.98, compared=compared), "vec_id")
    assert got[0]["recall"] >= 0.9
    assert {g["vec_id"]: g["component_id"] for g in got if g["component_id"] != g["vec_id"]} == {3000 + i: i for i in range(pairs)}
    assert sum(g["n_links"] for g in got) == 2 * pairs
    assert 0 < compared.value < 0.25 * 6000 * 5999 / 2


def test_embedding_exact_audit_and_a_low_recall_that_shows(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = r.normal(size=(900, 16))
    x[600:] = x[:300] + r.normal(size=(300, 16)) * 0.02
    frame = spark.createDataFrame([(i, 0, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    want = [i - 600 if i >= 600 else i for i in range(900)]
    assert [g["component_id"] for g in rows_of(embedding_dedup.link(frame, threshold=0.98), "vec_id")] == want
    monkeypatch.setattr(embedding_dedup, "_compare", lambda pdf: pdf[["id"]].assign(u=0, v=1, sim=0.0)[["u", "v", "sim"]].head(0))
    got = rows_of(embedding_dedup.link(frame, threshold=0.98, max_cycles=1), "vec_id")
    assert got[0]["recall"] == 0.0 and [g["component_id"] for g in got] == list(range(900))
    got = rows_of(embedding_dedup.link(frame, threshold=0.98, max_cycles=1, exact=True), "vec_id")
    assert got[0]["recall"] == 0.0 and [g["component_id"] for g in got] == want


def test_segmentations_decode_differ_and_repeat(spark, texts):
    got = rows_of(segmentation.encode(table(spark, texts), k=3, with_ids=True))
    v = segmentation.vocabulary(segmentation.MODEL)
    for r, t in zip(got, texts):
        assert segmentation.decode(v, r["ids"]) == (t or "")
        assert all(s["decodes"] and 0 <= s["inclusion"] <= 1 for s in r["samples"])
        assert len({s["ids_sha256"] for s in r["samples"]}) == len(r["samples"])
        assert sorted((s["score"] for s in r["samples"]), reverse=True) == [s["score"] for s in r["samples"]]
    assert got == rows_of(segmentation.encode(table(spark, texts), k=3, with_ids=True))


def segmentations(v, sp, word):
    """All ways to write a short word in pieces: (ids, sum of logarithms)."""
    piece = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    if not word:
        return [((), 0.0)]
    out = []
    for k in range(1, len(word) + 1):
        if word[:k] in piece:
            i = piece[word[:k]]
            out += [((i, *rest), float(v.logp[i]) + lp) for rest, lp in segmentations(v, sp, word[k:])]
    return out


def test_samples_of_small_lattices_follow_their_probabilities(spark):
    """Against all segmentations listed: probabilities, frequencies, inclusion, and that nothing is drawn twice."""
    from sentencepiece import SentencePieceProcessor

    v, sp = segmentation.vocabulary(), SentencePieceProcessor(model_file=segmentation.MODEL)
    text = "the cat"
    both = [(a + b, x + y) for a, x in segmentations(v, sp, "▁the") for b, y in segmentations(v, sp, "▁cat")]
    total = math.log(sum(math.exp(lp) for _, lp in both))
    p = {ids: math.exp(lp - total) for ids, lp in both}
    n, k = 4000, 3
    got = list(segmentation.encode_texts(v, [text] * n, np.arange(n) * 7919, k))
    first, weighed = {}, 0.0
    for samples in got:
        shown = [tuple(ids.tolist()) for ids, *_ in samples]
        assert len(set(shown)) == k == len(shown)
        for ids, lp, score, q in samples:
            assert lp == pytest.approx(math.log(p[tuple(ids.tolist())]), abs=1e-6) and 0 < q <= 1
            weighed += p[tuple(ids.tolist())] / q / n
        first[shown[0]] = first.get(shown[0], 0) + 1
    assert weighed == pytest.approx(1, abs=0.05)  # inverse inclusion weighs the samples back to all
    assert all(abs(first.get(ids, 0) / n - q) < 4 * math.sqrt(q / n) + 1e-3 for ids, q in p.items())
    every = next(segmentation.encode_texts(v, [text], np.array([1]), len(p) + 5))
    assert {tuple(ids.tolist()) for ids, *_ in every} == set(p) and len(every) == len(p) and all(q == 1 for *_, q in every)


def test_copies_get_other_samples(spark):
    docs = table(spark, ["several words to be cut into pieces"] * 2).withColumn("doc_id", F.lit(1)).unionByName(table(spark, [None, ""]))
    got = segmentation.encode(docs, k=1, copies=True).collect()
    assert len(got) == 4 and len({r["samples"][0]["ids_sha256"] for r in got if r["doc_id"] == 1 and r["samples"][0]["n_ids"]}) == 2
    assert segmentation.encode(docs.limit(0), copies=True).count() == 0


def test_very_long_texts(spark):
    """Over the slices' sizes, and one word without an end."""
    r = random.Random(9)
    long_ = " ".join(r.choices([f"word{i}" for i in range(5000)], k=700_000))
    docs = table(spark, [long_, "z" * 1_500_000, "short text", long_[:3000] + " tail"])
    got = rows_of(substring_dedup.parse(docs))
    assert [x["n_words"] for x in got] == [700_000, 1, 2, len(long_[:3000].split()) + 1] and got[3]["n_removed"] > 300
    assert [x["n_shingles"] for x in rows_of(jaccard_join.join(docs))][1:3] == [1, 1]
    assert pii.report(pii.find(docs)).count() == 4 and sharding.assign(docs).count() == 4
    assert len(toxicity._beginnings("z" * 1_500_000)) == toxicity.LONGEST - toxicity.SHORTEST + 1
    samples = rows_of(segmentation.encode(docs.where("doc_id > 0"), k=2))
    assert all(s["decodes"] for x in samples for s in x["samples"])


def test_toxicity_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    hits = (got["predicted"] == 1) & (got["toxic"] == 1)
    assert hits.sum() / max(1, (got["toxic"] == 1).sum()) >= 0.8
    assert hits.sum() / max(1, (got["predicted"] == 1).sum()) >= 0.8
    assert got["score"].between(0, 1).all()


def test_clashing_columns_and_empty_tables(spark, texts):
    docs = table(spark, texts[:8] + ["", None]).selectExpr("*", "1 as size", "2 as shard", "3 as target", "'x' as word", "4 as label", "5 as h", "6 as class_id")
    calls = {
        "mixing": mixing.mix, "pii": lambda d: pii.report(pii.find(d)), "substring": substring_dedup.parse, "merkle": merkle.compare_with_edit, "sharding": sharding.assign,
        "jaccard": jaccard_join.join, "segmentation": segmentation.encode,
    }
    for name, f in calls.items():
        assert f(docs).count() == 10, name
        assert f(docs.limit(0)).count() == 0, name
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, labels).count() == 10
    assert toxicity.score(docs.limit(0), labels.limit(0)).count() == 0
    for f in (mixing.repeated, pii.sanitise, jaccard_join.one_of_each):
        assert f(docs).columns == docs.columns and f(docs.limit(0)).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.link(vectors).count() == 0
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_segmentation_query_returns_the_ids(spark, tmp_path):
    table(spark, ["some words to cut", "", None, "\u6f22\u5b57 \U0001f600"]).write.parquet(f"{tmp_path}/documents.parquet")
    for r in rows_of(registry.op5_sentencepiece(spark, str(tmp_path))):
        assert r["ids"] == r["samples"][0]["ids"]
        for x in r["samples"]:
            assert len(x["ids"]) == x["n_ids"] and hashlib.sha256(np.array(x["ids"], "<i4").tobytes()).hexdigest() == x["ids_sha256"]


def test_sentencepiece_decodes_by_the_table_of_pieces():
    v = segmentation.vocabulary()
    ids = random.Random(3).choices(range(len(v.piece)), k=5000)
    assert v.flat.tobytes() == b"".join(v.piece) and segmentation.decode_bytes(v, ids) == b"".join(v.piece[i] for i in ids)[1:]
    assert segmentation.decode_bytes(v, []) == b""


def pieces_of(v):
    single = set(v.byte.tolist())
    return {p.decode().replace(" ", "▁"): i for i, p in enumerate(v.piece) if p and i not in single}


def test_trie_holds_every_piece_and_nothing_else():
    v = segmentation.vocabulary()
    pieces = pieces_of(v)
    begun = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
    r = random.Random(7)
    others = {p[: r.randint(0, len(p))] + chr(r.choice([0x61, 0x2581, 0x4E00, 0x1F600, 0xF2581, r.randint(32, 0x2FFF)])) for p in r.choices(list(pieces), k=20000)}
    for text in [*begun, *others]:
        node = 0
        for c in map(ord, text):
            to = int(v.base[node]) + int(v.kind[c])
            node = to if v.parent[to] == node else -1
            if node < 0:
                break
        assert (node >= 0) == (text in begun) and (node < 0 or v.ends[node] == pieces.get(text, -1)), text


def test_lattices_near_and_far_from_the_ends_of_words():
    """Probabilities of all edges of words up to 90 long, with code points that have no piece, against sums of logarithms."""
    v, r = segmentation.vocabulary(), random.Random(11)
    words = ["".join(r.choices("▁theanior漢\U0001f600\x01", k=k)) for k in (1, 1, 2, 5, 17, 18, 19, 20, 40, 90)] + ["\U0001f600" * 60]
    r.shuffle(words)
    points, size = np.array(list(map(ord, "".join(words))), np.int32), np.array(list(map(len, words)))
    x = segmentation.Lattices(v, points, np.cumsum(size), size)
    pieces = pieces_of(v)
    for w, at in zip(words, x.start.tolist()):
        after, beta = {}, {len(w): 0.0}
        for i in reversed(range(len(w))):
            after[i] = [(j, pieces[w[i:j]], float(v.logp[pieces[w[i:j]]])) for j in range(i + 1, len(w) + 1) if w[i:j] in pieces]
            if not after[i]:
                b = int(v.byte[ord(w[i])]) if ord(w[i]) < 128 else -1
                after[i] = [(i + 1, b, float(v.logp[b]) if b >= 0 else 3 * float(v.logp.min()))]
            top = max(lp + beta[j] for j, _, lp in after[i])
            beta[i] = top + math.log(sum(math.exp(lp + beta[j] - top) for j, _, lp in after[i]))
        todo, seen = [(at, 0)], set()
        while todo:
            node, i = todo.pop()
            if i == len(w) or node in seen:
                assert i < len(w) or node < x.words
                continue
            seen.add(node)
            edges = range(x.first[node], x.first[node + 1])
            assert x.points[node] == ord(w[i]) and [int(x.piece[e]) for e in edges] == [p for _, p, _ in after[i]]
            for e, (j, _, lp) in zip(edges, after[i]):
                assert x.src[e] == node and x.p[e] == pytest.approx(math.exp(lp + beta[j] - beta[i]), rel=1e-9)
                todo.append((int(x.to[e]), j))


def test_sampling_needs_bounded_memory_and_few_calls_a_text():
    """Counts that don't depend on the machine; before lattices were numbered by distance 186 bytes a byte of text and 152 calls a text."""
    import cProfile
    import pstats
    import tracemalloc

    v, r = segmentation.vocabulary(), random.Random(4)
    texts = [" ".join("".join(r.choices(["th", "er", "on", "ing", "re", "st", "an", "ble", "ou"], k=r.randint(1, 5))) for _ in range(300)) for _ in range(250)]
    keys = np.arange(len(texts))
    list(segmentation.encode_texts(v, texts, keys, 2))
    tracemalloc.start()
    for _ in segmentation.encode_texts(v, texts, keys, 2):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 140 * sum(map(len, texts))
    profile = cProfile.Profile()
    profile.runcall(lambda: list(segmentation.encode_texts(v, texts, keys, 2)))
    assert pstats.Stats(profile).total_calls < 120 * len(texts)
