"""Alignment of two tokenizers against a plain walk over the tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from logweave.llm import alignment

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    a = tokenizers.Tokenizer.from_file(alignment.FIRST)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.SECOND)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(13)
    parts = ["the", "naïve", "日本語", "  ", "\n\n", "\t", "don't", "<|endoftext|>", "<s>", "é", "é", "👩‍👩‍👧", "한국어", "12345", "!!!", " ", "ｆｕｌｌ", "ß", "العربية", "हिन्दी", "<0x41>", "\x01", "\U0001f600"]
    made = ["".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(1, 40))) for _ in range(80)]
    made += ["same text here"] * 5 + ["", None, " ", "\n", "a", "▁", "a▁b", "x" * 5000, "日本" * 3000, "𠀀𠀁𠀂" * 300, " ".join(r.choices(parts, k=20_000))]
    return made


def groups_of(both, text):
    """[(a ids, b ids)] of a text, or none."""
    if not text:
        return []
    a, b = both
    pa_, pb = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    letters = alignment._byte_letters()
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in pa_]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in pb]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return []
    out, ga, gb, i, j, at_a, at_b = [], [], [], 0, 0, 0, 0
    while i < len(pa_) or j < len(pb):
        if at_a <= at_b:
            at_a += len(bytes_a[i])
            ga.append(pa_[i])
            i += 1
        else:
            at_b += len(bytes_b[j])
            gb.append(pb[j])
            j += 1
        if at_a == at_b:
            out.append((ga, gb))
            ga, gb = [], []
    return out


def brute(both, docs):
    found = [(i, groups_of(both, t)) for i, t in docs]
    links = [Counter((x, y) for ga, gb in g for x in ga for y in gb) for _, g in found]
    count = Counter(p for c in links for p in c)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (i, g), c in zip(found, links):
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        digest = hashlib.sha256(said.encode()).hexdigest() if g else ""
        n_best = sum(n for p, n in c.items() if count[p] == best[p[0]])
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), n_best, sum(n * count[p] for p, n in c.items()), digest))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, *((0,) + r[1:] if r[0] is None else r)))


@pytest.mark.parametrize("heavy", [alignment.HEAVY, 40, 1])
def test_aligns_as_a_plain_walk_does(spark, both, texts, heavy):
    docs = list(enumerate(texts)) + [(3, texts[3]), (3, texts[4]), (None, texts[0]), (None, None)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, row int, pairs string").repartition(6)
    got = alignment.align(df, heavy=heavy)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert ordered(got.collect()) == ordered(brute(both, docs))


def test_an_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rank_and_select_of_bits():
    r = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 1000):
        at = np.flatnonzero(r.random(n) < 0.3)
        words = alignment.bitset(at, n)
        assert alignment.select(words).tolist() == at.tolist()
        assert alignment.rank(words, np.arange(n)).tolist() == [int((at <= i).sum()) for i in range(n)]


def test_wide_groups_are_linked_by_their_ids():
    r = np.random.default_rng(5)
    a, b = r.integers(0, 50, 300), r.integers(0, 40, 400)
    ra, rb = np.array([0, 100, 101, 300]), np.array([0, 2, 200, 400])
    doc, pair, times = alignment._links(a, b, ra, rb, np.array([0, 0, 1]), 100)
    want = Counter()
    for g, d in enumerate((0, 0, 1)):
        for x in a[ra[g] : ra[g + 1]]:
            for y in b[rb[g] : rb[g + 1]]:
                want[d, int(x) * 100 + int(y)] += 1
    assert dict(zip(zip(doc.tolist(), pair.tolist()), times.tolist())) == want


def test_ids_equal_the_vocabulary_files_own(both):
    """The faster encoder gives what the vocabulary file's own library gives, over all kinds of code points."""
    a = alignment.ByteLevel(open(alignment.FIRST, "rb").read())
    r = random.Random(4)
    texts = ["".join(chr(r.choice([r.randint(1, 127), r.randint(128, 0xD7FF), r.randint(0xE000, 0x1FFFF)])) for _ in range(60)) for _ in range(300)]
    assert [x.tolist() for x in a.encode(texts)] == [both[0].encode(t, add_special_tokens=False).ids for t in texts]
