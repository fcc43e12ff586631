"""Spot signatures against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kinetrace.llm import fingerprints as fp
from kinetrace.llm import jaccard as jaccard_join
from kinetrace.llm import queries, words
from kinetrace.llm.jaccard import shares

from .conftest import SMALL, documents


def brute(rows):
    """(doc_id, edited text, own set, next set) in descending order."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        yield d, t, t[: len(t) - half] + n[:half], n


def jaccard(a, b):
    cut = lambda s: {s[i : i + 8] for i in range(0, len(s), 8)}
    a, b = cut(a), cut(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def one(text):
    return fp.shown(fp.fingerprints(pa.array([text]))[0])


def check(got, rows):
    want = sorted(brute(rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    got = sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256))
    want.sort(key=lambda x: (x[0] is None, x[0] or 0, len(x[1]), hashlib.sha256(x[2].encode()).hexdigest()))
    assert len(got) == len(want)
    for r, (d, t, e, n) in zip(got, want, strict=True):
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (d, len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (one(t), one(e))
        assert abs(r.near_edited - jaccard(one(t), one(e))) < 1e-12 and abs(r.near_next - jaccard(one(t), one(n))) < 1e-12


def test_whole_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check(queries.op9_fingerprints(spark, SMALL).collect(), rows)


def test_odd_rows(spark):
    rows = [(5, None), (9, ""), (3, "é😀 the quick brown fox and the lazy dog " * 9), (None, "a b c"), (3, "zz"), (7, "one"), (8, "x " * 50_000), (-4, "the end of it all"), (9, "")]
    check(fp.fingerprint_edits(documents(spark, rows)).collect(), rows)
    check(fp.fingerprint_edits(documents(spark, rows[2:3])).collect(), rows[2:3])
    assert fp.fingerprint_edits(documents(spark, [])).count() == 0
    check(fp.fingerprint_edits(documents(spark, [(None, "a b"), (None, "c d")])).collect(), [(None, "a b"), (None, "c d")])


def plain_hash(word):
    """The words module's hash of one word, by plain integers."""
    mask = (1 << 64) - 1

    def mix(h):
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & mask
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & mask
        return h ^ h >> 31

    data = word.encode()
    total = sum(mix((c + 32 if 65 <= c <= 90 else c) + 0x1234567) * pow(words._M, i, 1 << 64) for i, c in enumerate(data)) & mask
    return mix((total + len(data)) & mask)


def plain_signatures(text):
    """(anchor or None at the start, chain) of each signature, by the rule as stated."""
    low = [w.lower() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]
    anchor = [w in fp.ANCHORS or plain_hash(w) % fp.EVERY == 0 for w in low]
    out = {(None, *low[: fp.CHAIN + 1])} if low else set()
    for i, w in enumerate(low):
        if anchor[i]:
            chain = [x for x, a in zip(low[i + 1 :], anchor[i + 1 :]) if not a][: fp.CHAIN]
            if len(chain) == fp.CHAIN:
                out.add((w, *chain))
    return out


TEXTS = [
    "the cat sat on a mat and the dog ran",
    "The Cat sat; on a mat, and the dog ran off with the cat of a neighbour of the house",
    "one", "of the", "x1 x2 x3 x4 x5 x6 x7 x8", "der Hund und die Katze gehen in das Haus, das dem Nachbarn von nebenan gehört",
    " ".join(f"w{i}" for i in range(300)), "", "!!! ...", "a b c " * 50,
]


def test_signatures_follow_the_stated_rule():
    """Sizes and all pairwise likenesses equal those of plain signature sets."""
    sets, plain = fp.fingerprints(pa.array(TEXTS)), [plain_signatures(t) for t in TEXTS]
    assert [len(x) for x in sets] == [len(x) for x in plain]
    for x, a in zip(sets, plain, strict=True):
        for y, b in zip(sets, plain, strict=True):
            assert abs(fp.likeness(x, y) - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12


def test_short_texts_are_like_their_beginnings():
    """No change of method by size: a text and most of itself share signatures at every length."""
    long = ("while the river of the north runs to the sea in a wide bed and the boats go by for the market " * 12).split()
    for n in range(4, 180):
        a, b = fp.fingerprints(pa.array([" ".join(long[:n]), " ".join(long[: max(3, n * 9 // 10)])]))
        assert fp.likeness(a, b) > 0.3


def test_ranges_of_bytes(spark):
    """Many small ranges, null and equal ids, equal rows: the same followers as in one range."""
    r = np.random.default_rng(2)
    rows = [(int(i) if i >= 0 else None, "t%d " % r.integers(0, 40) * int(r.integers(1, 30))) for i in r.integers(-30, 120, 400)] + [(7, "same row")] * 60
    df = documents(spark, rows).repartition(5)
    key = lambda x: (x is None, x)
    for size in (1 << 30, 400, 60):
        got = fp.with_next(df, size).collect()
        assert len(got) == len(rows) and sorted((key(x.doc_id), x.text) for x in got) == sorted((key(d), t) for d, t in rows)
        assert sorted((key(x.doc_id), x.text) for x in got) == sorted((key(d), t) for d, t in rows)
        follow = Counter(x.next_text for x in got)
        assert follow == Counter(t for _, t in rows)
        ids = sorted({d for d, _ in rows if d is not None}, reverse=True) + [None]
        texts = {d: {t for e, t in rows if e == d} for d in ids}
        after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
        assert all(x.next_text in texts[x.doc_id] | texts[after[x.doc_id]] for x in got)
        assert all(sum(x.next_text in texts[after[d]] for x in got if x.doc_id == d) >= 1 for d in ids)
    dealt = fp._dealt(df, 60)
    assert dealt.select("range").distinct().count() > 50
    assert all(len({x.range for x in p}) <= 1 for p in dealt.rdd.glom().collect())


def test_classes_match_brute_force(spark):
    r = np.random.default_rng(3)
    vocabulary = [f"v{i}" for i in range(400)] + list(fp.ANCHORS[:20]) * 8
    texts = []
    for _ in range(25):
        base = list(r.choice(vocabulary, int(r.integers(20, 160))))
        for k in range(5):
            t = list(base)
            for _ in range(k):
                t[r.integers(len(t))] = f"new{r.integers(10_000)}"
            texts.append(" ".join(t))
    line = " ".join(r.choice(vocabulary, 60))
    texts += [line + " " + " ".join(r.choice(vocabulary, 3)) for _ in range(80)] + [None, "", texts[0], texts[0]]
    for threshold in (0.6, 0.8):
        marks = [one(t or "") for t in texts]
        parent = list(range(len(texts)))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, a in enumerate(marks):
            for j in range(i):
                if jaccard(a, marks[j]) >= threshold - 1e-9:
                    parent[max(find(i), find(j))] = min(find(i), find(j))
        df = documents(spark, list(enumerate(texts))).withColumns({c: F.lit("old") for c in ("fingerprint", "component")})
        got = {x.doc_id: x for x in fp.near_duplicates(df, threshold).collect()}
        assert [got[i].class_id for i in range(len(texts))] == [find(i) for i in range(len(texts))]
        assert len({x.class_id for x in got.values()}) < len(texts) - 50 and got[0].component == "old"
    assert fp.near_duplicates(df.limit(0)).count() == 0


def test_common_signatures_bring_no_pairs(spark, monkeypatch):
    """Texts with one common passage and little else are compared with their near copies alone, not with each other."""
    r = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(3000)] + list(fp.ANCHORS[:40]) * 60
    passage = " ".join(r.choice(vocabulary, 90))
    texts = [passage + " " + " ".join(r.choice(vocabulary, 60)) for _ in range(40)]
    texts += [t + " and so on" for t in texts[:10]]
    compared, verified = [], jaccard_join._verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "_verified", counted)
    got = {x.doc_id: x.class_id for x in fp.near_duplicates(documents(spark, list(enumerate(texts)))).collect()}
    assert got == {i: i - 40 if i >= 40 else i for i in range(50)}
    assert sum(compared) <= 60


def test_comparisons_stop_early_and_agree():
    r = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, 60, r.integers(0, 60))).astype(np.uint64) for _ in range(2))
        for need in (0, 1, 5, 20, 40):
            assert shares(a, b, need, 4) == (len(np.intersect1d(a, b)) >= need)
