"""The Jaccard join against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kinetrace.llm import jaccard, queries, store

from .conftest import documents


def brute(rows, k, percent):
    """doc_id -> (set size, smallest linked id), by comparing every pair."""
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((d, {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()))
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                same = len(a & b)
                if 100 * same >= percent * (len(a) + len(b) - same):
                    parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(s), low[find(i)]) for i, (d, s) in enumerate(sets))


def check(df, k, percent):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.linked_documents(df, k, percent).collect())
    assert got == brute([(r.doc_id, r.text) for r in df.collect()], k, percent)
    return got


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_groups_of_near_copies(spark, k, percent):
    r = random.Random(k)
    vocabulary = ["w%d" % i for i in range(500)]
    line = " ".join(r.choice(vocabulary) for _ in range(25))
    texts = []
    for g in range(8):
        base = [r.choice(vocabulary) for _ in range(r.randint(30, 120))]
        for _ in range((2, 3, 40, 30)[g % 4]):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            texts.append(" ".join(t) + (" " + line if g % 2 else ""))
    chain = [r.choice(vocabulary) for _ in range(90)]
    for _ in range(12):  # each step links to the last only
        chain = chain[4:] + [r.choice(vocabulary) for _ in range(4)]
        texts.append(" ".join(chain))
    texts += [line + " " + " ".join(r.choice(vocabulary) for _ in range(12)) for _ in range(60)]
    texts += [None, "", "  \t", "a b", "A  B", "a", "a b c d", line, line.upper()]
    r.shuffle(texts)
    got = check(documents(spark, [(i, t) for i, t in enumerate(texts)]).withColumn("n", F.lit(1)), k, percent)
    assert len({c for _, _, c in got}) < len(got) - 25


def test_whole_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, queries.op8_jaccard_join(spark, "/root/testdata/sf0.001").collect())) == check(df, 4, 85)


def test_odd_tables(spark):
    long = "word%d " * 1
    text = " ".join(long % i for i in range(20_000))
    df = documents(spark, [(7, text), (3, text + " more"), (3, "other text of some five words"), (None, text), (9, None)])
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard.linked_documents(df).collect())
    assert got == [(-1, 19_996, 3), (3, 2, 3), (3, 19_997, 3), (7, 19_996, 3), (9, 0, 9)]
    assert jaccard.linked_documents(df.limit(0)).count() == 0
    kept = sorted(r.doc_id or -1 for r in jaccard.one_of_each(df).collect())
    assert kept == [-1, 3, 3, 9]


def test_components_of_long_chains(spark):
    rows = [(i, i + 1) for i in range(200)] + [(500, 900), (900, 700)]
    got = {r.node: r.component for r in jaccard.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[900] == got[700] == got[500] == 500


def test_linked_sets_with_different_matches(spark):
    """Frequent shingles only on one side, 18 rare ones on the other: 16 matches and 10."""
    base = " ".join("b%d" % i for i in range(105))
    near = base + " " + " ".join("n%d" % i for i in range(18))
    got = check(documents(spark, [(i, base) for i in range(1, 31)] + [(0, near)]), 4, 85)
    assert {c for _, _, c in got} == {0}


@pytest.mark.parametrize("percent", [60, 80, 85])
def test_least_prefix_holds_for_every_partner(percent):
    for n in range(1, 300):
        end, m = jaccard.least_prefix(n, percent)
        for other in range(jaccard.least_overlap(n, percent), n * 100 // percent + 1):
            for size in (n, other):
                spare = size - jaccard.least_overlap(size, percent)
                assert 1 <= m <= min(jaccard.matches(size, spare, share) for share in jaccard.MATCHES)
        assert end == n - jaccard.least_overlap(n, percent) + m


def test_hot_keys_are_joined_in_parts(spark, monkeypatch):
    """With nearly every key hot, results stay the same."""
    monkeypatch.setattr(store, "HOT_ROWS", 2)
    monkeypatch.setattr(jaccard, "LONG", 3)
    r = random.Random(3)
    line = " ".join("l%d" % i for i in range(30))
    base = ["w%d" % i for i in range(60)]
    texts = [" ".join(base[:i] + ["x%d" % r.randrange(5)] + base[i + 1 :]) for i in range(50)] + [line] * 40 + [line + " " + " ".join("v%d" % r.randrange(300) for _ in range(6)) for _ in range(40)] + [None, ""]
    check(documents(spark, list(enumerate(texts))), 4, 85)


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(store, "HOT_ROWS", 10)
    left = spark.createDataFrame([(1 if i < 300 else i, i) for i in range(400)] + [(None, 7)], "k long, v long")
    right = spark.createDataFrame([(k, k * 10) for k in range(0, 390)], "k long, w long")
    hot = store.hot_keys(left, "k")
    assert [(r.k, r[1]) for r in hot.collect()] == [(1, 30)] and store.hot_keys(right, "k") is None
    for how in ("inner", "left"):
        want, got = left.join(right, "k", how), store.spread_join(left, right, "k", hot, how)
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_sets_with_one_hash_are_told_apart(spark, monkeypatch):
    """All classes collide in their first hash: the second one parts them."""
    rows = spark.createDataFrame([(i, 4, 77, i // 2, None) for i in range(10)], "doc_id long, n long, cls long, other long, tokens binary")
    got = {r.doc_id: r.cls for r in jaccard._told_apart(rows).collect()}
    assert len(got) == 10 and len(set(got.values())) == 5 and all(got[2 * i] == got[2 * i + 1] for i in range(5))
    assert jaccard._told_apart(rows.where("doc_id < 2")).columns == ["doc_id", "n", "cls", "tokens"]
