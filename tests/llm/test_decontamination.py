"""Spaced seeds against a brute-force scan of all documents and items."""

import itertools
import math
import random
import re

from pyspark.sql import functions as F

from kinetrace.llm import decontamination as dc

from .conftest import SMALL, documents


def words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def brute(docs, items):
    found = set()
    for d, text in docs:
        w = words(text)
        for i, item in items:
            t = words(item)
            n = min(dc.WINDOW, len(t))
            if len(t) < dc.MIN_WORDS:
                continue
            need = n if len(t) < dc.SPAN else dc.SHARE * n
            for shift in range(-len(t) + n, len(w) - n + 1):
                same = [0 <= k + shift < len(w) and w[k + shift] == t[k] for k in range(len(t))]
                if any(sum(same[a : a + n]) >= need - 1e-9 and 0 <= a + shift and a + n + shift <= len(w) for a in range(len(t) - n + 1)):
                    found.add((d, i))
                    break
    return found


def planted():
    r = random.Random(4)
    vocabulary = ["w%d" % i for i in range(3000)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(n))) for k, n in enumerate([40, 25, 15, 11, 7, 4, 60, 0])]
    docs = []
    for k, item in items:
        t = item.split()
        edited = [x if j % 9 else "edit" for j, x in enumerate(t)]
        docs += [(10 * k, " ".join(say(30) + t + say(30))), (10 * k + 1, ". ".join(say(5) + edited + say(90)).upper()), (10 * k + 2, " ".join(say(50) + t[: len(t) // 3] + say(50)))]
    return docs, items


def test_overlaps_match_brute_force(spark):
    docs, items = planted()
    docs += [(500, None), (501, ""), (502, "a b")]
    bench = spark.createDataFrame(items + [(99, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.overlaps(documents(spark, docs), bench).collect()}
    assert got == brute(docs, items)
    assert {(0, 0), (1, 0), (10, 1), (20, 2), (30, 3), (40, 4), (60, 6)} <= got


def test_whole_small_tables_match_brute_force(spark):
    docs, bench = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in dc.overlaps(docs, bench).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])


def test_clean_keeps_the_rest(spark):
    docs, items = planted()
    df = documents(spark, docs + [(None, None), (0, "another text"), (3, docs[0][1])])
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in dc.clean(df, bench).collect())
    bad = {d for d, _ in brute(docs, items)}
    want = [(False, d, t) for d, t in docs if d not in bad] + [(True, 0, ""), (False, 0, "another text")]
    assert kept == sorted(want)
    assert dc.clean(df, bench).columns == df.columns
    assert dc.clean(df, bench.limit(0)).count() == df.count()
    assert dc.overlaps(df.limit(0), bench).count() == 0


def test_masks_hit_every_allowed_substitution():
    for n in range(dc.SPAN, dc.WINDOW + 1):
        for wrong in itertools.combinations(range(n), n - math.ceil(dc.SHARE * n - 1e-9)):
            assert any(not any(start + at in wrong for at in mask) for mask in dc.MASKS for start in range(n - max(mask)))


def test_odd_texts_and_names(spark):
    """Very long texts, columns named like those inside, repeated rows."""
    docs, items = planted()
    long = " ".join("z%d" % i for i in range(60_000)) + " " + items[0][1]
    rows = [(1, long), (1, long), (2, "nothing here"), (None, items[1][1])]
    df = documents(spark, rows).withColumns({c: F.lit("old") for c in ("row", "segment", "words", "hash", "item", "__bad_")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    assert sorted((r.doc_id or -1, r.item_id) for r in dc.overlaps(df, bench).collect()) == [(-1, 1), (1, 0)]
    kept = dc.clean(df, bench).collect()
    assert [(r.doc_id, r.row) for r in kept] == [(2, "old")] and dc.clean(df, bench).columns == df.columns


def test_the_bitmap_follows_the_benchmark_and_large_removals_are_joined(spark, monkeypatch):
    """Sizes of the bitmap and both ways of removing rows give the same rows."""
    rows = [(i, f"some text {i} about things " + ("the item of the benchmark has these twelve words in it for you " if i % 3 == 0 else "nothing of the kind") ) for i in range(60)]
    bench = spark.createDataFrame([(1, "The item of the benchmark has these twelve words in it for you")], "item_id long, text string")
    kept = lambda: sorted(r.doc_id for r in dc.clean(documents(spark, rows), bench).collect())
    want = [i for i in range(60) if i % 3]
    assert kept() == want
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(dc, "LEAST_BITS", 10)
    assert kept() == want
