"""Importance resampling against a plain version, and the draw against its distribution."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from kinetrace.llm import queries, resampling

from .conftest import SMALL, documents

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, order=2):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    return len(words), [" ".join(words[i : i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, percent=25, least=20, order=2):
    bucket = lambda g: zlib.crc32(g.encode()) % 10_000
    made = [(d, *features(t, order)) for d, t in docs]
    s, t = Counter(bucket(g) for _, _, f in made for g in f), Counter(bucket(g) for x in target for g in features(x, order)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    rows = []
    for d, n, f in made:
        weight = sum(gain(bucket(g)) for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    ranked = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = [(*r[:4], i + 1) for i, r in enumerate(ranked[: percent * len(ranked) // 100])]
    return drawn + [(*r[:4], None) for r in ranked[percent * len(ranked) // 100 :]] + [(*r[:4], None) for r in rows if r[4] < least]


def same(got, want):
    assert sorted(map(repr, ((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got))) == sorted(map(repr, want))


def test_whole_small_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    same(queries.op13_importance_resampling(spark, SMALL).collect(), brute(docs, target))


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE_BYTES", 300)  # many slices, and texts longer than one
    docs = [(1, None), (2, ""), (3, " .,;"), (4, "One"), (5, "É été ÀÉ 数据 x1 É " * 9), (None, "plain words " * 20), (7, "A B c d " * 3000), (7, "A B c d " * 3000), (8, "a b\x7fc{d}e " * 30), (9, "plain words " * 20)]
    docs += [(i, f"common text with number {i} and more words to reach the least of twenty words in all of it so it can be drawn") for i in range(20, 60)]
    target = ["plain words in a benchmark", None, ""]
    frame = lambda rows: spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "item_id long, text string")
    for percent, order in ((25, 2), (100, 3), (0, 1)):
        same(resampling.resample(documents(spark, docs), frame(target), percent=percent, order=order).collect(), brute(docs, target, percent, order=order))
    same(resampling.resample(documents(spark, docs), frame([])).collect(), brute(docs, []))
    assert resampling.resample(documents(spark, []), frame(target)).count() == 0


def test_draw_follows_the_weights(spark):
    """Of two kinds of documents the one like the target is drawn as often as its weight says."""
    rng = np.random.default_rng(3)
    make = lambda words: " ".join(rng.choice(words, 30))
    docs = [(i, make(["red", "green", "blue", "grey"] if i % 2 else ["red", "green", "salt", "pepper"])) for i in range(2000)]
    target = spark.createDataFrame([(0, make(["red", "green", "salt", "pepper"]))], "item_id long, text string")
    got = resampling.resample(documents(spark, docs), target).collect()
    weight = {k: np.mean([math.exp(r.weight / 1000) for r in got if r.doc_id % 2 == k]) for k in (0, 1)}
    drawn = [r.doc_id % 2 for r in got if r["rank"]]
    share = weight[0] / (weight[0] + weight[1])
    assert len(drawn) == 500 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 501))
    assert share > 0.55 and 0.5 < drawn.count(0) / 500 <= share + 0.05
