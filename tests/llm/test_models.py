"""The trained operators: held-out accuracy, whole texts, odd rows."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kinetrace.llm import langid, pii, quality, queries

from .conftest import SMALL, documents

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    got = queries.op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 150 and sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)


def test_language_odd_rows(spark):
    rows = [(1, "the cat and the dog " * 40, "en"), (2, "der hund und die katze " * 40, "de"), (3, None, "en"), (4, "123 !!", "en"), (5, "é", "fr"), (6, "🙂 — 5", None), (7, "x" * 200_000, None), (None, "the dog", None)]
    df = documents(spark, rows).withColumn("score", F.lit("old"))
    model = langid.fit(df.where("doc_id < 3"))
    got = {r.doc_id: r for r in langid.identify(df, model, ["doc_id"]).collect()}
    assert (got[1].lang_pred, got[2].lang_pred, got[None].lang_pred) == ("en", "de", "en")
    assert [got[k].lang_pred for k in (3, 4, 6)] == ["und"] * 3 and got[5].lang_pred in ("en", "de")
    assert langid.fit(df.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(df, None, ["doc_id"]).collect()} == {"und"}
    assert langid.identify(df.limit(0), model, ["doc_id"]).count() == 0


def test_rare_languages_are_learnt(spark):
    """However few of all rows a language has, up to fit_each of them are learnt from."""
    rows = [(i, f"the cat and the dog number {i} ran home", "en") for i in range(3000)] + [(5000 + i, "der hund und die katze laufen nach hause", "de") for i in range(3)]
    model = langid.fit(documents(spark, rows), fit_rows=100, fit_each=10)
    assert model.langs == ["en", "de"] and model.rows[1] == 3 and 50 < model.rows[0] < 200
    got = {r.doc_id: r.lang_pred for r in langid.identify(documents(spark, [(1, "der hund und die katze", None), (2, "the dog and the cat", None)]), model, ["doc_id"]).collect()}
    assert got == {1: "de", 2: "en"}


def test_bloom_masks_have_every_language_of_an_ngram():
    grams = np.arange(500, dtype=np.uint32)
    slots = np.concatenate(langid._slots(grams))
    masks = np.tile(np.where(grams % 2 == 0, 3, 2).astype(np.uint64), langid.K)[:, None]
    model = langid.LanguageFilter(["a", "b"], [1, 1], slots, masks)
    found = model.words[0][langid._slots(grams)[0]]
    for s in langid._slots(grams)[1:]:
        found = found & model.words[0][s]
    assert ((found & 2) == 2).all() and ((found[::2] & 1) == 1).all()


RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(re.sub("[^0-9]", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def brute_base(text):
    out = [(m.start(), k, m.end(), name) for k, (name, (p, ok)) in enumerate(RULES.items()) for m in re.finditer(p, text or "") if ok(m[0])]
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(out))


ODD = [None, "", "a@b", "é😀 x.y@a-b.co.uk, q@w.e@r.t", "1.2.3.4.5.6.7.8 300.1.1.1 010.0.0.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567. +49 5 x +123", "9" * 3000 + ".1.1.1", "@" * 50 + "a" * 500 + "@b.c", "word " * 30_000 + "+44 20 7946 0958"]


def test_personal_data_rules_match_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op3_personal_data(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) <= set(r.spans.split(",")) and r.n_email == want.count("email")


def test_personal_data_odd_rows(spark):
    df = documents(spark, [(i, t) for i, t in enumerate(ODD)] + [(None, ODD[3])]).withColumn("spans", F.lit("old"))
    found = pii.find_personal_data(df).collect()
    for r in found:
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.base_spans) == brute_base(r.text)
        assert all(s in r.spans for s in r.base_spans)
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_tagger_gradients_and_exact_decoding():
    classes, tags = pii._columns(pii.labelled_windows(12, 24, 9), 24)
    tagger = pii.Tagger(seed=2, hidden=3)
    _, g = tagger.step(classes, tags)
    r = np.random.default_rng(0)
    for k, v in tagger.p.items():
        for _ in range(4):
            at = tuple(r.integers(0, s) for s in v.shape)
            keep = v[at]
            v[at] = keep + 1e-5
            up = tagger.step(classes, tags)[0]
            v[at] = keep - 1e-5
            down = tagger.step(classes, tags)[0]
            v[at] = keep
            assert abs((up - down) / 2e-5 - g[k][at]) < 1e-4 + 0.02 * abs(g[k][at])


def best_path(em, move):
    """Viterbi of one text as a plain recursion, tag 0 before and after; the best score."""
    score = em[0] + move[0]
    for e in em[1:]:
        score = (score[:, None] + move).max(axis=0) + e
    return (score + move[:, 0]).max()


def test_paths_are_best_over_whole_texts():
    """Islands and stretches that are passed over give a path with the score of the best one."""
    r = np.random.default_rng(4)
    tagger = pii.Tagger(seed=2, hidden=3)
    tagger.p["t"] = r.normal(0, 1, (5, 5)) + np.eye(5) * 2
    ems = []
    for k in range(60):
        n = int(r.integers(1, 400))
        em = r.normal(0, 2, (n, 5)).astype(np.float32)
        em[:, 0] += 8 * (np.sin(np.arange(n) / r.integers(5, 60)) > r.uniform(-1, 1)) + (k % 3)
        ems.append(em)
    ems.append(np.full((300, 5), -1e3, np.float32))
    ems[-1][:, 0] = 0
    move = tagger.p["t"].astype(np.float32)
    for em, path in zip(ems, tagger.paths(ems), strict=True):
        ends = np.r_[0, path, 0]
        score = em[np.arange(len(em)), path].sum() + move[ends[:-1], ends[1:]].sum()
        assert abs(score - best_path(em, move)) < 1e-2 + 1e-5 * abs(score)


def test_recall_of_every_writing():
    """Spans found exactly, in prose of the sample table, by way of writing."""
    tagger, r = pii.trained(), np.random.default_rng(1234)
    prose = [t for t in pq.read_table(f"{SMALL}/documents.parquet")["text"].to_pylist() if t and 200 < len(t) < 5000][:60]
    for name, (kind, make) in pii.writings(r).items():
        texts, want = [], []
        for _ in range(80):
            words, shown = prose[r.integers(len(prose))].split(" "), make()
            before = " ".join(words[: len(words) // 2])[-300:]
            texts.append(f"{before} {shown} {' '.join(words[len(words) // 2 :])[:300]}")
            want.append((len(before) + 1, kind, len(before) + 1 + len(shown)))
        found = [all_ for _, all_ in pii._spans(tagger, texts)]
        assert np.mean([w in f for w, f in zip(want, found, strict=True)]) >= 0.9, name
    added = sum(len(all_) - len(base) for base, all_ in pii._spans(tagger, prose))
    assert added <= 2


def test_every_valid_span_passes_the_gate():
    """What makes a window be read stands in the span itself; digits elsewhere in the text change nothing."""
    r = np.random.default_rng(12)
    lines = ["", "in 2024 there were 17 of them and 3 more. ", "plain words stand around it, nothing else does. " * 12]
    tagger, changed, seen = pii.trained(), 0, 0
    for name, (kind, make) in pii.writings(r).items():
        for _ in range(12):
            shown = make()
            alone = f"please write to {shown} for the details of the plan."
            assert pii._TRIGGER.search(f"words {shown} words"), (name, shown)
            found = []
            for line in lines:
                (spans,) = [s for _, s in pii._spans(tagger, [alone + " " + line])]
                found.append([(a, k, b) for a, k, b in spans if a < len(alone)])
            seen += 1
            changed += any(f != found[0] for f in found[1:])
    assert changed <= seen // 25  # the model reads what is near; the gate never hides a span


def test_spelt_addresses_and_what_is_none():
    tagger = pii.trained()
    spans = lambda t: [(t[a:b], pii.KINDS[k]) for a, k, b in next(pii._spans(tagger, [t]))[1]]
    for text in ("write to john.smith at example.com for the details of the plan.", "write to john.smith at example.com for the details of the plan in 2024."):
        assert spans(text) == [("john.smith at example.com", "email")]
    for text in ("it is at example.com now", "look at news.site.org today", "see version 2 . 4 . 1 . 0 of it", "rows 12 34 56 78 90 12 of the table"):
        assert spans(text) == [], text


def test_many_matches_take_linear_time():
    def seconds(n):
        text = "mail ab@cd.ef or 0123 456789 " * n
        tags = pii.tag_texts(pii.trained(), [text])[0]
        matches = pii.rule_matches(text)
        began = time.perf_counter()
        pii.model_spans(tags, text, matches)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(8000) < 16 * seconds(1000) + 0.2


def test_windows_cover_long_texts():
    text = "lorem ipsum dolor " * 40 + "reach me: (555) 123-4567 " + "amet elit " * 60
    tags = pii.tag_texts(pii.trained(), [text, ""])
    spans = pii.model_spans(tags[0], text, pii.rule_matches(text))
    assert [text[a:b] for a, k, b in spans if k == 3] == ["(555) 123-4567"] and len(tags[1]) == 0


def test_quality_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = quality.assess(docs, labels.where(~part)).select("doc_id", "keep", "p_bad").join(labels.where(part), "doc_id").collect()
    bad, good = [r for r in got if r.quality == 0], [r for r in got if r.quality == 1 and r.toxic == 0]
    assert sum(not r.keep for r in bad) >= 0.85 * len(bad) and sum(r.keep for r in good) >= 0.97 * len(good)


def test_quality_toxic_words(spark):
    r = np.random.default_rng(1)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(r.choice(words, 60)) + (" vile scum" if i % 5 == 0 else ""), "en", f"host{i % 3}/a/x") for i in range(600)]
    docs = documents(spark, [*rows, (900, None, None, None), (901, "", "en", "host0/a/x"), (902, "scum " * 20_000, "en", "hostz")])
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)] + [(5, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.assess(docs.withColumns({c: F.lit(1) for c in ("keep", "host", "path", "site_rate", "base_rate")}), labels).collect()}
    assert all(got[i].keep == (i % 5 != 0) for i in range(300, 600)) and len(got) == 603
    assert all(r.keep for r in quality.assess(docs, labels.limit(0)).collect())
    assert quality.assess(docs.limit(0), labels).count() == 0


def brute_quality(rows):
    """(site_rate, quality) of each (host, path, p_bad, p_toxic) by plain sums, each row's own share left out."""
    good = [(1 - b) * (1 - t) for _, _, b, t in rows]
    paths, hosts = defaultdict(lambda: [0.0, 0]), defaultdict(lambda: [0.0, 0])
    for g, (h, p, _, _) in zip(good, rows, strict=True):
        for table, key in ((paths, (h, p)), (hosts, h)):
            table[key][0] += g
            table[key][1] += 1
    total, n = sum(good), len(rows)

    def strength(members):  # (sum, number, parent's mean)
        ss = sum(k * (s / k - m) ** 2 for s, k, m in members)
        chance, base = sum(m * (1 - m) for _, _, m in members), sum(k * m * (1 - m) for _, k, m in members)
        return float(np.clip(base / n / max((ss - chance) / n, 1e-6), 2, 10_000))

    k_host = strength([(s, k, total / n) for s, k in hosts.values()])
    k_path = strength([(s, k, (hosts[h][0] + k_host * total / n) / (hosts[h][1] + k_host)) for (h, _), (s, k) in paths.items()])
    logit = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    for g, (h, p, _, _) in zip(good, rows, strict=True):
        base = (total - g) / (n - 1)
        host = (hosts[h][0] - g + k_host * base) / (hosts[h][1] - 1 + k_host)
        site = (paths[h, p][0] - g + k_path * host) / (paths[h, p][1] - 1 + k_path)
        yield site, 1 / (1 + math.exp(-(logit(g) + quality.SITE_WEIGHT * (logit(site) - logit(base)))))


@pytest.mark.parametrize("sites", [20_000, 3])
def test_posteriors_match_brute_force(spark, monkeypatch, sites):
    """Both joins, null hosts and paths, a site of one row."""
    monkeypatch.setattr(quality, "BROADCAST_SITES", sites)
    r = np.random.default_rng(6)
    rows = [(i, None, str(r.choice(["en", "de"])), [None, "a/x/1", "a/y/2", "b/x/3", "c"][min(int(r.integers(0, 9)), 4)], 0) for i in range(300)] + [(300, None, None, "lone/z/1", 0)]
    marks = {i: (float(r.beta(1, 4)), float(r.beta(1, 9))) for i, *_ in rows}
    chances = spark.createDataFrame([(i, *m) for i, m in marks.items()], "doc_id long, p_bad double, p_toxic double")
    monkeypatch.setattr(quality, "evidence", lambda docs, model: docs.join(chances, "doc_id"))
    got = {x.doc_id: x for x in quality.assess(documents(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"), quality.Classifier(np.zeros((4, 2)), np.zeros((16, 2)), np.zeros(2)), ["doc_id", "source"]).collect()}
    assert len(got) == 301
    split = lambda s, lang: (None, lang) if s is None else (s.split("/")[0], s.split("/")[1] if s.count("/") > 1 else lang)
    want = brute_quality([(*split(s, lang), *marks[i]) for i, _, lang, s, _ in rows])
    for (i, *_), (site, q) in zip(rows, want, strict=True):
        assert abs(got[i].site_rate - site) < 1e-9 and abs(got[i].quality - q) < 1e-9 and got[i].keep == (q >= 0.5 and marks[i][1] < 0.5)


def test_sparse_sites_shrink(spark):
    rows = [("a", "x", 0.1, 0.0)] * 500 + [("a", "y", 0.9, 0.0)] * 2 + [("b", "x", 0.9, 0.0)] * 500 + [(None, None, 0.5, 0.0)]
    table, known = quality.site_table(spark.createDataFrame(rows, "host string, path string, p_bad double, p_toxic double"))
    site, _ = quality.rates(known, {c: F.col(c) for c in ("good", "n", "h_good", "h_n")}, F.lit(0.0), 0)
    got = {(r.host, r.path): r.rate for r in table.withColumn("rate", site).collect()}
    assert got["a", "x"] > 0.85 and got["b", "x"] < 0.15 and got["a", "y"] > got["b", "x"] + 0.2 and len(got) == 4


def test_sample_of_labels_stays_bounded(spark):
    """Repeated rows of one labelled id, several labels of one id, more labels than are fitted."""
    rows = [(i, f"good words {i} " * 5 if i % 2 else f"bad stuff {i} " * 5, "en", "s", 0) for i in range(200)] + [(1, "x y z", "en", "s", 0)] * 300
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(1, 1, 0)] * 50, "doc_id long, quality int, toxic int")
    model = quality.fit(documents(spark, rows), labels, 80)
    got = quality.evidence(documents(spark, [(900, "good words 7 good", "en", "s", 0), (901, "bad stuff 7", "en", "s", 0)]), model).orderBy("doc_id").collect()
    assert got[0].p_bad < 0.5 < got[1].p_bad


def brute_language(rows, model):
    """The best language and its score by sets of n-grams that the filter holds, corrected by the filter's own fill."""
    for text in rows:
        data = text.encode()
        folded = " " + "".join(chr(c).lower() if chr(c).isascii() and chr(c).isalpha() else chr(c) if c >= 128 else " " for c in data) + " "
        grams = [g for g in (folded[i : i + langid.N] for i in range(len(folded) - langid.N + 1)) if "  " not in g]
        if not grams:
            yield model.langs[0], 0.0
            continue
        counts = []
        for k in range(len(model.langs)):
            fill = float(((model.words[k // 64] >> model.words.dtype.type(k % 64)) & model.words.dtype.type(1)).mean())
            found = 0
            for g in grams:
                value = np.array([sum(ord(c) << (8 * i) for i, c in enumerate(g))], np.uint32)
                found += all(int(model.words[k // 64][int(s[0])]) >> (k % 64) & 1 for s in langid._slots(value))
            chance = fill**langid.K
            counts.append(min(max((found / len(grams) - chance) / (1 - chance), 0), 1))
        best = max(range(len(counts)), key=lambda k: (counts[k], -k))
        yield model.langs[best], counts[best]


def brute_held(rows):
    """N-grams that each language holds, by plain counting."""
    counts = defaultdict(Counter)
    for text, lang in rows:
        folded = " " + "".join(chr(c).lower() if chr(c).isascii() and chr(c).isalpha() else chr(c) if c >= 128 else " " for c in text.encode()) + " "
        counts[lang].update(g for g in (folded[i : i + langid.N] for i in range(len(folded) - langid.N + 1)) if "  " not in g)
    share = {lang: {g: n / c.total() for g, n in c.items()} for lang, c in counts.items()}
    top = defaultdict(float)
    for c in share.values():
        for g, p in c.items():
            top[g] = max(top[g], p)
    return {lang: {g for g, p in share[lang].items() if p >= langid.SHARE * top[g] and counts[lang][g] >= langid.MIN_COUNT} for lang in counts}


def test_language_matches_brute_force(spark):
    """The filter holds what plain counting says, and predictions follow from it as they should."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    learn = docs.where(~langid.held_out(F.col("doc_id")))
    model = langid.fit(learn.select("doc_id", "text", "lang"))
    rows = [(r.text, r.lang) for r in learn.collect() if r.text is not None and r.lang is not None]
    held = brute_held(rows)
    assert sorted(model.langs) == sorted(held) and model.rows == [sum(x == lang for _, x in rows) for lang in model.langs]
    value = lambda g: np.array([sum(ord(c) << (8 * i) for i, c in enumerate(g))], np.uint32)
    for k, lang in enumerate(model.langs):
        slots = np.unique(np.concatenate([np.concatenate(langid._slots(value(g))) for g in held[lang]]))
        bits = np.flatnonzero((model.words[0] >> model.words.dtype.type(k)) & model.words.dtype.type(1))
        assert np.array_equal(slots, bits)
    texts = {r.doc_id: r.text for r in docs.collect() if r.text and any(c.isalpha() for c in r.text) and len(r.text) < 4000}
    got = {r.doc_id: r for r in queries.op2_language_id(spark, SMALL).collect()}
    for i, (lang, score) in zip(texts, brute_language(texts.values(), model), strict=True):
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-9


def test_more_than_64_languages(spark):
    r = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = {k: ["".join(r.choice(letters) for _ in range(7)) for _ in range(12)] for k in range(70)}
    rows = [(1000 * j + k, " ".join(r.choices(words, k=60)), f"l{k:02}") for k, words in vocabulary.items() for j in range(3)]
    model = langid.fit(documents(spark, [(*x, "s", 0) for x in rows]))
    assert len(model.langs) == 70 and model.words.shape[0] == 2
    tests = [(k, " ".join(r.choices(words, k=30))) for k, words in vocabulary.items()]
    got = {x.doc_id: x.lang_pred for x in langid.identify(documents(spark, tests), model, ["doc_id"]).collect()}
    assert all(got[k] == f"l{k:02}" for k in range(70))


def test_word_hashes_agree_with_split():
    from kinetrace.llm.words import slices, word_hashes

    texts = ["Ab c\tab", "", None, "é É", " x ", "c" * 100]
    (lo, hi, data, offsets), *rest = list(slices(pa.array(texts)))
    h, starts, ends, first = word_hashes(data, offsets)
    assert (lo, hi, rest) == (0, 6, []) and np.diff(first).tolist() == [3, 0, 0, 2, 1, 1]
    assert h[0] == h[2] and h[3] != h[4] and len(set(h.tolist())) == 6
