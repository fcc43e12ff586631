"""Fill-in-middle texts against a plain version that lists all units."""

import hashlib
import re

from pyspark.sql import functions as F

from kinetrace.llm import infill

from .conftest import documents


def brute(key, text, seed=1):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (key, len(units), "plain", None, None, text)
    if h4 % 100 < 20:
        return (key, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
    return (key, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


TEXTS = [None, "", " ", "one", "two words", "a <P> in it", "ends in <S>", "<M>", "<P<S<M", ">S>P>", "é😀 naïve\n\tline\r\n", "x1y22z", "Ünïcode ABC", "word " * 30_000, "<P", "P>", "." * 70_000]


def test_against_listed_units(spark):
    rows = [(i * 20 + j, t) for j, t in enumerate(TEXTS) for i in range(12)] + [(None, "no id at all"), (7, "twice"), (7, "twice")]
    got = infill.fill_in_middle(documents(spark, rows)).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert all(r.back == r.text for r in got)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == sorted((brute(*r) for r in rows), key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_parameters_and_empty(spark):
    rows = [(i, "some words to cut") for i in range(200)]
    count = lambda **k: {r.form: r["count"] for r in infill.fill_in_middle(documents(spark, rows), **k).groupBy("form").count().collect()}
    assert count(rate=0) == {"plain": 200} and count(rate=100, suffix_first=100) == {"spm": 200}
    assert infill.fill_in_middle(documents(spark, [])).count() == 0


def test_passes_hold_one_match():
    assert [infill.cut_positions("ab cd!", a, b) for a, b in ((0, 0), (0, 4), (1, 3), (2, 2), (4, 4))] == [(0, 0), (0, 6), (2, 5), (3, 3), (6, 6)]
    assert infill.count_units("ab cd!") == 4
