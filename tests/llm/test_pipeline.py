"""Each stage of the pipeline on its own input, against brute force."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from kinetrace.llm import pii
from kinetrace.llm.store import saved

from .conftest import SMALL
from .test_decontamination import brute as brute_overlaps
from .test_jaccard import brute as brute_groups
from .test_models import RULES
from .test_native import check_mix


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(saved(stage(spark, steps[-1], SMALL), name))
        assert name == "mixing" or steps[-1].columns == docs.columns
    start, good, single, clean, masked, mixed = ({r.doc_id: r for r in s.collect()} for s in steps)
    kept = [r for d, r in labels.items() if d in good]
    assert len(kept) > 0.6 * len(labels) and sum(r.quality == 0 for r in kept) <= 0.2 * sum(r.quality == 0 for r in labels.values())
    assert all(good[d] == start[d] for d in good)
    groups = brute_groups([(d, r.text) for d, r in good.items()], 5, 80)
    assert set(single) == {c for _, _, c in groups} and all(single[d] == good[d] for d in single)
    leaks = {d for d, _ in brute_overlaps([(d, r.text) for d, r in single.items()], bench)}
    assert set(clean) == set(single) - leaks and all(clean[d] == single[d] for d in clean)
    assert set(masked) == set(clean) == set(mixed)
    for d, r in masked.items():
        assert r.n_chars == len(r.text)
        found = [m for p, ok in RULES.values() for m in re.finditer(p, clean[d].text) if ok(m[0])]
        assert all(m[0] not in r.text for m in found) and (found or r.text == clean[d].text)
    check_mix(mixed.values())


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "text", "taken", "target"} <= set(rows.columns) and rows.count() > 50


def test_masks_merge_overlaps():
    text = "mail a@b.co, ring +1 555 123 4567 890 1234 now"
    spans = sorted(x[:3] for x in [(5, 0, 11), (18, 3, 34), (18, 2, 42)])
    assert pii.masked(text, spans) == "mail <EMAIL>, ring <CARD> now"


def test_stages_take_odd_rows(spark):
    """Null, empty and repeated rows, an extra column with a clashing name, and an empty table go through every stage."""
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, None, "en", None, 3), (9002, "", None, "s", 0), (9003, "a b", "en", "s/x/1", 3), (9003, "a b", "en", "s/x/1", 3)], table.schema)
    for docs in (table.limit(30).unionByName(odd), table.limit(0)):
        step = docs.withColumn("words", F.lit("kept")).withColumn("tokens", F.lit(1))
        for name, stage in corpus_pipeline.STAGES:
            columns = step.columns
            step = saved(stage(spark, step, SMALL), name)
            assert name == "mixing" or step.columns == columns
            assert step.where("words != 'kept' OR tokens != 1").count() == 0
        assert step.count() <= docs.count()
