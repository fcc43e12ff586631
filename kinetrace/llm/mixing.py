"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall into blocks by hash, BLOCKS per source. A source with target T
and size S gives floor(T / S) whole copies of each block, and one copy of the
first blocks of a permuted order until the rest of T is reached; in the block
where it is reached documents are taken in hash order, the last one in part.
The block copies of a source are an exact quota. A binary tree over the output
shards splits these quotas: at each node the left half draws its share of all
block copies from the exact counts of the sources (multivariate hypergeometric),
the right half keeps the rest. Each leaf draws its quota as the next run of the
source's permuted block copies, so draws are disjoint; rows of a shard are then
ordered by a hash.

Sources are ranked, given targets and cut on Spark. For the draw they fall into at
most CHUNKS runs; the driver draws the runs' totals at each node of the tree, and each
run is split among its sources by itself, which is the same distribution. So the driver
holds a row per run, whatever the number of sources, and nothing per source or
document. Words are counted in two passes over the texts: one for the blocks, one for the result. All
hashes are of the rows' own values, so reruns and retried tasks agree.

Edge cases: a null text has size 0, a null source is a source (last in order),
equal rows share one fate (a remainder that meets m equal rows is spread evenly
over them, below m words short), sources of size 0 get target 0, an empty table
gives an empty result. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinetrace.llm.store import hot_keys, saved, spread_join

BLOCKS = 4096
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: A table of one row per source is broadcast up to this many sources, and joined by shuffle beyond.
BROADCAST_SOURCES = 10_000
#: Runs of sources for the draw, and sources in a run at least.
CHUNKS, CHUNK = 4096, 1024
#: numpy draws from fewer block copies than this.
MOST = 10**9
OUTPUTS = ("size", "source_size", "target", "taken", "takes")


def word_count(text: Column) -> Column:
    """Runs of characters other than space and 0x09 to 0x0D; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among draws; beyond numpy's limit by inversion over all values within 12 deviations of the mode, and 40."""
    if good + bad < MOST:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    mode = (draws + 1) * (good + 1) // (total + 2)
    far = 40 + int(12 * (draws * (good / total) * (bad / total) * ((total - draws) / (total - 1))) ** 0.5)
    least, most = max(0, draws - bad, mode - far), min(good, draws, mode + far)
    k = np.arange(least, most, dtype=float)
    log = np.r_[0.0, np.cumsum(np.log((good - k) / (k + 1) * ((draws - k) / (bad - draws + k + 1))))]
    upto = np.cumsum(np.exp(log - log.max()))
    return least + min(int(np.searchsorted(upto, rng.random() * upto[-1], "right")), most - least)


def _draw(rng: np.random.Generator, have: np.ndarray, take: int) -> np.ndarray:
    """Multivariate hypergeometric: halves of the sources draw their shares first while they are too many for numpy."""
    if int(have.sum()) < MOST:
        return rng.multivariate_hypergeometric(have, take, method="marginals")
    if len(have) == 1:
        return np.asarray([take], np.int64)
    mid = len(have) // 2
    left = _hypergeometric(rng, int(have[:mid].sum()), int(have[mid:].sum()), take)
    return np.concatenate([_draw(rng, have[:mid], left), _draw(rng, have[mid:], take - left)])


def split_tree(counts: np.ndarray, shards: int, seed: list[int], takes: dict[tuple[int, int], int] | None = None) -> tuple[np.ndarray, dict[tuple[int, int], np.ndarray]]:
    """Counts by shard (rows) and source (columns), and what each node's left half draws of each source.

    takes: how many each node's left half draws in all; by default its share of what is there.
    """

    def split(have: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        take = int(have.sum()) * (mid - lo) // (hi - lo) if takes is None else takes[lo, hi]
        left[lo, hi] = _draw(np.random.default_rng([*seed, lo, hi]), have, take)
        split(left[lo, hi], lo, mid)
        split(have - left[lo, hi], mid, hi)

    out, left = np.zeros((shards, len(counts)), np.int64), {}
    split(np.asarray(counts, np.int64), 0, shards)
    return out, left


def split_quotas(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Block copies of each source for each shard: rows are shards, columns sources; columns sum to counts."""
    return split_tree(counts, shards, [seed])[0]


def quotas(drawn: DataFrame, sources: int, shards: int, seed: int) -> DataFrame:
    """source_no and bounds (the block copies up to each shard but the last) from (source_no, drawn)."""
    size = max(CHUNK, -(-sources // CHUNKS))
    rows = drawn.withColumn("run", F.expr(f"source_no div {size}"))
    totals = sorted((r.run, r.n) for r in rows.groupBy("run").agg(F.sum("drawn").alias("n")).collect())  # CHUNKS rows at most
    _, left = split_tree(np.array([n for _, n in totals], np.int64), shards, [seed])
    nodes = sorted(left)
    table = drawn.sparkSession.createDataFrame([(int(run), [int(left[k][i]) for k in nodes]) for i, (run, _) in enumerate(totals)], "run long, takes array<long>")

    def draw(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("source_no")
        takes = {k: int(n) for k, n in zip(nodes, part["takes"].iloc[0], strict=True)}
        counts, _ = split_tree(part["drawn"].to_numpy(np.int64), shards, [seed, 1 + int(key[0])], takes)
        return pd.DataFrame({"source_no": part["source_no"], "bounds": list(np.cumsum(counts, axis=0)[:-1].T)})

    return rows.join(F.broadcast(table), "run").groupBy("run").applyInPandas(draw, "source_no long, bounds array<long>")


def ranked_sources(by_block: DataFrame, weights: tuple[float, ...], cap: float) -> tuple[DataFrame, int]:
    """source, source_no (by code point, null last), words and target of every source, and their number."""
    sizes = by_block.groupBy("source").agg(F.sum("words").alias("words"))
    dealt = sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    dealt = saved(dealt.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))), "sources")
    parts = sorted((r.part, r["count"]) for r in dealt.groupBy("part").count().collect())  # a row per range
    before = dict(zip([p for p, _ in parts], np.cumsum([0, *[n for _, n in parts]]).tolist(), strict=False))
    n = sum(k for _, k in parts)
    start = dealt.sparkSession.createDataFrame(list(before.items()), "part int, start long")
    listed = dealt.join(F.broadcast(start), "part").select("source", (F.col("start") + F.col("at") - 1).alias("source_no"), "words")
    shares = F.lit([float(w) for w in weights])
    listed = saved(listed.withColumn("weight", F.when(F.col("words") > 0, F.get(shares, (F.col("source_no") % len(weights)).cast("int"))).otherwise(0.0)), "sources")
    # sources whose cap lies below what a unit of weight gets stop at it; that level only grows
    level, total = -1.0, None
    while True:
        capped = cap * F.col("words") < level * F.col("weight")
        r = listed.agg(F.sum("words").alias("all"), F.sum(F.when(capped, cap * F.col("words"))).alias("held"), F.sum(F.when(~capped, F.col("weight"))).alias("free"), F.count_if(capped).alias("n")).first()
        if r.n == total or not r.free:
            break
        level, total = (r.all - (r.held or 0.0)) / r.free, r.n
    goal = F.when(F.col("words") == 0, 0.0).when(cap * F.col("words") < level * F.col("weight"), cap * F.col("words")).otherwise(level * F.col("weight"))
    return listed.select("source", "source_no", "words", goal.cast("double").alias("target")), n


def _place(source: Column, epoch: Column, block: Column, seed: int, blocks: int) -> Column:
    """Where a block stands in the permuted order of one copy of its source; blocks is a power of two."""
    step = F.pmod(F.xxhash64(F.lit(seed), F.lit("step"), source, epoch), F.lit(blocks // 2)) * 2 + 1
    start = F.pmod(F.xxhash64(F.lit(seed), F.lit("start"), source, epoch), F.lit(blocks))
    return F.pmod(step * block + start, F.lit(blocks)).cast("long")


def mix(docs: DataFrame, shards: int = 16, weights: tuple[float, ...] = WEIGHTS, cap: int = MAX_REPEATS, seed: int = 7, blocks: int = BLOCKS) -> DataFrame:
    """docs with size, source_size, target, taken and takes, an array of (copy, shard, words) that sum to taken."""
    docs = docs.drop(*OUTPUTS)
    keyed = docs.withColumn("__order", F.xxhash64(F.lit(seed), "doc_id", "text")).withColumn("__block", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("__order")), F.lit(blocks)))
    by_block = saved(keyed.select("source", "__block", word_count(F.col("text")).alias("size")).groupBy("source", "__block").agg(F.sum("size").alias("words")), "blocks")
    listed, sources = ranked_sources(by_block, weights, cap)
    small = F.broadcast if sources <= BROADCAST_SOURCES else lambda df: df
    words, whole = F.col("words"), F.floor(F.col("target") + 0.5).cast("long")
    copies = F.when(words > 0, F.least(F.floor(whole / words), F.lit(cap))).otherwise(0).cast("long")
    goals = listed.withColumn("copies", copies).withColumn("rest", F.greatest(F.least(whole, cap * words) - F.col("copies") * words, F.lit(0)).cast("long"))
    goals = saved(goals.withColumnRenamed("words", "source_size"), "goals")

    same_source = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    placed = by_block.alias("b").join(small(goals.alias("g")), same_source("b", "g")).select(
        "source_no", "g.source", "rest", "__block", "words", _place(F.col("source_no"), F.col("copies"), F.col("__block"), seed, blocks).alias("place")
    )
    run = F.sum("words").over(Window.partitionBy("source_no").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    edge = placed.withColumn("upto", run).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
    # one row per source: blocks after the edge start beyond the rest
    edge = saved(edge.select("source_no", "source", F.col("__block").alias("edge_block"), F.col("place").alias("edge_place"), (F.col("rest") - F.col("upto") + F.col("words")).alias("edge_rest")), "edges")

    # of the texts in the edge blocks, one in BLOCKS or so, words are counted again
    inside = keyed.select("source", "__block", "__order", "text").alias("d").join(small(edge.alias("e")), same_source("d", "e") & (F.col("__block") == F.col("edge_block")))
    inside = inside.select("source_no", "edge_rest", "__order", word_count(F.col("text")).alias("size")).groupBy("source_no", "edge_rest", "__order").agg(F.sum("size").alias("words"), F.count("*").alias("same"))
    upto = F.sum("words").over(Window.partitionBy("source_no").orderBy("__order").rowsBetween(Window.unboundedPreceding, 0))
    cut = inside.withColumn("upto", upto).where((F.col("upto") > F.col("edge_rest")) & (F.col("upto") - F.col("words") <= F.col("edge_rest")))
    cut = cut.select("source_no", F.col("__order").alias("cut"), ((F.col("edge_rest") - F.col("upto") + F.col("words")) / F.col("same")).cast("long").alias("part"))

    plan = saved(goals.join(edge.drop("source", "edge_block", "edge_rest"), "source_no", "left").join(cut, "source_no", "left"), "plan")
    drawn = plan.select("source_no", (F.col("copies") * blocks + F.coalesce(F.col("edge_place") + 1, F.lit(0))).alias("drawn"))
    table = saved(plan.join(quotas(drawn, sources, shards, seed), "source_no").withColumns({"edge_place": F.coalesce("edge_place", F.lit(0)), "part": F.coalesce("part", F.lit(0))}), "table")
    table = table.select(*[F.col(c).alias(f"__{c}") for c in table.columns])  # apart from any column of docs
    rows = keyed.withColumn("size", word_count(F.col("text")))

    def take(copy: Column) -> Column:
        place = _place(F.col("__source_no"), copy, F.col("__block"), seed, blocks)
        order = F.col("__order")
        in_edge = F.when(order < F.col("__cut"), F.col("size")).when(order == F.col("__cut"), F.col("__part")).otherwise(F.lit(0))
        last = F.when(place < F.col("__edge_place"), F.col("size")).when(place == F.col("__edge_place"), in_edge).otherwise(F.lit(0))
        words = F.when(copy < F.col("__copies"), F.col("size")).when(F.col("__cut").isNull(), F.lit(0)).otherwise(last)
        at = copy * blocks + place
        shard = F.size(F.filter(F.col("__bounds"), lambda b: b <= at))
        return F.struct(copy.cast("int").alias("copy"), shard.alias("shard"), words.cast("long").alias("words"))

    if sources <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("__source")))
    else:  # a source goes to as many tasks as its words ask for
        keyed = saved(table.withColumn("__key", F.xxhash64("__source")), "table")
        joined = spread_join(rows.withColumn("__key", F.xxhash64("source")), keyed, "__key", hot_keys(keyed, "__key", "__source_size")).where(F.col("source").eqNullSafe(F.col("__source")))
    takes = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("__copies")), take), lambda x: x["words"] > 0)
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return joined.withColumn("takes", takes).select(*[f"`{c}`" for c in docs.columns], "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken.alias("taken"), "takes")


def shard_rows(mixed: DataFrame, seed: int = 7) -> DataFrame:
    """One row per take, with copy, shard and words; each shard in one partition range, in shuffled order."""
    rows = mixed.select("*", F.explode("takes").alias("__t")).drop("takes")
    rows = rows.withColumns({"copy": F.col("__t.copy"), "shard": F.col("__t.shard"), "words": F.col("__t.words")}).drop("__t")
    rows = rows.withColumn("__key", F.xxhash64(F.lit(seed + 2), "doc_id", "copy"))
    return rows.repartitionByRange("shard", "__key").sortWithinPartitions("shard", "__key").drop("__key")
