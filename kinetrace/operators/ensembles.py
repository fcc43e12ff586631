"""Ensembles of tracks as tables of membership, and summaries over them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinetrace.sources.store import kept


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All members of both, repeats kept."""
    return a.unionByName(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of a, less one occurrence for each in b."""
    return a.exceptAll(b.select(a.columns))


def without(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Members of a that b does not name."""
    return a.join(b.select(on).distinct(), on, "left_anti")


def same_members(a: DataFrame, b: DataFrame, on: list[str]) -> bool:
    """Each names all that the other does."""
    return without(a, b, on).isEmpty() and without(b, a, on).isEmpty()


def ordered(members: DataFrame, *by: Column | str) -> DataFrame:
    """members with place from 0 in the given order, within their ensemble."""
    return members.withColumn("place", (F.row_number().over(Window.partitionBy("ensemble").orderBy(*by)) - 1).cast("long"))


def members_between(members: DataFrame, begin: int, end: int) -> DataFrame:
    return members.where((F.col("place") >= begin) & (F.col("place") < end))


def numeric_order(column: str = "animal") -> Column:
    """Names that are numbers, by number."""
    return F.col(column).cast("int").asc()


def largest(rows: DataFrame, keys: list[str], area: str, lo: float, hi: float, *tie: str) -> DataFrame:
    """Of each group the row of largest area in (lo, hi); ties by the given columns."""
    inside = rows.where((F.col(area) > lo) & (F.col(area) < hi))
    w = Window.partitionBy(*keys).orderBy(F.col(area).desc(), *tie)
    return inside.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def display_sample(rows: DataFrame, detail: int = 500, rest: int = 500) -> DataFrame:
    """The last detail frames of each track and about rest of the earlier ones, evenly spaced."""
    n = F.count("*").over(Window.partitionBy("track"))
    at = F.row_number().over(Window.partitionBy("track").orderBy("frame")) - 1
    marked = rows.withColumns({"__n": n, "__at": at})
    early = F.col("__n") - detail
    step = F.greatest(F.ceil(early / rest), F.lit(1))
    return marked.where((F.col("__at") >= early) | (F.col("__at") % step == 0)).drop("__n", "__at")


def draws(members: DataFrame, keys: list[str], samples: int, seed: int = 1) -> DataFrame:
    """keys, sample, old and new place, one exchange of a row per sample, from hashes of the numbers; members has keys and n."""
    sample = members.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    pick = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *keys, "sample"), F.col("n"))
    return sample.select(*keys, "sample", pick("old").alias("old"), pick("new").alias("new"))


def one_swap_band(values: DataFrame, swaps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mean, low and high (2.5 and 97.5 %) over samples that each exchange one row for another.

    values: keys, place from 0, value; swaps: keys, sample, old, new. A sample's mean
    follows from the sum, so nothing is resampled. Such bands are far narrower than those of a bootstrap.
    """
    stats = values.groupBy(*keys).agg(F.sum("value").alias("__s"), F.count("value").alias("__n"))
    old = values.select(*keys, F.col("place").alias("old"), F.col("value").alias("__old"))
    new = values.select(*keys, F.col("place").alias("new"), F.col("value").alias("__new"))
    means = swaps.join(stats, keys).join(old, [*keys, "old"]).join(new, [*keys, "new"]).withColumn("__m", (F.col("__s") - F.col("__old") + F.col("__new")) / F.col("__n"))
    return means.groupBy(*keys).agg(F.avg("__m").alias("mean"), F.percentile("__m", 0.025).alias("low"), F.percentile("__m", 0.975).alias("high"))


def bootstrap_band(values: DataFrame, keys: list[str], samples: int = 200, seed: int = 1) -> DataFrame:
    """keys, mean, low and high over samples with replacement.

    Each row counts a Poisson(1) number of times in each sample (drawn from a hash), so
    samples are sums over the rows where they lie, without a draw by position.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), *keys, "place", "sample"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    steps, p, total = [], 0.36787944117144233, 0.0
    for k in range(9):
        total += p
        steps.append(total)
        p /= k + 1
    times = sum((F.when(u > t, 1).otherwise(0) for t in steps[1:]), F.when(u > steps[0], 1).otherwise(0))
    drawn = values.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("__k", times)
    means = drawn.groupBy(*keys, "sample").agg((F.sum(F.col("value") * F.col("__k")) / F.nullif(F.sum("__k"), F.lit(0))).alias("__m"))
    return means.groupBy(*keys).agg(F.avg("__m").alias("mean"), F.percentile("__m", 0.025).alias("low"), F.percentile("__m", 0.975).alias("high"))


def bootstrap_of(values: DataFrame, picks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mean, low and high over stated samples with replacement; values: keys, place, value; picks: keys, sample, place, a row per draw."""
    means = picks.join(values, [*keys, "place"]).groupBy(*keys, "sample").agg(F.avg("value").alias("__m"))
    return means.groupBy(*keys).agg(F.avg("__m").alias("mean"), F.percentile("__m", 0.025).alias("low"), F.percentile("__m", 0.975).alias("high"))


def ensemble_average(tracks: DataFrame, curve: Callable[[pd.DataFrame], pd.Series], keys: list[str], samples: int = 200, seed: int = 1, swap: bool = True) -> DataFrame:
    """keys, place, mean, low and high: a user's curve of each track, averaged over the tracks of each of the keys with its band at every place.

    curve takes one track's rows by frame and gives numbers, indexed by place (a lag, say).
    It runs per track in pandas, once: its numbers are stored before they are ranked and summed. All else is grouped sums. swap: bands over samples that exchange one track; else a bootstrap.
    """
    names = [*keys, "track"]
    kinds = ", ".join(f"{k} {tracks.schema[k].dataType.simpleString()}" for k in names)

    def apply(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found = curve(part.sort_values("frame"))
        out = pd.DataFrame({"point": found.index.astype("float64"), "value": found.to_numpy(float)})
        for i, (k, v) in enumerate(zip(names, key, strict=True)):
            out.insert(i, k, v)
        return out

    points = tracks.groupBy(*names).applyInPandas(apply, f"{kinds}, point double, value double").where("value IS NOT NULL AND NOT isnan(value)")
    at = [*keys, "point"]
    placed = kept(points, "points").withColumn("place", (F.row_number().over(Window.partitionBy(*at).orderBy("track")) - 1).cast("long"))
    if not swap:
        return bootstrap_band(placed, at, samples, seed)
    sizes = placed.groupBy(*at).agg(F.count("*").alias("n"))
    return one_swap_band(placed, draws(sizes, at, samples, seed), at)


def subsample(rows: DataFrame, most: int, by: list[str], seed: int = 0) -> DataFrame:
    """At most so many rows, without replacement: those with the least hashes of the columns by."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *by), *by).limit(most)
