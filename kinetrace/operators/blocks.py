"""Order-dependent steps on very long tracks, in blocks of frames.

A window over a whole track is one task. Here a track is cut into blocks of SIZE frames
and the window's unit is a block. What looks a bounded number of frames away
gets copies of the rows next to its block (margins). Running totals and carried
values go in two levels: within the block, over one row per block, and back by a
join on (track, block), by which the rows are already dealt. Results equal those of the windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from kinetrace.functions.scalar import mean_point_distance

SIZE = 100_000
BLOCK = ("track", "__block")


def by_block() -> WindowSpec:
    return Window.partitionBy(*BLOCK).orderBy("frame")


def blocked(rows: DataFrame, size: int = SIZE) -> DataFrame:
    return rows.withColumn("__block", F.floor(F.col("frame") / size))


def with_margins(rows: DataFrame, before: int, after: int, size: int = SIZE) -> DataFrame:
    """rows with __block and __own: each row in its own block, and once more where it lies at most before frames ahead of the next blocks or after frames behind earlier ones."""
    own = F.floor(F.col("frame") / size)
    blocks = F.sequence(F.greatest(F.floor((F.col("frame") - after) / size), F.lit(0)), F.floor((F.col("frame") + before) / size))
    return rows.withColumn("__block", F.explode(blocks)).withColumn("__own", F.col("__block") == own)


def _before_block(rows: DataFrame, of_block: Column, over: Column) -> DataFrame:
    """track, __block and __before, from one row per block: over is an expression on __value, taken over the blocks before."""
    one = rows.groupBy(*BLOCK).agg(of_block.alias("__value"))
    earlier = Window.partitionBy("track").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    return one.select(*BLOCK, over.over(earlier).alias("__before"))


def running_total(rows: DataFrame, column: str, out: str, size: int = SIZE) -> DataFrame:
    """rows with out, the sum of column (NULL counts 0) over all frames of the track up to here."""
    dealt = blocked(rows, size).withColumn("__part", F.coalesce(column, F.lit(0)))
    before = _before_block(dealt, F.sum("__part"), F.sum("__value"))
    inside = dealt.withColumn("__sum", F.sum("__part").over(by_block().rowsBetween(Window.unboundedPreceding, 0)))
    return inside.join(before, [*BLOCK]).withColumn(out, F.col("__sum") + F.coalesce("__before", F.lit(0))).drop("__block", "__part", "__sum", "__before")


def carried(rows: DataFrame, columns: dict[str, str], size: int = SIZE) -> DataFrame:
    """rows with, for each name: column of columns, its last known value at an earlier frame of the track."""
    dealt = blocked(rows, size)
    kept = F.struct(*[F.max_by(F.struct(F.col(c).alias("v")), F.when(F.col(c).isNotNull(), F.col("frame"))).alias(name) for name, c in columns.items()])
    one = dealt.groupBy(*BLOCK).agg(kept.alias("__value"))
    earlier = Window.partitionBy("track").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = one.select(*BLOCK, *[F.last(F.col("__value")[name], True).over(earlier).alias(f"__before_{name}") for name in columns])
    w = by_block().rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumns({f"__last_{name}": F.last(c, ignorenulls=True).over(w) for name, c in columns.items()}).join(before, [*BLOCK])
    known = {name: F.coalesce(f"__last_{name}", F.col(f"__before_{name}")["v"]) for name in columns}
    return inside.withColumns(known).drop("__block", *[f"__{x}_{name}" for name in columns for x in ("last", "before")])


def unwrap(rows: DataFrame, angle: str, out: str = "unwrapped", size: int = SIZE) -> DataFrame:
    """As kinematics.unwrap()."""
    step = F.col(angle) - F.col("__angle")
    turns = F.when(F.abs(step) > math.pi, -F.floor((step + math.pi) / (2 * math.pi))).otherwise(0)
    marked = carried(rows, {"__angle": angle}, size).withColumn("__turns", F.coalesce(turns, F.lit(0)).cast("long"))
    summed = running_total(marked, "__turns", "__total", size)
    return summed.withColumn(out, F.col(angle) + F.col("__total") * (2 * math.pi)).drop("__angle", "__turns", "__total")


def integrate(rows: DataFrame, column: str, out: str, dt: float = 1.0, size: int = SIZE) -> DataFrame:
    """As kinematics.integrate(); sums of doubles may differ in the last digits."""
    part = with_previous(rows, column, "__prev", size).withColumn("__trapezoid", (F.col(column) + F.col("__prev")) / 2 * dt)
    return running_total(part, "__trapezoid", out, size).drop("__prev", "__trapezoid")


def with_previous(rows: DataFrame, column: str, out: str, size: int = SIZE) -> DataFrame:
    """rows with out, column of the track's row before (NULL if it is NULL there)."""
    held = rows.withColumn("__held", F.struct(F.col(column).alias("v")))
    return carried(held, {"__row": "__held"}, size).withColumn(out, F.col("__row")["v"]).drop("__held", "__row")


def orient(rows: DataFrame, posture: str = "posture", size: int = SIZE) -> DataFrame:
    """As sequences.orient(): whole postures are carried from block to block, one for each."""
    seen = carried(rows, {"__posture": posture}, size)
    seen = seen.withColumns({"direct": mean_point_distance(F.col(posture), F.col("__posture")), "flipped": mean_point_distance(F.reverse(F.col(posture)), F.col("__posture"))})
    turned = seen.withColumn("__turn", F.coalesce((F.col("flipped") < F.col("direct")).cast("int"), F.lit(0)))
    return running_total(turned, "__turn", "__turns", size).withColumn("flip", F.col("__turns") % 2 == 1).drop("__posture", "__turn", "__turns")


def lag_pairs(rows: DataFrame, lags: list[int], values: list[str], exclude: Column | None = None, size: int = SIZE) -> DataFrame:
    """As lagstats.lag_pairs() by track, for lags below size; each block has a margin of the longest lag."""
    if max(lags) >= size:
        raise ValueError("a lag must be shorter than a block")
    flag = F.coalesce(exclude, F.lit(False)).cast("int") if exclude is not None else F.lit(0)
    base = running_total(rows.select("track", "frame", *values, flag.alias("__flag")), "__flag", "__cut", size)
    later = F.struct("frame", "__cut", *values)
    near = with_margins(base, 0, max(lags), size)
    looked = near.withColumns({f"__to{n}": F.lead(later, n).over(by_block()) if n else later for n in lags}).where("__own")
    ahead = F.array(*[F.struct(F.lit(n).cast("long").alias("lag"), F.col(f"__to{n}").alias("to")) for n in lags])
    pairs = looked.select("track", "frame", "__cut", *[F.col(v).alias(f"{v}0") for v in values], F.explode(ahead).alias("p"))
    pairs = pairs.where((F.col("p.to.frame") == F.col("frame") + F.col("p.lag")) & (F.col("p.to.__cut") == F.col("__cut")))
    return pairs.select("track", F.col("p.lag").alias("lag"), *[f"{v}0" for v in values], *[F.col(f"p.to.{v}").alias(f"{v}1") for v in values])
