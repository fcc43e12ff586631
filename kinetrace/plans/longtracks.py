"""Queries of the operators for very long tracks and fine grids; the SQL is that of the windows and of the whole sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinetrace.operators import blocks, distributions, lagstats, sequences
from kinetrace.plans.queries import GREEDY, ORACLE_SQL, TRACK, derived, digits, query
from kinetrace.sources import tables

#: Frames of a block, small enough for the sample tracks to have several.
SIZE = 32
#: How far x goes in a jump.
LEAP = 10_000


@query(ORACLE_SQL["unwrapped_bearing"])
def unwrapped_in_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks.unwrap(derived(spark, d), "phi", size=SIZE).select("track", "frame", digits("unwrapped", 5))


@query(ORACLE_SQL["integrated_position"])
def integrated_in_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks.integrate(tables.track(spark, d), "x", "position", size=SIZE).select("track", "frame", "position")


@query(ORACLE_SQL["msd_excluding"])
def msd_in_blocks(spark: SparkSession, d: str) -> DataFrame:
    pairs = blocks.lag_pairs(tables.track(spark, d), list(range(11)), ["x"], F.col("excluded"), SIZE)
    step = F.col("x1") - F.col("x0")
    return lagstats.mean_over_pairs(pairs, ["track"], "msd", step * step)


@query(f"""WITH RECURSIVE lt AS (SELECT user_id % 4 AS track, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS frame, CAST(round(value * 100) AS BIGINT) AS x, NOT event_type IN ('error', 'purchase') AS here FROM events),
fr AS (SELECT track, frame, here, coalesce(here AND abs(x - last_value(CASE WHEN here THEN x END IGNORE NULLS) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) > {LEAP}, false) AS jump FROM lt),
{GREEDY.format(gap=1, longest=12)} SELECT track, "begin", "end" FROM sg WHERE "end" - "begin" > 3""")
def long_track_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of all events as four long tracks, that break where x leaps away from its last good place."""
    events = tables.read(spark, d, "events").withColumn("track", F.col("user_id") % 4)
    frame = F.row_number().over(Window.partitionBy("track").orderBy("ts", "event_id")) - 1
    rows = events.select("track", frame.cast("long").alias("frame"), F.round(F.col("value") * 100).cast("long").alias("x"), (~F.col("event_type").isin("error", "purchase")).alias("here"))
    seen = sequences.last_good(rows, F.col("here"), "x")
    return sequences.greedy_segments(seen, F.col("here"), F.abs(F.col("x") - F.col("last_x")) > LEAP, 1, 12, 3)


@query(ORACLE_SQL["orientation"])
def orientation_in_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.posture(spark, d).withColumn("track", F.col("strain").cast("long"))
    return blocks.orient(rows, size=SIZE).select("track", "frame", digits("direct"), digits("flipped"), "flip")


@query(f"""WITH {TRACK}, s AS (SELECT strain, count(*) AS n, pow(count(*), -0.2) * stddev_samp(x) AS h FROM track GROUP BY strain), c AS (SELECT strain, x, count(*) AS c FROM track GROUP BY ALL), g AS (SELECT i * 250.0 AS gx FROM range(201) t(i))
SELECT strain, CAST(gx AS DOUBLE) AS point, round(sum(c * exp(-((gx - x) / h) * ((gx - x) / h) / 2)) / max(n), 4) AS share FROM c JOIN s USING (strain), g GROUP BY strain, gx HAVING share > 0""")
def density_1d_fine(spark: SparkSession, d: str) -> DataFrame:
    """Kernel density of x on 201 points, as a share of one kernel's height."""
    rows = tables.track(spark, d)
    found = distributions.kde_binned(rows, "x", 0.0, 250.0, 201, ["strain"])
    height = rows.groupBy("strain").agg((F.pow(F.count("x").cast("double"), F.lit(-0.2)) * F.stddev_samp("x")).alias("h"))
    return found.join(height, "strain").select("strain", "point", F.round(F.col("density") * F.col("h") * (2 * F.pi()) ** 0.5, 4).alias("share")).where("share > 0")


@query(f"""WITH {TRACK}, c AS (SELECT strain, pow(count(*), -1.0 / 3) AS f, count(*) AS n, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy FROM track GROUP BY strain),
s AS (SELECT strain, n, xx * f AS xx, yy * f AS yy, xy * f AS xy, xx * f * yy * f - xy * f * xy * f AS det FROM c), p AS (SELECT strain, x, y, count(*) AS c FROM track GROUP BY ALL),
g AS (SELECT CAST(a * 500 AS DOUBLE) AS gx, CAST(b AS DOUBLE) AS gy FROM range(100) t(a), range(100) u(b))
SELECT strain, gx, gy, round(sum(c * exp(-(yy * (gx - x) * (gx - x) - 2 * xy * (gx - x) * (gy - y) + xx * (gy - y) * (gy - y)) / det / 2)) / max(n), 4) AS share
FROM p JOIN s USING (strain), g WHERE abs(gx - x) < 7 * sqrt(xx) GROUP BY 1, 2, 3 HAVING share > 0""")
def density_2d_fine(spark: SparkSession, d: str) -> DataFrame:
    """Kernel density of (x, y) on 100 by 100 points, as a share of one kernel's height."""
    rows = tables.track(spark, d)
    found = distributions.kde_2d_binned(rows, "x", "y", (0.0, 500.0, 100), (0.0, 1.0, 100), ["strain"])
    spread = F.var_samp("x") * F.var_samp("y") - F.covar_samp("x", "y") * F.covar_samp("x", "y")
    height = rows.groupBy("strain").agg((F.sqrt(spread) * F.pow(F.count("*").cast("double"), F.lit(-1 / 3))).alias("h"))
    return found.join(height, "strain").select("strain", "gx", "gy", F.round(F.col("density") * F.col("h") * (2 * F.pi()), 4).alias("share")).where("share > 0")
