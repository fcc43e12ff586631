"""One query per operator on the sample tables, with the SQL that gives the same rows."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinetrace.functions import scalar
from kinetrace.operators import distributions, ensembles, headtail, kinematics, lagstats, masks, models, pixels, posture, sequences, simulate
from kinetrace.plans import chains
from kinetrace.sources import store, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TRACK = """track AS (SELECT user_id AS track, CAST(user_id % 4 AS INTEGER) AS strain, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
  CAST(round(value * 100) AS BIGINT) AS x, CAST(json_extract_string(props, '$.k') AS BIGINT) AS y, event_type AS kind, event_type = 'error' AS bad,
  event_type <> 'signup' AS oriented, event_type = 'purchase' AS excluded FROM events)"""
VALID = "NOT bad AND NOT excluded"
BOX = "W AS (PARTITION BY track ORDER BY frame)"
POSTURE = "posture AS (SELECT vec_id AS frame, label AS strain, embedding AS p FROM embeddings)"
CELLS = "cells AS (SELECT frame, strain, unnest(range(len(p))) AS i, CAST(unnest(p) AS DOUBLE) AS a FROM posture)"
ARENA = """arena AS (SELECT n_nationkey AS strain, CAST(n_nationkey AS BIGINT) * 1000 + 5000 AS food_x, CAST(n_nationkey AS BIGINT) * 5 + 40 AS food_y,
  CAST(n_nationkey AS BIGINT) * 500 + 3000 AS food_r, CAST(n_nationkey AS BIGINT) * 100 AS box_x, CAST(n_nationkey AS BIGINT) AS box_y FROM nation WHERE n_nationkey < 4)"""
LAGS = list(range(1, 21))
TWO_PI = repr(2 * math.pi)
PI = repr(math.pi)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return register


def digits(column: str, n: int = 6):
    return F.round(F.col(column), n).alias(column)


def derived(spark: SparkSession, d: str) -> DataFrame:
    """The sample tracks with velocity, bearing and heading; a heading is the last frame's bearing."""
    return chains.derived_track(tables.track(spark, d), 1.0)


DERIVED = f"""{TRACK}, v0 AS (SELECT *, CASE WHEN {VALID} THEN x END AS vx_, CASE WHEN {VALID} THEN y END AS vy_ FROM track),
v1 AS (SELECT track, strain, frame, oriented, excluded, vx_ AS x, vy_ AS y, (lead(vx_) OVER W - lag(vx_) OVER W) / 2.0 AS vx, (lead(vy_) OVER W - lag(vy_) OVER W) / 2.0 AS vy FROM v0 WINDOW {BOX}),
v2 AS (SELECT *, sqrt(vx * vx + vy * vy) AS s, CASE WHEN vx <> 0 OR vy <> 0 THEN atan2(vy, vx) END AS phi FROM v1),
v3 AS (SELECT *, CASE WHEN oriented THEN lag(phi) OVER W END AS psi FROM v2 WINDOW {BOX}),
derived AS (SELECT *, (phi - psi + {PI}) - {TWO_PI} * floor((phi - psi + {PI}) / {TWO_PI}) - {PI} AS dpsi FROM v3)"""
STATE = "CASE WHEN dpsi IS NULL THEN 0 WHEN abs(dpsi) > pi() / 2 THEN 2 ELSE 1 END"
REVERSALS = f"""{DERIVED}, st AS (SELECT track, frame, {STATE} AS s FROM derived), nx AS (SELECT *, lead(s) OVER W AS n, lag(s) OVER W AS p, lead(s, 2) OVER W AS m FROM st WINDOW {BOX}),
ev AS (SELECT *, CASE WHEN p IS NULL OR m IS NULL THEN NULL WHEN s = 2 AND n = 2 THEN 1 WHEN s = 0 OR (s = 1 AND n = 1) THEN 0 END AS e FROM nx),
bk AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY track ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) AS b FROM ev),
ed AS (SELECT *, coalesce(lag(b) OVER W, 0) AS o FROM bk WINDOW {BOX}), pt AS (SELECT track, frame, b, CASE WHEN CASE WHEN b = 1 THEN p ELSE s END <> 0 THEN frame END AS known FROM ed WHERE b <> o),
rev AS (SELECT track, known AS "begin", later AS "end" FROM (SELECT *, lead(known) OVER W AS later, lead(frame) OVER W AS closed FROM pt WINDOW {BOX}) WHERE b = 1 AND closed IS NOT NULL)"""
NEAR = f"""{REVERSALS}, bo AS (SELECT track, unnest(["begin", "end"]) AS f FROM rev), nr AS (SELECT DISTINCT d.track, d.frame FROM derived d JOIN bo ON d.track = bo.track AND abs(d.frame - bo.f) < 3)"""
#: Derived tracks with the speed off reversals and the unwrapped heading; only frames with an orientation count.
FREE = f"""{NEAR}, pg AS (SELECT track, frame, psi, psi - lag(psi) OVER W AS d FROM derived WHERE psi IS NOT NULL WINDOW {BOX}),
pu AS (SELECT track, frame, psi + {TWO_PI} * sum(CASE WHEN abs(d) > {PI} THEN -floor((d + {PI}) / {TWO_PI}) ELSE 0 END) OVER (PARTITION BY track ORDER BY frame ROWS UNBOUNDED PRECEDING) AS turned FROM pg),
o AS (SELECT d.track, d.strain, d.frame, d.excluded, d.psi, d.dpsi, CASE WHEN d.oriented THEN d.x END AS x, CASE WHEN d.oriented THEN d.y END AS y, CASE WHEN d.oriented THEN d.vx END AS vx, CASE WHEN d.oriented THEN d.vy END AS vy,
 CASE WHEN d.oriented THEN d.s END AS s, CASE WHEN d.oriented AND nr.frame IS NULL THEN d.s END AS free, pu.turned FROM derived d LEFT JOIN nr ON d.track = nr.track AND d.frame = nr.frame LEFT JOIN pu ON d.track = pu.track AND d.frame = pu.frame)"""
#: Embeddings as tracks of skeletons, one for each strain: 32 points (numbers in turn are x and y) and 64 angles, missing where the first number is low.
#: Segments sg of frames fr (track, frame, here, jump), one frame at a time.
GREEDY = """sr AS (SELECT track, frame, frame AS "begin", 0 AS miss, false AS done FROM fr WHERE frame = 0 UNION ALL
 SELECT f.track, f.frame, CASE WHEN sr.done OR f.jump OR f.frame - sr."begin" >= {longest} THEN f.frame ELSE sr."begin" END, CASE WHEN sr.done OR f.jump OR f.frame - sr."begin" >= {longest} OR f.here THEN 0 ELSE sr.miss + 1 END,
  NOT (sr.done OR f.jump OR f.frame - sr."begin" >= {longest} OR f.here) AND sr.miss + 1 > {gap} FROM sr JOIN fr f ON f.track = sr.track AND f.frame = sr.frame + 1),
sg AS (SELECT track, "begin", max(frame) + 1 AS "end" FROM sr GROUP BY track, "begin")"""
SKELETON = f"""{POSTURE}, sk AS (SELECT CAST(strain AS BIGINT) AS track, row_number() OVER (PARTITION BY strain ORDER BY frame) - 1 AS frame, CASE WHEN p[1] >= -0.1 THEN list_transform(p, lambda e: CAST(e AS DOUBLE)) END AS p FROM posture),
ql AS (SELECT *, last_value(p IGNORE NULLS) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM sk),
di AS (SELECT track, frame, p, ({" + ".join(f"sqrt((p[{2 * i - 1}] - q[{2 * i - 1}]) ** 2 + (p[{2 * i}] - q[{2 * i}]) ** 2)" for i in range(1, 33))}) / 32 AS direct, ({" + ".join(f"sqrt((p[{65 - 2 * i}] - q[{2 * i - 1}]) ** 2 + (p[{66 - 2 * i}] - q[{2 * i}]) ** 2)" for i in range(1, 33))}) / 32 AS flipped FROM ql),
fr AS (SELECT *, sum(CASE WHEN flipped < direct THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY frame ROWS UNBOUNDED PRECEDING) % 2 = 1 AS flip, p IS NOT NULL AS here, coalesce(least(direct, flipped) >= {{jump}}, false) AS jump FROM di),
{GREEDY}"""
CUTS = {"jump": 0.22, "gap": 1, "longest": 12}
SEGMENTED = SKELETON.format(**CUTS)


# --- lag statistics ---------------------------------------------------------


@query(f"""WITH {TRACK}, good AS (SELECT * FROM track WHERE {VALID})
SELECT a.strain, CAST(b.frame - a.frame AS BIGINT) AS lag, CAST(sum((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS DOUBLE) / count(*) AS msd, count(*) AS pairs
FROM good a JOIN good b ON a.track = b.track AND b.frame - a.frame BETWEEN 1 AND 20 GROUP BY 1, 2""")
def msd(spark: SparkSession, d: str) -> DataFrame:
    """Mean squared displacement of each strain over valid centroids."""
    rows = masks.masked(tables.track(spark, d), masks.centroid_valid(), "x", "y")
    pairs = lagstats.lag_pairs(rows, LAGS, ["x", "y"], ["track", "strain"])
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return lagstats.mean_over_pairs(pairs, ["strain"], "msd", dx * dx + dy * dy).where("pairs > 0")


@query(f"""WITH {TRACK}, c AS (SELECT *, sum(CAST(excluded AS INTEGER)) OVER (PARTITION BY track ORDER BY frame ROWS UNBOUNDED PRECEDING) AS cut FROM track)
SELECT a.track, CAST(b.frame - a.frame AS BIGINT) AS lag, CAST(sum((b.x - a.x) * (b.x - a.x)) AS DOUBLE) / count(*) AS msd, count(*) AS pairs
FROM c a JOIN c b ON a.track = b.track AND b.frame - a.frame BETWEEN 0 AND 10 AND a.cut = b.cut GROUP BY 1, 2""")
def msd_excluding(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that cross an excluded frame are left out."""
    return lagstats.squared_displacement(tables.track(spark, d), list(range(11)), ["x"], exclude=F.col("excluded"))


@query(f"""WITH {TRACK} SELECT a.track, CAST(b.frame - a.frame AS BIGINT) AS lag, CAST(sum((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS DOUBLE) / count(*) AS msd, count(*) AS pairs
FROM track a JOIN track b ON a.track = b.track AND b.frame - a.frame IN (1, 2, 3, 5, 8, 13, 21, 34) GROUP BY 1, 2""")
def msd_log_lags(spark: SparkSession, d: str) -> DataFrame:
    return lagstats.squared_displacement(tables.track(spark, d), [1, 2, 3, 5, 8, 13, 21, 34], ["x", "y"])


@query(f"""WITH {TRACK} SELECT a.track, CAST(b.frame - a.frame AS BIGINT) AS lag, CAST(sum(b.x - a.x) AS DOUBLE) / count(*) AS drift, count(*) AS pairs
FROM track a JOIN track b ON a.track = b.track AND b.frame - a.frame BETWEEN 0 AND 70 GROUP BY 1, 2""")
def drift_many_lags(spark: SparkSession, d: str) -> DataFrame:
    """Beyond FEW_LAGS the pairs come from an equi-join."""
    return lagstats.drift(tables.track(spark, d), list(range(71)), "x")


@query(f"""WITH {TRACK} SELECT a.track, CAST(b.frame - a.frame AS BIGINT) AS lag, CAST(sum(a.x * b.x + a.y * b.y) AS DOUBLE) / count(*) AS dotacf, count(*) AS pairs
FROM track a JOIN track b ON a.track = b.track AND b.frame - a.frame BETWEEN 0 AND 20 GROUP BY 1, 2""")
def vector_acf(spark: SparkSession, d: str) -> DataFrame:
    return lagstats.vector_autocorrelation(tables.track(spark, d), [0, *LAGS], ["x", "y"])


@query(f"""WITH {TRACK}, m AS (SELECT track, avg(x) AS m, var_pop(x) AS v FROM track GROUP BY track), c AS (SELECT track, frame, x - m AS d, v FROM track JOIN m USING (track))
SELECT a.track, CAST(b.frame - a.frame AS BIGINT) AS lag, round(avg(a.d * b.d) / 1e6, 6) AS acv, round(CASE WHEN b.frame = a.frame THEN 1.0 ELSE avg(a.d * b.d) / max(a.v) END, 6) AS acf, count(*) AS pairs
FROM c a JOIN c b ON a.track = b.track AND b.frame - a.frame BETWEEN 0 AND 20 GROUP BY 1, 2, b.frame = a.frame""")
def acf(spark: SparkSession, d: str) -> DataFrame:
    """Autocovariance (in squared thousands) and autocorrelation."""
    cov = lagstats.autocovariance(tables.track(spark, d), [0, *LAGS], "x")
    cor = F.when(F.col("lag") == 0, 1.0).otherwise(F.col("acv") / F.nullif("var", F.lit(0.0)))
    return cov.select("track", "lag", F.round(F.col("acv") / 1e6, 6).alias("acv"), F.round(cor, 6).alias("acf"), "pairs")


@query(f"""WITH {TRACK}, m AS (SELECT track, avg(x) AS mx, avg(y) AS my, sqrt(var_pop(x) * var_pop(y)) AS s FROM track GROUP BY track),
c AS (SELECT track, frame, x - mx AS a, y - my AS b, s FROM track JOIN m USING (track))
SELECT p.track, CAST(q.frame - p.frame AS BIGINT) AS lag, round(avg(p.a * q.b) / max(p.s), 6) AS ccf, count(*) AS pairs
FROM c p JOIN c q ON p.track = q.track AND q.frame - p.frame BETWEEN -12 AND 11 GROUP BY 1, 2""")
def ccf(spark: SparkSession, d: str) -> DataFrame:
    return lagstats.cross_correlation(tables.track(spark, d), 12, "x", "y").select("track", "lag", digits("ccf"), "pairs")


@query(f"""WITH RECURSIVE {TRACK}, m AS (SELECT track, avg(x) AS m, var_pop(x) AS v FROM track GROUP BY track), c AS (SELECT track, frame, x - m AS d, v FROM track JOIN m USING (track)),
a AS (SELECT a.track, b.frame - a.frame AS lag, avg(a.d * b.d) / max(a.v) AS acf FROM c a JOIN c b ON a.track = b.track AND b.frame - a.frame BETWEEN 1 AND 8 GROUP BY 1, 2), l AS (SELECT track, list(acf ORDER BY lag) AS r FROM a GROUP BY track),
d AS (SELECT track, r, 1 AS k, [r[1]] AS phi FROM l UNION ALL SELECT track, r, k + 1, list_append(list_transform(range(1, k + 1), lambda i: phi[i] - new * phi[k + 1 - i]), new) FROM
 (SELECT *, (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[k + 1 - i]))) / (1 - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[i]))) AS new FROM d WHERE k < len(r)))
SELECT track, CAST(k AS BIGINT) AS lag, round(phi[k], 6) AS pacf FROM d""")
def pacf(spark: SparkSession, d: str) -> DataFrame:
    rows = lagstats.partial_autocorrelation(lagstats.autocorrelation(tables.track(spark, d), LAGS[:8], "x"))
    return rows.select("track", "lag", digits("pacf"))


WINDOWED = """, wn AS (SELECT *, unnest(range(greatest(CAST(floor((frame - 20) / 10.0) AS BIGINT) + 1, 0), CAST(floor(frame / 10.0) AS BIGINT) + 1)) AS "window",
  max(frame) OVER (PARTITION BY track) + 1 AS len FROM {0}), ws AS (SELECT * FROM wn WHERE "window" < floor(len / 10.0 + 0.5))"""


@query(f"""WITH {TRACK}{WINDOWED.format("track")} SELECT track, "window", count(*) AS n, min(frame) AS first_frame, CAST(count(*) FILTER (WHERE {VALID}) AS DOUBLE) / count(*) AS present
FROM ws GROUP BY 1, 2 HAVING CAST(count(*) FILTER (WHERE {VALID}) AS DOUBLE) / count(*) > 0.5""")
def sufficient_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 20 frames, half overlapping, with more than half of their frames valid."""
    listed = masks.windows(tables.track(spark, d), 20)
    share = (F.count_if(masks.centroid_valid()) / F.count("*")).alias("present")
    return listed.groupBy("track", "window").agg(F.count("*").alias("n"), share, F.min("frame").alias("first_frame")).where("present > 0.5")


@query(f"""WITH {TRACK}{WINDOWED.format("track")}, m AS (SELECT track, "window", avg(x) AS m FROM ws GROUP BY 1, 2), c AS (SELECT track, "window", frame, x - m AS d FROM ws JOIN m USING (track, "window")),
k AS (SELECT a.track, a."window", CAST(b.frame - a.frame AS BIGINT) AS lag, avg(a.d * b.d) AS v FROM c a JOIN c b ON a.track = b.track AND a."window" = b."window" AND b.frame - a.frame BETWEEN 0 AND 9 GROUP BY 1, 2, 3)
SELECT track, lag, round(avg(v) / 1e6, 6) AS acv, count(v) AS windows FROM k GROUP BY 1, 2""")
def windowed_autocovariance(spark: SparkSession, d: str) -> DataFrame:
    """Per window, then the mean over windows (in squared thousands)."""
    cov = lagstats.autocovariance(masks.windows(tables.track(spark, d), 20), list(range(10)), "x", ["track", "window"])
    return lagstats.over_windows(cov, "acv").select("track", "lag", F.round(F.col("acv") / 1e6, 6).alias("acv"), "windows")


@query(f"""WITH {DERIVED}{WINDOWED.format("derived")}, c AS (SELECT track, "window", frame, cos(psi) AS c, sin(psi) AS s FROM ws),
k AS (SELECT a.track, a."window", CAST(b.frame - a.frame AS BIGINT) AS lag, avg(a.c * b.c + a.s * b.s) AS v FROM c a JOIN c b ON a.track = b.track AND a."window" = b."window" AND b.frame - a.frame BETWEEN 0 AND 9 GROUP BY 1, 2, 3)
SELECT track, lag, round(avg(v), 6) AS psi_acf, count(v) AS windows FROM k GROUP BY 1, 2""")
def body_bearing_acf(spark: SparkSession, d: str) -> DataFrame:
    rows = masks.windows(derived(spark, d), 20).withColumns({"c": F.cos("psi"), "s_": F.sin("psi")})
    cov = lagstats.vector_autocorrelation(rows, list(range(10)), ["c", "s_"], ["track", "window"]).withColumnRenamed("dotacf", "psi_acf")
    return lagstats.over_windows(cov, "psi_acf").select("track", "lag", digits("psi_acf"), "windows")


@query(f"""WITH {DERIVED}, c AS (SELECT track, frame, cos(dpsi) AS r, cos(phi) AS c, sin(phi) AS s FROM derived)
SELECT a.track, CAST(b.frame - a.frame AS BIGINT) AS lag, round(avg(a.c * b.c + a.s * b.s), 6) + 0.0::DOUBLE AS phi_acf, count(a.c * b.c) AS pairs
FROM c a JOIN c b ON a.track = b.track AND b.frame - a.frame BETWEEN 0 AND 20 GROUP BY 1, 2""")
def bearing_acf(spark: SparkSession, d: str) -> DataFrame:
    rows = derived(spark, d).withColumns({"c": F.cos("phi"), "s_": F.sin("phi")})
    return lagstats.vector_autocorrelation(rows, [0, *LAGS], ["c", "s_"]).select("track", "lag", (F.round("dotacf", 6) + F.lit(0.0)).alias("phi_acf"), "pairs")


@query(f"""WITH {DERIVED}, g AS (SELECT track, frame, cos(dpsi) AS r FROM derived), m AS (SELECT track, avg(r) AS m, var_pop(r) AS v FROM g GROUP BY track),
c AS (SELECT track, frame, r - m AS d, v FROM g JOIN m USING (track))
SELECT a.track, CAST(b.frame - a.frame AS BIGINT) AS lag, round(CASE WHEN a.frame = b.frame THEN 1.0 ELSE avg(a.d * b.d) / max(nullif(a.v, 0)) END, 5) AS acf, count(a.d * b.d) AS pairs
FROM c a JOIN c b ON a.track = b.track AND b.frame - a.frame BETWEEN 0 AND 10 GROUP BY 1, 2, a.frame = b.frame""")
def reversal_state_acf(spark: SparkSession, d: str) -> DataFrame:
    rows = derived(spark, d).withColumn("r", F.cos("dpsi"))
    return lagstats.autocorrelation(rows, list(range(11)), "r").select("track", "lag", digits("acf", 5), "pairs")


#: Divisor and digits of each curve; by 7, as means of whole numbers would else often lie half-way between two roundings.
_SCALES = {"msd": (7.0, 3), "vacf": (7.0, 3), "s_acf": (1e6, 5), "psi_acf": (1.0, 6), "dpsi_acf": (1.0, 6), "psi_trend": (1.0, 6)}


@query(f"""WITH {FREE}{WINDOWED.format("o")}, kp AS (SELECT *, count(s) OVER K::DOUBLE / count(*) OVER K AS pr FROM ws WINDOW K AS (PARTITION BY track, "window")),
kd AS (SELECT *, free - avg(free) OVER K AS ds, sum(CAST(excluded AS INTEGER)) OVER (PARTITION BY track, "window" ORDER BY frame ROWS UNBOUNDED PRECEDING) AS cut FROM kp WHERE pr > 0.3 WINDOW K AS (PARTITION BY track, "window")),
cv AS (SELECT a.track, a."window", CAST(b.frame - a.frame AS BIGINT) AS lag, avg((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS msd, avg(b.vx * a.vx + b.vy * a.vy) AS vacf, avg(b.ds * a.ds) AS s_acf,
 avg(cos(b.psi) * cos(a.psi) + sin(b.psi) * sin(a.psi)) AS psi_acf, avg(cos(b.dpsi) * cos(a.dpsi) + sin(b.dpsi) * sin(a.dpsi)) AS dpsi_acf, abs(avg(b.turned - a.turned)) AS psi_trend
 FROM kd a JOIN kd b ON a.track = b.track AND a."window" = b."window" AND b.frame - a.frame BETWEEN 0 AND 7 AND a.cut = b.cut GROUP BY 1, 2, 3)
{" UNION ALL ".join(f"SELECT track, '{m}' AS metric, lag, CAST(lag AS DOUBLE) AS tau, round(avg({m}) / {k!r}, {n}) + 0.0::DOUBLE AS value, count({m}) AS windows FROM cv GROUP BY track, lag" for m, (k, n) in _SCALES.items())}""")
def correlation_table(spark: SparkSession, d: str) -> DataFrame:
    """Six curves of all tracks, as one long table: the first two over 7, covariances of speed in millions."""
    rows = chains.with_reversals(derived(spark, d), 3)
    table = chains.correlation_table(rows, list(range(8)), 20, 0.3)
    value = F.coalesce(*[F.when(F.col("metric") == m, F.round(F.col("value") / k, n)) for m, (k, n) in _SCALES.items()])
    return table.select("track", "metric", "lag", "tau", (value + F.lit(0.0)).alias("value"), "windows")


@query(f"""WITH {FREE}, fs AS (SELECT track, count(free) AS n, stddev_samp(free) AS sd FROM o GROUP BY track HAVING count(free) >= 20), gp AS (SELECT unnest(range(0, 20)) * 1000.0 AS point),
ke AS (SELECT o.track, gp.point, sum(exp(-0.5 * pow((gp.point - free) / (pow(n, -0.2) * sd), 2))) / (max(n) * max(pow(n, -0.2) * sd) * sqrt(2 * pi())) AS v FROM o JOIN fs USING (track) CROSS JOIN gp WHERE free IS NOT NULL GROUP BY 1, 2)
SELECT track, CAST(point AS DOUBLE) AS speed, round(v * 1e4, 6) AS density FROM ke""")
def speed_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Density of each track's speed off reversals."""
    rows = chains.with_reversals(derived(spark, d), 3)
    return chains.speed_density(rows, [1000.0 * i for i in range(20)], 20).select("track", F.col("point").alias("speed"), F.round(F.col("density") * 1e4, 6).alias("density"))


@query(f"""WITH {FREE}, fm AS (SELECT *, free - avg(free) OVER (PARTITION BY track) AS ds, sum(CAST(excluded AS INTEGER)) OVER (PARTITION BY track ORDER BY frame ROWS UNBOUNDED PRECEDING) AS cut FROM o)
SELECT a.track, CAST(b.frame - a.frame AS BIGINT) AS lag, round(avg(a.ds * b.ds) / 1e6, 6) AS acv, count(a.ds * b.ds) AS pairs FROM fm a JOIN fm b ON a.track = b.track AND b.frame - a.frame BETWEEN 0 AND 10 AND a.cut = b.cut GROUP BY 1, 2""")
def speed_autocovariance(spark: SparkSession, d: str) -> DataFrame:
    """Of the speed off reversals, pairs across excluded frames left out."""
    rows = masks.masked(chains.with_reversals(derived(spark, d), 3), F.col("oriented") & ~F.col("near"), "s")
    cov = lagstats.autocovariance(rows, list(range(11)), "s", exclude=F.col("excluded"))
    return cov.select("track", "lag", F.round(F.col("acv") / 1e6, 6).alias("acv"), "pairs")


@query(f"""WITH {FREE}{WINDOWED.format("o")}, kt AS (SELECT track, "window", regr_slope(turned, CAST(frame AS DOUBLE)) AS k FROM ws GROUP BY 1, 2 HAVING count(turned)::DOUBLE / count(*) > 0.2)
SELECT track, round(avg(abs(k)), 6) AS trend, count(k) AS windows FROM kt GROUP BY track""")
def bearing_trend(spark: SparkSession, d: str) -> DataFrame:
    """Mean size of the slope of the unwrapped heading in windows that have a fifth of it."""
    rows = masks.windows(kinematics.unwrap(derived(spark, d), "psi"), 20)
    share = F.count("unwrapped").over(Window.partitionBy("track", "window")) / F.count("*").over(Window.partitionBy("track", "window"))
    held = rows.withColumn("share", share).where("share > 0.2")
    return models.mean_abs_trend(held, ["track"], "window", "frame", "unwrapped").select("track", digits("trend"), "windows")


@query()
def model_fits(spark: SparkSession, d: str) -> DataFrame:
    """Eight parameters of each track, on food and off the border, lengths from the size table of the same key."""
    rows = chains.with_food_and_edge(tables.track(spark, d), tables.arena(spark, d).withColumns({"food_r": F.col("food_r") * 8, "box_h": F.col("box_h") + 1000}), "on_food", -2000)
    lengths = tables.size(spark, d).groupBy("track").agg(F.median("length").alias("length"))
    return chains.fit_model(rows.join(lengths, "track", "left"), list(range(8)), 20)


# --- masks ------------------------------------------------------------------


@query("""WITH s AS (SELECT l_suppkey AS track, l_extendedprice AS length, l_quantity AS width FROM lineitem),
m AS (SELECT track, median(length) AS ml, median(width) AS mw FROM s WHERE length <> 0 AND width <> 0 GROUP BY track)
SELECT track, count(*) AS n, count(*) FILTER (WHERE NOT coalesce(length <> 0 AND width <> 0 AND length BETWEEN 0.9 * ml AND 1.1 * ml AND width BETWEEN 0.7 * mw AND 1.3 * mw, false)) AS n_bad,
  max(ml) AS mid_length, max(mw) AS mid_width FROM s LEFT JOIN m USING (track) GROUP BY track""")
def bad_size(spark: SparkSession, d: str) -> DataFrame:
    rows = masks.flag_bad_size(tables.size(spark, d))
    return rows.groupBy("track").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), F.max("mid_length").alias("mid_length"), F.max("mid_width").alias("mid_width"))


@query("""WITH s AS (SELECT l_suppkey AS track, l_extendedprice AS length, l_quantity AS width FROM lineitem),
m AS (SELECT track, median(length) AS ml, median(width) AS mw FROM s WHERE length <> 0 AND width <> 0 GROUP BY track),
f AS (SELECT track, NOT (length BETWEEN 0.8 * ml AND 1.2 * ml AND width BETWEEN 0.5 * mw AND 1.5 * mw) AS bad FROM s JOIN m USING (track))
SELECT track, count(*) FILTER (WHERE bad) AS n_rejected, CAST(count(*) FILTER (WHERE bad) AS DOUBLE) * 100 / count(*) AS percent FROM f GROUP BY track""")
def rejected_percent(spark: SparkSession, d: str) -> DataFrame:
    rows = masks.flag_bad_size(tables.size(spark, d), (0.8, 1.2), (0.5, 1.5))
    return rows.groupBy("track").agg(F.count_if("bad").alias("n_rejected"), (F.count_if("bad").cast("double") * 100 / F.count("*")).alias("percent"))


@query(f"""WITH {TRACK}, d AS (SELECT *, lead(x) OVER W - lag(x) OVER W AS dx, lead(y) OVER W - lag(y) OVER W AS dy FROM track WINDOW {BOX})
SELECT track, frame, coalesce(dx * dx + dy * dy > 4 * 9000 * 9000, false) AS too_fast FROM d""")
def bad_speed(spark: SparkSession, d: str) -> DataFrame:
    return masks.flag_bad_speed(tables.track(spark, d), F.lit(9000).cast("long")).select("track", "frame", "too_fast")


@query(f"""WITH {TRACK} SELECT track, count(CASE WHEN {VALID} THEN x END) AS n_centroid, sum(CASE WHEN {VALID} THEN x END)::BIGINT AS sum_x, count(CASE WHEN oriented AND {VALID} THEN x END) AS n_posture FROM track GROUP BY track""")
def valid_frames(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.track(spark, d).withColumn("px", F.col("x"))
    rows = masks.masked(masks.masked(rows, masks.posture_valid(), "px"), masks.centroid_valid(), "x")
    return rows.groupBy("track").agg(F.count("x").alias("n_centroid"), F.sum("x").alias("sum_x"), F.count("px").alias("n_posture"))


@query(f"WITH {TRACK} SELECT track, frame, x, y FROM track WHERE frame >= 12 AND frame < 35")
def time_slice(spark: SparkSession, d: str) -> DataFrame:
    return masks.time_slice(tables.track(spark, d), 1.0, 3.0, tables.FRAME_RATE).select("track", "frame", "x", "y")


@query(f"""WITH {TRACK}, {ARENA} SELECT track, count(*) FILTER (WHERE ((x - food_x) * (x - food_x) + (y - food_y) * (y - food_y)) <= food_r * food_r * (1.1::DOUBLE * 1.1::DOUBLE)) AS n_on_food,
 count(*) FILTER (WHERE x - box_x < 500 OR y - box_y < 500 OR x - box_x > 19500 OR y - box_y > -410) AS n_edge, count(*) AS n FROM track JOIN arena USING (strain) GROUP BY track""")
def food_and_edge(spark: SparkSession, d: str) -> DataFrame:
    rows = masks.with_arena(tables.track(spark, d), tables.arena(spark, d))
    return rows.groupBy("track").agg(F.count_if(masks.on_food()).alias("n_on_food"), F.count_if(masks.near_edge(500)).alias("n_edge"), F.count("*").alias("n"))


@query(f"WITH {TRACK} SELECT track * 8 + frame // 12 AS track FROM track GROUP BY 1 HAVING NOT bool_or({VALID} AND y > 60)")
def entirely_missing(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of twelve frames, each a track of its own, without a valid frame above y = 60."""
    rows = tables.track(spark, d).withColumn("track", F.col("track") * 8 + F.floor(F.col("frame") / 12))
    return masks.entirely_missing(rows, masks.centroid_valid() & (F.col("y") > 60))


# --- velocities and angles --------------------------------------------------


@query(f"""WITH {DERIVED} SELECT track, frame, vx, vy, round(s, 4) AS s, round(phi, 6) AS phi, round(psi, 6) AS psi, round(dpsi, 6) AS dpsi FROM derived""")
def derived_track(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d).select("track", "frame", "vx", "vy", digits("s", 4), digits("phi"), digits("psi"), digits("dpsi"))


_CUBIC = kinematics.local_polynomial_weights(6, 3)


@query(f"""WITH {TRACK}, v AS (SELECT track, frame, CASE WHEN NOT bad THEN x END AS x FROM track), s AS (SELECT track, frame, count(x) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS n,
 {" + ".join(f"lag(x, {-k}) OVER W * {c!r}" for k, c in zip(range(-6, 7), _CUBIC, strict=True) if k)} AS v FROM v WINDOW {BOX})
SELECT track, frame, round(CAST(CASE WHEN n = 13 THEN v END AS DOUBLE), 4) AS v FROM s""".replace("lag(x, -", "lead(x, "))
def cubic_velocity(spark: SparkSession, d: str) -> DataFrame:
    rows = masks.masked(tables.track(spark, d), ~F.col("bad"), "x")
    return rows.select("track", "frame", F.round(kinematics.local_slope("x", 6), 4).alias("v"))


@query(f"""WITH {TRACK} SELECT track, frame, round(CASE WHEN count(x) OVER L = 7 THEN regr_slope(x, frame) OVER L END, 4) AS v, x - lag(x) OVER W AS step, round(avg(x) OVER L, 4) AS mean
FROM track WINDOW {BOX}, L AS (PARTITION BY track ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def linear_velocity(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.track(spark, d)
    return rows.select("track", "frame", F.round(kinematics.local_slope("x", 3, 1), 4).alias("v"), kinematics.first_difference("x").alias("step"), F.round(kinematics.moving_average("x", 3), 4).alias("mean"))


@query(f"""WITH {DERIVED}, c AS (SELECT track, frame, lead(phi, 4) OVER W - phi AS k FROM derived WINDOW {BOX})
SELECT track, frame, round((k + {PI}) - {TWO_PI} * floor((k + {PI}) / {TWO_PI}) - {PI}, 6) AS curvature FROM c""")
def path_curvature(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d).select("track", "frame", F.round(kinematics.path_curvature("phi", 4), 6).alias("curvature"))


@query(f"""WITH {DERIVED}, g AS (SELECT track, frame, phi, phi - lag(phi) OVER W AS d FROM derived WHERE phi IS NOT NULL WINDOW {BOX}),
t AS (SELECT track, frame, phi, sum(CASE WHEN abs(d) > {PI} THEN -floor((d + {PI}) / {TWO_PI}) ELSE 0 END) OVER (PARTITION BY track ORDER BY frame ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT d.track, d.frame, round(t.phi + t.k * {TWO_PI}, 5) AS unwrapped FROM derived d LEFT JOIN t ON d.track = t.track AND d.frame = t.frame""")
def unwrapped_bearing(spark: SparkSession, d: str) -> DataFrame:
    return kinematics.unwrap(derived(spark, d), "phi").select("track", "frame", digits("unwrapped", 5))


@query(f"""WITH {TRACK}, p AS (SELECT track, frame, coalesce((x + lag(x) OVER W) / 2.0, 0.0) AS p FROM track WINDOW {BOX})
SELECT track, frame, sum(p) OVER (PARTITION BY track ORDER BY frame ROWS UNBOUNDED PRECEDING) AS position FROM p""")
def integrated_position(spark: SparkSession, d: str) -> DataFrame:
    return kinematics.integrate(tables.track(spark, d), "x", "position").select("track", "frame", "position")


@query(f"""WITH {DERIVED} SELECT strain, round(avg(s), 4) AS mean_speed, round(median(s), 4) AS median_speed, count(s) AS n FROM derived GROUP BY strain""")
def strain_speed(spark: SparkSession, d: str) -> DataFrame:
    rows = derived(spark, d)
    middle = distributions.medians(rows, ["strain"], "s").select("strain", F.round("median", 4).alias("median_speed"))
    return rows.groupBy("strain").agg(F.round(F.avg("s"), 4).alias("mean_speed"), F.count("s").alias("n")).join(middle, "strain")


# --- sequences --------------------------------------------------------------


@query(f"""WITH {TRACK} SELECT track, frame, last_value(CASE WHEN {VALID} THEN x END IGNORE NULLS) OVER P AS last_x, frame - last_value(CASE WHEN {VALID} THEN frame END IGNORE NULLS) OVER P AS frames_since
FROM track WINDOW P AS (PARTITION BY track ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def last_good(spark: SparkSession, d: str) -> DataFrame:
    return sequences.last_good(tables.track(spark, d), masks.centroid_valid(), "x").select("track", "frame", "last_x", "frames_since")


@query(f"""WITH {TRACK}, g AS (SELECT track, frame, frame - row_number() OVER (PARTITION BY track ORDER BY frame) AS g FROM track WHERE {VALID})
SELECT track, min(frame) AS "begin", max(frame) + 1 AS "end", count(*) AS n FROM g GROUP BY track, g""")
def valid_runs(spark: SparkSession, d: str) -> DataFrame:
    return sequences.islands(tables.track(spark, d), masks.centroid_valid())


def _skeletons(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as tracks of skeletons, one for each strain: points xs, ys and angles; NULL where the first number is low."""
    at = (F.row_number().over(Window.partitionBy("strain").orderBy("frame")) - 1).cast("long")
    rows = tables.posture(spark, d).select(F.col("strain").cast("long").alias("track"), at.alias("frame"), F.when(F.element_at("posture", 1) >= -0.1, F.col("posture")).alias("posture"))
    take = lambda first: F.transform(F.sequence(F.lit(first), F.size("posture") - 2 + first, F.lit(2)), lambda i: F.element_at("posture", i))
    return rows.withColumns({"xs": F.when(F.col("posture").isNotNull(), take(1)), "ys": F.when(F.col("posture").isNotNull(), take(2))})


@query(f"""WITH RECURSIVE {SEGMENTED} SELECT track, frame, round(direct, 6) AS direct, round(flipped, 6) AS flipped, flip FROM fr""")
def skeleton_orientation(spark: SparkSession, d: str) -> DataFrame:
    """Mean distance per point to the last skeleton, as it is and turned round."""
    return sequences.orient_points(_skeletons(spark, d)).select("track", "frame", digits("direct"), digits("flipped"), "flip")


@query(f"""WITH RECURSIVE {SEGMENTED} SELECT track, "begin", "end" FROM sg WHERE "end" - "begin" > 3""")
def segments(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of skeletons that follow each other closely."""
    rows = sequences.orient_points(_skeletons(spark, d))
    return sequences.greedy_segments(rows, F.col("xs").isNotNull(), F.least("direct", "flipped") >= CUTS["jump"], CUTS["gap"], CUTS["longest"], 3)


@query(f"""WITH RECURSIVE {SKELETON.format(jump=0.25, gap=2, longest=7)} SELECT s.track, s."begin", s."end", count(*) FILTER (WHERE f.here) AS n FROM sg s JOIN fr f ON f.track = s.track AND f.frame >= s."begin" AND f.frame < s."end" GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE f.here) > 4""")
def segments_by_present(spark: SparkSession, d: str) -> DataFrame:
    """Segments of enough frames that are not missing."""
    rows = sequences.orient_points(_skeletons(spark, d))
    found = sequences.segments_by_present(rows, F.col("xs").isNotNull(), F.least("direct", "flipped") >= 0.25, 2, 7, 4)
    return found.select("track", "begin", "end", "n")


_TURNED = f"""{SEGMENTED}, tp AS (SELECT track, frame, CASE WHEN flip THEN list_reverse(p) ELSE p END AS p FROM fr), se AS (SELECT * FROM sg WHERE "end" - "begin" > 3),
av AS (SELECT track, unnest(range(1, 65)) AS i, unnest(p) AS a FROM tp WHERE p IS NOT NULL), sd AS (SELECT track, i, stddev_pop(a) AS sd FROM av WHERE i <= 5 OR i > 59 GROUP BY 1, 2), ra AS (SELECT track, sum(sd) FILTER (WHERE i <= 5) / sum(sd) FILTER (WHERE i > 59) AS ratio FROM sd GROUP BY track),
pa AS (SELECT s.track, s."begin", t.frame, p[4] AS h, p[62] AS t, p[21] AS a, p[31] AS b FROM se s JOIN tp t ON t.track = s.track AND t.frame >= s."begin" AND t.frame < s."end" WHERE p IS NOT NULL),
pm AS (SELECT *, h - avg(h) OVER S AS dh, t - avg(t) OVER S AS dt, a - avg(a) OVER S AS da, b - avg(b) OVER S AS db, var_pop(h) OVER S AS vh, var_pop(t) OVER S AS vt, sqrt(var_pop(a) OVER S * var_pop(b) OVER S) AS sab FROM pa WINDOW S AS (PARTITION BY track, "begin")),
ac AS (SELECT x.track, x."begin", y.frame - x.frame AS lag, avg(x.dh * y.dh) / nullif(max(x.vh), 0) AS ah, avg(x.dt * y.dt) / nullif(max(x.vt), 0) AS tl FROM pm x JOIN pm y ON x.track = y.track AND x."begin" = y."begin" AND y.frame - x.frame BETWEEN 1 AND 23 GROUP BY 1, 2, 3),
mo AS (SELECT track, "begin", min(tl) - min(ah) AS move FROM ac GROUP BY 1, 2),
cc AS (SELECT x.track, x."begin", y.frame - x.frame AS lag, avg(x.da * y.db) / nullif(max(x.sab), 0) AS ccf FROM pm x JOIN pm y ON x.track = y.track AND x."begin" = y."begin" AND y.frame - x.frame BETWEEN -12 AND 11 GROUP BY 1, 2, 3),
de AS (SELECT track, "begin", lag / 11.5 AS delay FROM (SELECT *, row_number() OVER (PARTITION BY track, "begin" ORDER BY ccf DESC, lag) AS rn FROM cc WHERE ccf IS NOT NULL) WHERE rn = 1),
ht AS (SELECT s.*, ratio, delay, move, CASE WHEN ratio > 1.05 OR ratio < 1 / 1.05::DOUBLE THEN 1 WHEN abs(delay) > 0.08 THEN 3 WHEN abs(move) > 0.05 THEN 2 ELSE 0 END AS method,
 CASE WHEN ratio > 1.05 THEN false WHEN ratio < 1 / 1.05::DOUBLE THEN true WHEN abs(delay) > 0.08 THEN delay < 0 WHEN abs(move) > 0.05 THEN move < 0 ELSE false END AS flip FROM se s LEFT JOIN ra USING (track) LEFT JOIN de USING (track, "begin") LEFT JOIN mo USING (track, "begin"))"""


@query(f"""WITH RECURSIVE {_TURNED} SELECT track, "begin", "end", round(ratio, 6) AS ratio, round(delay, 6) AS delay, round(move, 6) AS move, method, flip FROM ht""")
def head_and_tail(spark: SparkSession, d: str) -> DataFrame:
    """Which end leads in each segment, by posture."""
    found = chains.head_and_tail(_skeletons(spark, d), least=3, least_ratio=1.05, **CUTS)
    return found.select("track", "begin", "end", digits("ratio"), digits("delay"), digits("move"), "method", "flip")


@query(f"""WITH RECURSIVE {_TURNED} SELECT t.track, t.frame, coalesce(h.method > 0, false) AS oriented, round(CASE WHEN h.method > 0 AND h.flip THEN p[64] ELSE p[1] END, 7) AS first_angle, round(CASE WHEN h.method > 0 AND h.flip THEN p[1] ELSE p[64] END, 7) AS last_angle
FROM tp t LEFT JOIN ht h ON h.track = t.track AND t.frame >= h."begin" AND t.frame < h."end" WHERE t.frame >= 0""")
def head_first(spark: SparkSession, d: str) -> DataFrame:
    """Postures from head to tail in the segments that are told."""
    rows = _skeletons(spark, d)
    told = chains.head_and_tail(rows, least=3, least_ratio=1.05, **CUTS)
    turned = chains.head_first(rows, told, least=3, **CUTS)
    return turned.select("track", "frame", "oriented", F.round(F.element_at("posture", 1), 7).alias("first_angle"), F.round(F.element_at("posture", -1), 7).alias("last_angle"))


@query(f"""WITH RECURSIVE {SEGMENTED}, tq AS (SELECT track, frame, flip, p, list_sum(list_transform(range(1, 33), lambda i: p[2 * i - 1])) / 32 AS x, list_sum(list_transform(range(1, 33), lambda i: p[2 * i])) / 32 AS y FROM fr), se AS (SELECT * FROM sg WHERE "end" - "begin" > 3),
te AS (SELECT *, CASE WHEN flip THEN p[63] ELSE p[1] END - x AS hx, CASE WHEN flip THEN p[64] ELSE p[2] END - y AS hy, CASE WHEN flip THEN p[1] ELSE p[63] END - x AS tx, CASE WHEN flip THEN p[2] ELSE p[64] END - y AS ty, (lead(x) OVER W - lag(x) OVER W) * 11.5 / 2 AS vx, (lead(y) OVER W - lag(y) OVER W) * 11.5 / 2 AS vy FROM tq WINDOW {BOX}),
ts AS (SELECT s.track, s."begin", s."end", t.* EXCLUDE (track), (lead(hx) OVER S - lag(hx) OVER S) * 11.5 / 2 AS hu, (lead(hy) OVER S - lag(hy) OVER S) * 11.5 / 2 AS hv, (lead(tx) OVER S - lag(tx) OVER S) * 11.5 / 2 AS tu, (lead(ty) OVER S - lag(ty) OVER S) * 11.5 / 2 AS tv
 FROM se s JOIN te t ON t.track = s.track AND t.frame >= s."begin" AND t.frame < s."end" WINDOW S AS (PARTITION BY s.track, s."begin" ORDER BY t.frame)),
tg AS (SELECT track, "begin", "end", median(sqrt(vx * vx + vy * vy)) AS speed, count(*) FILTER (WHERE cos(atan2(hy, hx) - atan2(vy, vx)) > cos(atan2(ty, tx) - atan2(vy, vx))) AS n_first,
 count(*) FILTER (WHERE cos(atan2(ty, tx) - atan2(vy, vx)) > cos(atan2(hy, hx) - atan2(vy, vx))) AS n_last, avg(sqrt(hu * hu + hv * hv)) AS fs, avg(sqrt(tu * tu + tv * tv)) AS ls FROM ts GROUP BY 1, 2, 3),
th AS (SELECT *, coalesce(speed, 0) > 0.1 AND greatest(n_first, n_last) > 0 AND coalesce(greatest(n_first, n_last)::DOUBLE / nullif(least(n_first, n_last), 0), 'inf'::DOUBLE) > 1.3 AS leads, greatest(coalesce(fs, 0), coalesce(ls, 0)) / nullif(least(coalesce(fs, 0), coalesce(ls, 0)), 0) > 1.1 AS ends FROM tg)
SELECT track, "begin", "end", round(speed, 6) AS speed, n_first, n_last, round(fs, 6) AS first_speed, round(ls, 6) AS last_speed, CASE WHEN leads THEN 1 WHEN ends THEN 2 ELSE -1 END AS method, CASE WHEN leads THEN n_last > n_first WHEN ends THEN ls > fs ELSE false END AS flip FROM th""")
def head_and_tail_by_motion(spark: SparkSession, d: str) -> DataFrame:
    """Which end leads in each segment, by motion of the centroid and of the ends."""
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    rows = _skeletons(spark, d).withColumns({"x": mean("xs"), "y": mean("ys")})
    found = chains.head_and_tail_by_motion(rows, 1 / 11.5, least=3, least_speed=0.1, **CUTS)
    return found.select("track", "begin", "end", digits("speed"), "n_first", "n_last", digits("first_speed"), digits("last_speed"), "method", "flip")


@query(f"""WITH {TRACK}, g AS (SELECT track, frame, frame - row_number() OVER (PARTITION BY track ORDER BY frame) AS g FROM track WHERE {VALID}),
r AS (SELECT track, min(frame) AS b, max(frame) + 1 AS e, count(*) AS n FROM g GROUP BY track, g)
SELECT t.track, t.frame, r.n, r.b AS "begin" FROM track t LEFT JOIN r ON t.track = r.track AND t.frame >= r.b AND t.frame < r.e""")
def frames_in_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.track(spark, d)
    return sequences.in_segments(rows, sequences.islands(rows, masks.centroid_valid())).select("track", "frame", "n", "begin")


@query(f'WITH {REVERSALS} SELECT track, "begin", "end" FROM rev')
def reversal_intervals(spark: SparkSession, d: str) -> DataFrame:
    return sequences.reversals(derived(spark, d), chains.motion_state())


@query(f"""WITH {NEAR} SELECT d.track, d.frame, nr.frame IS NOT NULL AS near FROM derived d LEFT JOIN nr ON d.track = nr.track AND d.frame = nr.frame""")
def near_reversals(spark: SparkSession, d: str) -> DataFrame:
    return chains.with_reversals(derived(spark, d), 3).select("track", "frame", "near")


# --- distributions ----------------------------------------------------------


@query("""WITH h AS (SELECT CAST(least(floor((l_extendedprice - 900) / 1000.0), 99) AS BIGINT) AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 900 AND 100900 GROUP BY 1)
SELECT bin, n, n / ((SELECT sum(n) FROM h)::DOUBLE * 1000.0) AS density FROM h""")
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return distributions.histogram(tables.size(spark, d), "length", 900, 100_900, 100)


@query(f"""WITH {TRACK}, s AS (SELECT track, min(x) AS lo, max(x) AS hi, ceil(sqrt(count(x))) AS b FROM track GROUP BY track)
SELECT track, CAST(CASE WHEN hi > lo THEN least(floor((x - lo) / ((hi - lo) / b)), b - 1) ELSE 0 END AS BIGINT) AS bin, count(*) AS n FROM track JOIN s USING (track) GROUP BY 1, 2""")
def root_histogram(spark: SparkSession, d: str) -> DataFrame:
    return distributions.root_histogram(tables.track(spark, d), "x", ["track"])


@query(f"""WITH {TRACK}, s AS (SELECT strain, count(x) AS n, pow(count(x), -0.2) * stddev_samp(x) AS h FROM track GROUP BY strain), g AS (SELECT CAST(unnest(range(21)) * 2500 AS DOUBLE) AS gx)
SELECT t.strain, g.gx AS point, round(sum(exp(-((gx - t.x) / h) * ((gx - t.x) / h) / 2) / (h * sqrt(2 * pi()))) / max(n) * 1e6, 6) AS density FROM track t JOIN s ON t.strain = s.strain, g GROUP BY t.strain, gx""")
def density_1d(spark: SparkSession, d: str) -> DataFrame:
    """Kernel density of x, per million."""
    rows = distributions.kde(tables.track(spark, d), "x", [2500.0 * i for i in range(21)], ["strain"])
    return rows.select("strain", "point", F.round(F.col("density") * 1e6, 6).alias("density"))


@query(f"""WITH {TRACK}, c AS (SELECT strain, pow(count(*), -1.0 / 3) AS f, count(*) AS n, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy FROM track GROUP BY strain),
s AS (SELECT strain, n, xx * f AS xx, yy * f AS yy, xy * f AS xy, xx * f * yy * f - xy * f * xy * f AS det FROM c),
g AS (SELECT CAST(a * 5000 AS DOUBLE) AS gx, CAST(b * 10 AS DOUBLE) AS gy FROM range(10) t(a), range(10) u(b))
SELECT strain, gx, gy, round(sum(exp(-(yy * (gx - x) * (gx - x) - 2 * xy * (gx - x) * (gy - y) + xx * (gy - y) * (gy - y)) / det / 2) / (2 * pi() * sqrt(det))) / max(n) * 1e9, 5) AS density
FROM track JOIN s USING (strain), g GROUP BY 1, 2, 3""")
def density_2d(spark: SparkSession, d: str) -> DataFrame:
    """Kernel density of (x, y), per thousand million."""
    rows = distributions.kde_2d(tables.track(spark, d), "x", "y", [5000.0 * i for i in range(10)], [10.0 * i for i in range(10)], ["strain"])
    return rows.select("strain", "gx", "gy", F.round(F.col("density") * 1e9, 5).alias("density"))


@query(f"""WITH {TRACK}, u AS (SELECT x / 1000.0::DOUBLE AS u, y / 10.0::DOUBLE / {math.sqrt(3)!r}::DOUBLE AS v FROM track),
f AS (SELECT floor(u + 0.5) AS a, floor(v + 0.5) AS b, floor(u) + 0.5 AS c, floor(v) + 0.5 AS d, u, v FROM u),
k AS (SELECT (u - a) * (u - a) + 3 * (v - b) * (v - b) < (u - c) * (u - c) + 3 * (v - d) * (v - d) AS p, * FROM f)
SELECT CAST(CASE WHEN p THEN a ELSE c END AS DOUBLE) AS hx, CAST(CASE WHEN p THEN b ELSE d END AS DOUBLE) AS hy, count(*) AS n, round(ln(count(*)), 6) AS log_n FROM k GROUP BY 1, 2""")
def hexagons(spark: SparkSession, d: str) -> DataFrame:
    return distributions.hexbin(tables.track(spark, d), F.col("x") / 1000.0, F.col("y") / 10.0, 1.0).select("hx", "hy", "n", digits("log_n"))


# --- posture ----------------------------------------------------------------


@query(f"""WITH {POSTURE}, {CELLS} SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(covar_samp(a.a, b.a), 7) AS cov FROM cells a JOIN cells b ON a.frame = b.frame GROUP BY 1, 2""")
def posture_covariance(spark: SparkSession, d: str) -> DataFrame:
    return posture.covariance(tables.posture(spark, d)).select("i", "j", digits("cov", 7))


@query()
def explained_variance(spark: SparkSession, d: str) -> DataFrame:
    return posture.explained(spark, posture.modes(posture.covariance(tables.posture(spark, d)))[0])


_ENDS = f"""{POSTURE}, {CELLS}, q AS (SELECT strain, i, stddev_pop(a) AS sd FROM cells GROUP BY strain, i), e AS (SELECT strain, sum(sd) FILTER (WHERE i < 5) AS head_sd, sum(sd) FILTER (WHERE i >= 59) AS tail_sd FROM q GROUP BY strain)"""


@query(f"WITH {_ENDS} SELECT strain, round(head_sd, 7) AS head_sd, round(tail_sd, 7) AS tail_sd, round(head_sd / tail_sd, 6) AS ratio, CASE WHEN head_sd / tail_sd > 1.02 OR head_sd / tail_sd < 1 / 1.02::DOUBLE THEN 3 ELSE 0 END AS method, (head_sd / tail_sd > 1.02 OR head_sd / tail_sd < 1 / 1.02::DOUBLE) AND head_sd / tail_sd < 1 AS flip FROM e")
def head_by_variance(spark: SparkSession, d: str) -> DataFrame:
    rows = posture.end_variance(tables.posture(spark, d), ["strain"]).withColumn("h", headtail.by_variance(F.col("ratio"), 1.02))
    return rows.select("strain", digits("head_sd", 7), digits("tail_sd", 7), digits("ratio"), "h.method", "h.flip")


@query(f"""WITH {DERIVED}, g AS (SELECT track, count(*) FILTER (WHERE dpsi IS NOT NULL AND abs(dpsi) <= pi() / 2) AS n_head, count(*) FILTER (WHERE dpsi IS NOT NULL AND NOT abs(dpsi) <= pi() / 2) AS n_tail,
 median(s) AS s, avg(abs(vx)) AS hs, avg(100 * abs(vy)) AS ts FROM derived GROUP BY track),
h AS (SELECT *, s > 40 AND greatest(n_head, n_tail) > 0 AND coalesce(greatest(n_head, n_tail)::DOUBLE / nullif(least(n_head, n_tail), 0), 'inf'::DOUBLE) > 1.3 AS leads, greatest(hs, ts) / nullif(least(hs, ts), 0) > 1.1 AS ends FROM g)
SELECT track, n_head, n_tail, CASE WHEN leads THEN 1 WHEN ends THEN 2 ELSE -1 END AS method, CASE WHEN leads THEN n_tail > n_head WHEN ends THEN ts > hs ELSE false END AS flip FROM h""")
def head_by_motion(spark: SparkSession, d: str) -> DataFrame:
    rows = derived(spark, d)
    known, ahead = F.col("dpsi").isNotNull(), F.abs("dpsi") <= math.pi / 2
    ends = rows.groupBy("track").agg(F.median("s").alias("s"), F.avg(F.abs("vx")).alias("hs"), F.avg(100 * F.abs("vy")).alias("ts"))
    both = headtail.leading_counts(rows, ["track"], ahead, known).join(ends, "track")
    told = both.withColumn("h", headtail.by_motion(F.col("s"), F.col("n_head"), F.col("n_tail"), F.col("hs"), F.col("ts")))
    return told.select("track", "n_head", "n_tail", "h.method", "h.flip")


@query(f"""WITH {POSTURE}, x AS (SELECT strain AS track, frame, row_number() OVER (PARTITION BY strain ORDER BY frame) - 1 AS k, CAST(p[21] AS DOUBLE) AS a, CAST(p[31] AS DOUBLE) AS b FROM posture),
m AS (SELECT track, avg(a) AS ma, avg(b) AS mb, sqrt(var_pop(a) * var_pop(b)) AS s FROM x GROUP BY track), c AS (SELECT track, k, a - ma AS a, b - mb AS b, s FROM x JOIN m USING (track)),
l AS (SELECT p.track, q.k - p.k AS lag, avg(p.a * q.b) / max(p.s) AS ccf FROM c p JOIN c q ON p.track = q.track AND q.k - p.k BETWEEN -12 AND 11 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY ccf DESC, lag) AS rn FROM l) SELECT CAST(track AS BIGINT) AS track, round(lag / 11.5, 6) AS delay, round(ccf, 6) AS peak FROM r WHERE rn = 1""")
def body_wave(spark: SparkSession, d: str) -> DataFrame:
    """Lag of the highest correlation between two points of the body, in seconds."""
    rows = tables.posture(spark, d).select(F.col("strain").cast("long").alias("track"), (F.row_number().over(Window.partitionBy("strain").orderBy("frame")) - 1).alias("frame"), F.element_at("posture", 21).alias("a"), F.element_at("posture", 31).alias("b"))
    cc = lagstats.cross_correlation(rows, 12, "a", "b")
    best = cc.groupBy("track").agg(F.max_by(F.struct("lag", "ccf"), F.struct("ccf", -F.col("lag"))).alias("m"))
    return best.select("track", F.round(F.col("m.lag") / tables.FRAME_RATE, 6).alias("delay"), F.round("m.ccf", 6).alias("peak"))


@query(f"""WITH {POSTURE}, x AS (SELECT strain AS track, row_number() OVER (PARTITION BY strain ORDER BY frame) - 1 AS k, CAST(p[4] AS DOUBLE) AS h, CAST(p[62] AS DOUBLE) AS t FROM posture),
m AS (SELECT track, avg(h) AS mh, var_pop(h) AS vh, avg(t) AS mt, var_pop(t) AS vt FROM x GROUP BY track), c AS (SELECT track, k, h - mh AS h, vh, t - mt AS t, vt FROM x JOIN m USING (track)),
l AS (SELECT p.track, q.k - p.k AS lag, avg(p.h * q.h) / max(p.vh) AS ah, avg(p.t * q.t) / max(p.vt) AS tl FROM c p JOIN c q ON p.track = q.track AND q.k - p.k BETWEEN 1 AND 23 GROUP BY 1, 2)
SELECT CAST(track AS BIGINT) AS track, round(-(min(ah) - min(tl)), 6) AS move FROM l GROUP BY track""")
def head_moves(spark: SparkSession, d: str) -> DataFrame:
    """How much deeper the autocorrelation of the first end falls than that of the last."""
    at = (F.row_number().over(Window.partitionBy("strain").orderBy("frame")) - 1).alias("frame")
    rows = tables.posture(spark, d).select(F.col("strain").cast("long").alias("track"), at, F.element_at("posture", 4).alias("h"), F.element_at("posture", -3).alias("t"))
    lows = [lagstats.autocorrelation(rows, list(range(1, 24)), c).groupBy("track").agg(F.min("acf").alias(c)) for c in ("h", "t")]
    return lows[0].join(lows[1], "track").select("track", F.round(-(F.col("h") - F.col("t")), 6).alias("move"))


# --- ensembles --------------------------------------------------------------

_BAG = "SELECT o_orderstatus AS ensemble, o_custkey AS animal FROM orders WHERE o_orderpriority = '{0}'"


def _bag(spark: SparkSession, d: str, priority: str) -> DataFrame:
    return tables.read(spark, d, "orders").where(F.col("o_orderpriority") == priority).select(F.col("o_orderstatus").alias("ensemble"), F.col("o_custkey").alias("animal"))


@query(f"""WITH u AS ({_BAG.format("1-URGENT")} UNION ALL {_BAG.format("2-HIGH")}) SELECT ensemble, animal, count(*) AS n FROM u GROUP BY 1, 2""")
def ensemble_union(spark: SparkSession, d: str) -> DataFrame:
    both = ensembles.union(_bag(spark, d, "1-URGENT"), _bag(spark, d, "2-HIGH"))
    return both.groupBy("ensemble", "animal").agg(F.count("*").alias("n"))


@query(f"{_BAG.format('1-URGENT')} EXCEPT ALL {_BAG.format('2-HIGH')}")
def ensemble_difference(spark: SparkSession, d: str) -> DataFrame:
    return ensembles.difference(_bag(spark, d, "1-URGENT"), _bag(spark, d, "2-HIGH"))


@query(f"SELECT * FROM ({_BAG.format('1-URGENT')}) a WHERE NOT EXISTS (SELECT 1 FROM ({_BAG.format('2-HIGH')}) b WHERE a.ensemble = b.ensemble AND a.animal = b.animal)")
def ensemble_without(spark: SparkSession, d: str) -> DataFrame:
    return ensembles.without(_bag(spark, d, "1-URGENT"), _bag(spark, d, "2-HIGH"), ["ensemble", "animal"])


@query("""SELECT c_mktsegment AS ensemble, c_custkey AS animal, place FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS place FROM customer) WHERE place >= 5 AND place < 15""")
def ensemble_slice(spark: SparkSession, d: str) -> DataFrame:
    members = tables.read(spark, d, "customer").select(F.col("c_mktsegment").alias("ensemble"), F.col("c_custkey").cast("string").alias("animal"))
    placed = ensembles.members_between(ensembles.ordered(members, ensembles.numeric_order()), 5, 15)
    return placed.select("ensemble", F.col("animal").cast("long").alias("animal"), "place")


@query(f"WITH {TRACK} SELECT strain, count(DISTINCT track) AS tracks, count(*) AS frames FROM track GROUP BY strain")
def split_by_strain(spark: SparkSession, d: str) -> DataFrame:
    return tables.track(spark, d).groupBy("strain").agg(F.count_distinct("track").alias("tracks"), F.count("*").alias("frames"))


@query("""SELECT p_brand, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part WHERE p_size > 3 AND p_size < 40) WHERE r = 1""")
def largest_in_range(spark: SparkSession, d: str) -> DataFrame:
    return ensembles.largest(tables.read(spark, d, "part"), ["p_brand"], "p_size", 3, 40, "p_partkey").select("p_brand", "p_partkey", "p_size")


@query(f"""WITH {TRACK}, n AS (SELECT track, frame, x, count(*) OVER (PARTITION BY track) - 20 AS early FROM track)
SELECT track, frame, x FROM n WHERE frame >= early OR frame % greatest(ceil(early / 10.0), 1) = 0""")
def display_sample(spark: SparkSession, d: str) -> DataFrame:
    return ensembles.display_sample(tables.track(spark, d), 20, 10).select("track", "frame", "x")


@query(f"""WITH {TRACK}, v AS (SELECT strain, row_number() OVER (PARTITION BY strain ORDER BY track) - 1 AS place, sum(x) AS value FROM track GROUP BY strain, track), k AS (SELECT strain, count(*) AS n, sum(value) AS s FROM v GROUP BY strain),
w AS (SELECT strain, n, s, unnest(range(n)) AS sample FROM k), m AS (SELECT w.strain, (s - a.value + b.value) / n::DOUBLE AS m FROM w JOIN v a ON a.strain = w.strain AND a.place = (w.sample * 7) % n JOIN v b ON b.strain = w.strain AND b.place = (w.sample * 5 + 3) % n)
SELECT strain, round(avg(m), 3) AS mean, round(quantile_cont(m, 0.025), 3) AS low, round(quantile_cont(m, 0.975), 3) AS high FROM m GROUP BY strain""")
def one_swap_band(spark: SparkSession, d: str) -> DataFrame:
    """Bands over samples that each exchange one track, by a stated table of exchanges."""
    totals = tables.track(spark, d).groupBy("strain", "track").agg(F.sum("x").alias("value"))
    values = totals.withColumn("place", (F.row_number().over(Window.partitionBy("strain").orderBy("track")) - 1).cast("long"))
    sizes = values.groupBy("strain").agg(F.count("*").alias("n")).withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    swaps = sizes.select("strain", "sample", ((F.col("sample") * 7) % F.col("n")).alias("old"), ((F.col("sample") * 5 + 3) % F.col("n")).alias("new"))
    return ensembles.one_swap_band(values, swaps, ["strain"]).select("strain", digits("mean", 3), digits("low", 3), digits("high", 3))


@query(f"""WITH {TRACK}, v AS (SELECT strain, row_number() OVER (PARTITION BY strain ORDER BY track) - 1 AS place, avg(x) AS value FROM track GROUP BY strain, track), n AS (SELECT strain, count(*) AS n FROM v GROUP BY strain),
p AS (SELECT strain, n, sample, unnest(range(n)) AS i FROM (SELECT strain, n, unnest(range(100)) AS sample FROM n)), m AS (SELECT p.strain, sample, avg(value) AS m FROM p JOIN v ON v.strain = p.strain AND v.place = (i * i * 31 + sample * 17 + i * sample * 7 + 3) % n GROUP BY 1, 2)
SELECT strain, round(avg(m), 3) AS mean, round(quantile_cont(m, 0.025), 3) AS low, round(quantile_cont(m, 0.975), 3) AS high FROM m GROUP BY strain""")
def bootstrap_band(spark: SparkSession, d: str) -> DataFrame:
    """Bands over samples with replacement, by a stated table of draws."""
    means = tables.track(spark, d).groupBy("strain", "track").agg(F.avg("x").alias("value"))
    values = means.withColumn("place", (F.row_number().over(Window.partitionBy("strain").orderBy("track")) - 1).cast("long"))
    sizes = values.groupBy("strain").agg(F.count("*").alias("n"))
    drawn = sizes.withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long")))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    i, k = F.col("i"), F.col("sample")
    picks = drawn.select("strain", "sample", ((i * i * 31 + k * 17 + i * k * 7 + 3) % F.col("n")).alias("place"))
    return ensembles.bootstrap_of(values, picks, ["strain"]).select("strain", digits("mean", 3), digits("low", 3), digits("high", 3))


@query()
def hashed_bootstrap_band(spark: SparkSession, d: str) -> DataFrame:
    totals = tables.track(spark, d).groupBy("strain", "track").agg(F.avg("x").alias("value")).withColumnRenamed("track", "place")
    return ensembles.bootstrap_band(totals, ["strain"], 100)


# --- model fits -------------------------------------------------------------


@query("""WITH g AS (SELECT user_id, epoch_us(ts::TIMESTAMP) - lag(epoch_us(ts::TIMESTAMP)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
SELECT user_id AS track, round((avg(g) - min(g)) / 1e6, 3) AS scale, count(g) AS gaps FROM g GROUP BY user_id""")
def poisson_scale(spark: SparkSession, d: str) -> DataFrame:
    rows = models.poisson_scale(tables.irregular_track(spark, d), ["track"], "t")
    return rows.select("track", F.round(F.col("scale") / 1e6, 3).alias("scale"), "gaps")


@query(f"""WITH {TRACK}, p AS (SELECT track, CAST(x AS DOUBLE) AS y, CAST(lead(x) OVER W AS DOUBLE) AS z FROM track WINDOW {BOX}),
s AS (SELECT track, regr_slope(z, y) AS b, regr_intercept(z, y) AS a, regr_syy(z, y) AS szz, regr_sxy(z, y) AS szy, regr_count(z, y) AS n FROM p GROUP BY track)
SELECT track, round(b, 6) AS slope, round(a / (1 - b), 2) AS mu, round(1 / (1 - b), 6) AS tau, round(sqrt(greatest((szz - b * szy) / n, 0)), 2) AS sigma, CAST(n AS BIGINT) AS n FROM s""")
def mean_reverting_fit(spark: SparkSession, d: str) -> DataFrame:
    return models.mean_reverting_fit(tables.track(spark, d), ["track"], "x", 1.0).select("track", digits("slope"), digits("mu", 2), digits("tau"), digits("sigma", 2), "n")


@query(f"""WITH {TRACK}, s AS (SELECT track, regr_slope(CAST(x AS DOUBLE), CAST(frame AS DOUBLE)) AS k, regr_intercept(CAST(x AS DOUBLE), CAST(frame AS DOUBLE)) AS a, regr_syy(CAST(x AS DOUBLE), CAST(frame AS DOUBLE)) AS yy, regr_sxy(CAST(x AS DOUBLE), CAST(frame AS DOUBLE)) AS xy, count(*) AS n FROM track GROUP BY track)
SELECT track, round(k, 5) AS drift, round(a, 3) AS start, round((yy - k * xy) / n / 2 / 1e6, 6) AS diffusion, n FROM s""")
def drift_diffusion_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = models.drift_diffusion_fit(tables.track(spark, d), ["track"], "frame", "x", 1.0)
    return rows.select("track", digits("drift", 5), digits("start", 3), F.round(F.col("diffusion") / 1e6, 6).alias("diffusion"), "n")


@query(f"""WITH {TRACK}{WINDOWED.format("track")}, k AS (SELECT track, "window", regr_slope(CAST(x AS DOUBLE), CAST(frame AS DOUBLE)) AS k FROM ws GROUP BY 1, 2)
SELECT track, round(avg(abs(k)), 4) AS trend, count(k) AS windows FROM k GROUP BY track""")
def mean_abs_trend(spark: SparkSession, d: str) -> DataFrame:
    rows = masks.windows(tables.track(spark, d), 20)
    return models.mean_abs_trend(rows, ["track"], "window", "frame", "x").select("track", digits("trend", 4), "windows")


@query(f"""WITH {TRACK}, l AS (SELECT strain, 1.0 AS c0, CAST(lag(x) OVER W AS DOUBLE) / 1000 AS c1, CAST(lag(y) OVER W AS DOUBLE) AS c2, CAST(x AS DOUBLE) / 1000 AS d0, CAST(y AS DOUBLE) AS d1 FROM track WINDOW {BOX}), g AS (SELECT * FROM l WHERE c1 IS NOT NULL),
u AS (SELECT strain, count(*) AS n, {", ".join(f"sum({a} * {b}) AS s_{i}_{j}" for i, a in ((0, "c0"), (1, "c1"), (2, "c2"), (1000, "d0"), (1001, "d1")) for j, b in ((0, "c0"), (1, "c1"), (2, "c2"), (1000, "d0"), (1001, "d1")) if i <= j)} FROM g GROUP BY strain)
{" UNION ALL ".join(f"SELECT strain, n, {i} AS i, {j} AS j, round(s_{i}_{j}, 3) AS s FROM u" for i in (0, 1, 2, 1000, 1001) for j in (0, 1, 2, 1000, 1001) if i <= j)}""")
def autoregression_sums(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.track(spark, d).withColumns({"x": F.col("x") / 1000, "y": F.col("y").cast("double")})
    sums = models.autoregression_sums(rows, ["strain", "track"], ["x", "y"])
    return sums.groupBy("strain", "i", "j").agg(F.sum("n").alias("n"), F.round(F.sum("s"), 3).alias("s")).select("strain", "n", "i", "j", "s")


@query()
def posture_dynamics(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies and damping times of the first four modes of posture, one step ahead."""
    rows = _skeletons(spark, d)
    _, vectors = posture.modes(posture.covariance(rows.where("posture IS NOT NULL")))
    names = [f"m{k}" for k in range(4)]
    amplitudes = rows.select("track", "frame", *[posture.projection(F.col("posture"), vectors[:, k].tolist()).alias(m) for k, m in enumerate(names)])
    sums = models.autoregression_sums(models.normalised_modes(amplitudes, ["track"], names), ["track"], names)
    return models.autoregression(sums, ["track"], 4, 1, 1 / tables.FRAME_RATE)


@query()
def simulated_mean_reversion(spark: SparkSession, d: str) -> DataFrame:
    """Each track's x simulated anew: a mean-reverting process with its mean, deviation and correlation from frame to frame."""
    pairs = lagstats.lag_pairs(tables.track(spark, d), [1], ["x"])
    sums = pairs.groupBy("track").agg(F.avg("x0").alias("mu"), F.stddev_pop("x0").alias("sd"), F.corr("x0", "x1").alias("r"))
    tau = -1 / F.log(F.least(F.greatest(F.col("r"), F.lit(0.05)), F.lit(0.95)))
    parameters = sums.where("sd > 0").select("track", "mu", tau.alias("tau"), (F.col("sd") * F.sqrt(2 / tau)).alias("sigma"))
    return simulate.mean_reverting_of(parameters, 400, 0.1, seed=3)


@query()
def phase_surrogates(spark: SparkSession, d: str) -> DataFrame:
    return simulate.phase_surrogates(tables.track(spark, d), ["track"], "x", seed=3)


@query("""SELECT n_nationkey, round(exp(-n_nationkey / 3.0), 9) AS decay, round((1 - 0.4) * exp(-n_nationkey / 2.0) + 0.4, 9) AS curve, CASE WHEN n_nationkey * 5 > 60 THEN 50 WHEN n_nationkey * 5 > 40 THEN 30 WHEN n_nationkey * 5 > 20 THEN 15 ELSE 0 END AS points,
 printf('%02d:%02d:%02d', (n_nationkey * 977) // 3600, (n_nationkey * 977) // 60 % 60, (n_nationkey * 977) % 60) AS clock, CAST(pow(2, ceil(log2(n_nationkey + 1))) AS BIGINT) AS padded FROM nation""")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    return tables.read(spark, d, "nation").select(
        "n_nationkey", F.round(scalar.exponential_decay(n, 3.0), 9).alias("decay"), F.round(scalar.reversal_curve(n, 2.0, 0.4), 9).alias("curve"),
        scalar.posture_points(n * 5).alias("points"), scalar.clock(n * 977).alias("clock"), scalar.next_power_of_two(n + 1).alias("padded"),
    )


# --- joins by key, geometry and pixels --------------------------------------


@query("""SELECT o_orderstatus AS ensemble, c_mktsegment AS strain, count(*) AS members, count(DISTINCT c_custkey) AS tracks FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def ensemble_members(spark: SparkSession, d: str) -> DataFrame:
    """The bridge table of ensembles joined to the tracks that it names."""
    bridge = tables.read(spark, d, "orders").select(F.col("o_orderstatus").alias("ensemble"), F.col("o_custkey").alias("animal"))
    tracks = tables.read(spark, d, "customer").select(F.col("c_custkey").alias("animal"), F.col("c_mktsegment").alias("strain"))
    return bridge.join(tracks, "animal").groupBy("ensemble", "strain").agg(F.count("*").alias("members"), F.count_distinct("animal").alias("tracks"))


@query("""WITH g AS (SELECT DISTINCT o_orderstatus AS ensemble, o_custkey AS animal FROM orders WHERE o_orderpriority = '1-URGENT'), h AS (SELECT DISTINCT o_orderstatus AS ensemble, o_custkey AS animal FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))
SELECT NOT EXISTS (SELECT 1 FROM g WHERE NOT EXISTS (SELECT 1 FROM h WHERE g.ensemble = h.ensemble AND g.animal = h.animal)) AS within, NOT EXISTS (SELECT 1 FROM h WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.ensemble = h.ensemble AND g.animal = h.animal)) AS holds""")
def ensemble_comparison(spark: SparkSession, d: str) -> DataFrame:
    a = _bag(spark, d, "1-URGENT")
    b = ensembles.union(a, _bag(spark, d, "2-HIGH"))
    on = ["ensemble", "animal"]
    lacking = [ensembles.without(x, y, on).agg((F.count("*") == 0).alias(name)) for x, y, name in ((a, b, "within"), (b, a, "holds"))]
    return lacking[0].crossJoin(lacking[1])


@query("""SELECT l_suppkey AS track, count(*) FILTER (WHERE l_quantity <= 2 OR l_quantity + l_linenumber >= 50) AS touching, count(*) FILTER (WHERE l_extendedprice > 0.5::DOUBLE * 30000 AND l_extendedprice < 2::DOUBLE * 30000) AS plausible FROM lineitem GROUP BY 1""")
def border_and_length(spark: SparkSession, d: str) -> DataFrame:
    """Boxes within two units of the border, and lengths within half to twice the expected one."""
    left, right = F.col("width"), F.col("width") + F.col("part")
    touching = (left <= 2) | (right >= 50)
    plausible = (F.col("length") > 0.5 * 30_000) & (F.col("length") < 2.0 * 30_000)
    return tables.size(spark, d).groupBy("track").agg(F.count_if(touching).alias("touching"), F.count_if(plausible).alias("plausible"))


@query(f"""WITH {POSTURE}, q AS (SELECT strain AS track, frame, p, lag(p) OVER (PARTITION BY strain ORDER BY frame) AS o FROM posture),
e AS (SELECT track, frame, CAST(p[1] AS DOUBLE) AS hx, CAST(p[2] AS DOUBLE) AS hy, CAST(p[63] AS DOUBLE) AS tx, CAST(p[64] AS DOUBLE) AS ty, CAST(o[1] AS DOUBLE) AS px, CAST(o[2] AS DOUBLE) AS py, CAST(o[63] AS DOUBLE) AS qx, CAST(o[64] AS DOUBLE) AS qy FROM q)
SELECT CAST(track AS BIGINT) AS track, frame, (hx - qx) ** 2 + (hy - qy) ** 2 + (tx - px) ** 2 + (ty - py) ** 2 < (hx - px) ** 2 + (hy - py) ** 2 + (tx - qx) ** 2 + (ty - qy) ** 2 AS crossed FROM e""")
def crossed_ends(spark: SparkSession, d: str) -> DataFrame:
    """Whether head and tail lie nearer to the last frame's tail and head."""
    rows = tables.posture(spark, d).withColumn("track", F.col("strain").cast("long"))
    last = F.lag("posture").over(masks.by_frame())
    now = {c: F.element_at("posture", i) for c, i in (("hx", 1), ("hy", 2), ("tx", 63), ("ty", 64))}
    old = {c: F.element_at("last", i) for c, i in (("px", 1), ("py", 2), ("qx", 63), ("qy", 64))}
    ends = rows.withColumn("last", last).withColumns(now | old)
    return ends.select("track", "frame", headtail.nearest_ends(*[F.col(c) for c in ("hx", "hy", "tx", "ty", "px", "py", "qx", "qy")]).alias("crossed"))


@query(f"""WITH RECURSIVE {POSTURE}, {CELLS}, px AS (SELECT frame, CAST(i // 8 AS INTEGER) AS r, CAST(i % 8 AS INTEGER) AS c FROM cells WHERE a <= 0),
z AS (SELECT frame, r, c, r * 8 + c AS k FROM px UNION SELECT p.frame, p.r, p.c, z.k FROM z JOIN px p ON p.frame = z.frame AND abs(p.r - z.r) <= 1 AND abs(p.c - z.c) <= 1),
m AS (SELECT frame, r, c, min(k) AS k FROM z GROUP BY 1, 2, 3)
SELECT frame, CAST(k // 8 AS INTEGER) AS first_r, CAST(k % 8 AS INTEGER) AS first_c, count(*) AS area, round(avg(c), 6) AS x, round(avg(r), 6) AS y, max(c) - min(c) + 1 AS w, max(r) - min(r) + 1 AS h FROM m GROUP BY frame, k""")
def pixel_components(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding as an image of 8 by 8 pixels: the connected components of its pixels that are not positive."""
    cells = tables.posture(spark, d).select("frame", F.posexplode("posture").alias("i", "a"))
    image = cells.select("frame", F.expr("cast(i div 8 AS INT)").alias("r"), (F.col("i") % 8).alias("c"), F.when(F.col("a") > 0, 255).otherwise(0).alias("v"))
    parts = pixels.components(pixels.labelled(pixels.dark(image, 0.5)))
    return parts.select("frame", F.col("label.r").alias("first_r"), F.col("label.c").alias("first_c"), "area", digits("x"), digits("y"), "w", "h")


@query(f"""WITH {TRACK}, k AS (SELECT track, count(*) AS n, max(frame) AS last FROM track GROUP BY track) SELECT track, n, last, strftime(TIMESTAMP '1970-01-01' + to_seconds(CAST(floor(last / 11.5::DOUBLE) AS BIGINT)), '%H:%M:%S') AS duration FROM k""")
def track_keys(spark: SparkSession, d: str) -> DataFrame:
    """The tracks, with their length."""
    keys = tables.track(spark, d).groupBy("track").agg(F.count("*").alias("n"), F.max("frame").alias("last"))
    return keys.select("track", "n", "last", scalar.clock(F.col("last") / tables.FRAME_RATE).alias("duration"))


@query(f"""WITH {TRACK} SELECT strain, track, place FROM (SELECT strain, track, row_number() OVER (PARTITION BY strain ORDER BY xxx, track) - 1 AS place FROM (SELECT strain, track, max(x) AS xxx FROM track GROUP BY strain, track)) WHERE place < 5""".replace("xxx", "top"))
def first_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Of each strain the five tracks whose largest position is least."""
    tops = tables.track(spark, d).groupBy(F.col("strain").alias("ensemble"), "track").agg(F.max("x").alias("top"))
    placed = ensembles.members_between(ensembles.ordered(tops, "top", "track"), 0, 5)
    return placed.select(F.col("ensemble").alias("strain"), "track", "place")


# --- postures as a whole, all ordered pairs of strains -----------------------


@query(f"""WITH {POSTURE}, g AS (SELECT strain AS track, frame, list_transform(p, lambda e: CAST(e AS DOUBLE)) AS p FROM posture), l AS (SELECT *, lag(p) OVER W AS q FROM g WINDOW {BOX}),
m AS (SELECT track, frame, {" + ".join(f"abs(p[{i}] - q[{i}])" for i in range(1, 65))} AS a, {" + ".join(f"abs(p[{65 - i}] - q[{i}])" for i in range(1, 65))} AS b FROM l)
SELECT CAST(track AS BIGINT) AS track, frame, round(a / 64, 6) AS direct, round(b / 64, 6) AS flipped, sum(CASE WHEN b < a THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY frame ROWS UNBOUNDED PRECEDING) % 2 = 1 AS flip FROM m""")
def orientation(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.posture(spark, d).withColumn("track", F.col("strain").cast("long"))
    return sequences.orient(rows).select("track", "frame", digits("direct"), digits("flipped"), "flip")


@query(f"""WITH {POSTURE}, {CELLS} SELECT a.strain, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(covar_samp(a.a, b.a), 7) AS cov FROM cells a JOIN cells b ON a.frame = b.frame GROUP BY 1, 2, 3""")
def posture_covariance_by_strain(spark: SparkSession, d: str) -> DataFrame:
    return posture.covariance(tables.posture(spark, d), keys=["strain"]).select("strain", "i", "j", digits("cov", 7))


@query(f"""WITH {POSTURE} SELECT frame, round({" + ".join(f"CAST(p[{i + 1}] AS DOUBLE) * {1 / (i + 1)!r}" for i in range(64))}, 6) AS amplitude FROM posture""")
def posture_projection(spark: SparkSession, d: str) -> DataFrame:
    return tables.posture(spark, d).select("frame", F.round(posture.projection(F.col("posture"), [1 / (i + 1) for i in range(64)]), 6).alias("amplitude"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Each posture read as points: numbers in turn are x and y."""
    take = lambda first: F.transform(F.sequence(F.lit(first), F.size("posture") - 2 + first, F.lit(2)), lambda i: F.element_at("posture", i))
    return tables.posture(spark, d).select("frame", take(1).alias("xs"), take(2).alias("ys"))


@query(f"""WITH {POSTURE}, d AS (SELECT frame, unnest(range(1, 32)) AS i, p FROM posture) SELECT frame, round(sum(sqrt((CAST(p[2 * i + 1] AS DOUBLE) - p[2 * i - 1]) ** 2 + (CAST(p[2 * i + 2] AS DOUBLE) - p[2 * i]) ** 2)), 5) AS length FROM d GROUP BY frame""")
def skeleton_length(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).select("frame", F.round(scalar.arc_length(F.col("xs"), F.col("ys")), 5).alias("length"))


@query(f"""WITH {POSTURE}, k AS (SELECT frame, unnest(range(1, 33)) AS i, p FROM posture), e AS (SELECT frame, CAST(p[2 * i - 1] AS DOUBLE) AS x, CAST(p[2 * i] AS DOUBLE) AS y, CAST(p[2 * (i % 32) + 1] AS DOUBLE) AS u, CAST(p[2 * (i % 32) + 2] AS DOUBLE) AS v FROM k),
s AS (SELECT frame, sum(x * v - u * y) / 2 AS a, sum((x + u) * (x * v - u * y)) AS mx, sum((y + v) * (x * v - u * y)) AS my FROM e GROUP BY frame)
SELECT frame, round(abs(a), 7) AS area, round(mx / (6 * nullif(a, 0)), 2) + 0.0::DOUBLE AS cx, round(my / (6 * nullif(a, 0)), 2) + 0.0::DOUBLE AS cy FROM s""")
def contour_moments(spark: SparkSession, d: str) -> DataFrame:
    """Every polygon; no centroid where the area is 0."""
    found = _points(spark, d).select("frame", scalar.contour_area_and_centroid(F.col("xs"), F.col("ys")).alias("c"))
    return found.select("frame", F.round("c.area", 7).alias("area"), (F.round("c.x", 2) + F.lit(0.0)).alias("cx"), (F.round("c.y", 2) + F.lit(0.0)).alias("cy"))


@query(f"""WITH {TRACK}, c AS (SELECT strain, CAST(floor(x / 2500.0) AS BIGINT) AS bin, count(*) AS n FROM track GROUP BY 1, 2), f AS (SELECT strain, bin, n / sum(n) OVER (PARTITION BY strain)::DOUBLE AS f FROM c),
s AS (SELECT DISTINCT strain FROM c), k AS (SELECT a.strain AS a, b.strain AS b FROM s a JOIN s b ON a.strain <> b.strain), g AS (SELECT DISTINCT k.a, k.b, c.bin FROM k JOIN c ON c.strain IN (k.a, k.b)),
b AS (SELECT g.a, g.b, coalesce(p.f, 0) AS p, coalesce(q.f, 0) AS q, (coalesce(p.f, 0) + coalesce(q.f, 0)) / 2 AS m FROM g LEFT JOIN f p ON p.strain = g.a AND p.bin IS NOT DISTINCT FROM g.bin LEFT JOIN f q ON q.strain = g.b AND q.bin IS NOT DISTINCT FROM g.bin)
SELECT a, b, round(CASE WHEN count(*) FILTER (WHERE p > 0 AND q = 0) = 0 THEN sum(CASE WHEN p > 0 THEN p * log2(p / nullif(q, 0)) ELSE 0 END) END, 9) AS kl,
 round(CASE WHEN count(*) FILTER (WHERE p = 0) > 0 THEN 0.0 WHEN count(*) FILTER (WHERE p > 0 AND q = 0) = 0 THEN sum(CASE WHEN p > 0 THEN p * log2(p / nullif(q, 0)) ELSE 0 END) END, 9) AS kl_strict,
 round(sum((CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) / 2), 9) AS js FROM b GROUP BY a, b""")
def strain_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Every ordered pair of strains."""
    counts = tables.track(spark, d).groupBy("strain", F.floor(F.col("x") / 2500.0).alias("bin")).agg(F.count("*").alias("n"))
    strains = counts.select("strain").distinct()
    p = counts.withColumnRenamed("strain", "a").crossJoin(strains.withColumnRenamed("strain", "b")).where("a != b")
    q = counts.withColumnRenamed("strain", "b").crossJoin(strains.withColumnRenamed("strain", "a")).where("a != b")
    return distributions.divergences(p, q, keys=["a", "b"]).select("a", "b", digits("kl", 9), digits("kl_strict", 9), digits("js", 9))


# --- stores, skeletons and pixels ---------------------------------------------


def _folder(spark: SparkSession) -> str:
    return f"{store.shared_folder(spark)}/{uuid.uuid4().hex}"


def _observations(spark: SparkSession, d: str) -> DataFrame:
    """The sample tracks as stored observations; a position of 0 stays, a body angle of NaN stands for a missing one."""
    rows = tables.track(spark, d).withColumns({"video": F.concat(F.lit("v"), F.col("strain")), "animal": F.col("track").cast("string"), "time": F.col("frame") / tables.FRAME_RATE, "length": F.when(F.col("bad"), 0).otherwise(F.col("y") + 1), "body_angle": F.when(F.col("excluded"), float("nan")).otherwise(F.col("y") / 10), "bad_skeleton": "bad"})
    return store.conformed(rows.drop("strain").withColumns({"strain": F.col("kind")}), store.OBSERVATION)


@query(f"""WITH {TRACK} SELECT 'v' || strain AS video, kind AS strain, CAST(track AS VARCHAR) AS animal, count(*) AS n, round(sum(x / 0.05) / 7, 3) AS x, count(CASE WHEN NOT bad THEN 1 END) AS lengths, count(CASE WHEN NOT excluded THEN 1 END) AS angles FROM track GROUP BY 1, 2, 3""")
def stored_observations(spark: SparkSession, d: str) -> DataFrame:
    """Observations written and read: keys, positions in micrometres, stand-ins of missing values as NULL."""
    path = _folder(spark)
    store.write_observations(_observations(spark, d), path)
    rows = store.read_observations(spark, path)
    videos = store.tracks(rows).select("video").distinct().withColumn("pixels_per_micron", F.lit(0.05))
    scaled = store.in_micrometres(rows, videos)
    return scaled.groupBy(*store.KEYS).agg(F.count("*").alias("n"), F.round(F.sum("x") / 7, 3).alias("x"), F.count("length").alias("lengths"), F.count("body_angle").alias("angles"))


@query(f"""WITH {DERIVED} SELECT track, count(*) AS n, count(s) AS speeds, round(sum(s), 3) AS path, count(dpsi) AS headings, count(*) FILTER (WHERE oriented) AS oriented FROM derived GROUP BY track""")
def stored_derived(spark: SparkSession, d: str) -> DataFrame:
    """Derived tracks and their segments written and read; masked values stay NULL."""
    rows = derived(spark, d).withColumns({"video": F.lit("v"), "strain": F.col("strain").cast("string"), "animal": F.col("track").cast("string"), "t": F.col("frame") / tables.FRAME_RATE})
    path = _folder(spark)
    spans = sequences.islands(tables.track(spark, d), masks.centroid_valid()).withColumns({"video": F.lit("v"), "strain": F.lit("0"), "animal": F.col("track").cast("string")})
    store.write_derived(rows, spans, path)
    frames, _ = store.read_derived(spark, path)
    return frames.groupBy(F.col("animal").cast("long").alias("track")).agg(F.count("*").alias("n"), F.count("s").alias("speeds"), F.round(F.sum("s"), 3).alias("path"), F.count("dpsi").alias("headings"), F.count_if("oriented").alias("oriented"))


@query(f"""WITH {TRACK}, p AS (SELECT track, CASE WHEN max(y) > 95 THEN max(y) END AS a, CASE WHEN min(y) < 3 THEN min(y) END AS b FROM track GROUP BY track) SELECT track, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b FROM p WHERE a IS NOT NULL OR b IS NOT NULL""")
def stored_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Fitted numbers written and read; tracks without any are left out."""
    ends = tables.track(spark, d).groupBy("track").agg(F.max("y").alias("a"), F.min("y").alias("b"))
    path = _folder(spark)
    store.write_parameters(ends.select("track", F.when(F.col("a") > 95, F.col("a")).cast("double").alias("a"), F.when(F.col("b") < 3, F.col("b")).cast("double").alias("b")), path)
    return spark.read.parquet(path)


@query(f"""WITH {TRACK} SELECT a.track, 'drift' AS metric, CAST(b.frame - a.frame AS BIGINT) AS lag, CAST(b.frame - a.frame AS DOUBLE) AS tau, CAST(sum(b.x - a.x) AS DOUBLE) / count(*) AS value, count(*) AS windows
FROM track a JOIN track b ON a.track = b.track AND b.frame - a.frame BETWEEN 0 AND 5 GROUP BY 1, 3, 4""")
def stored_curves(spark: SparkSession, d: str) -> DataFrame:
    """Curves written and read as one long table."""
    curves = lagstats.drift(tables.track(spark, d), list(range(6)), "x").select("track", F.lit("drift").alias("metric"), "lag", F.col("lag").cast("double").alias("tau"), F.col("drift").alias("value"), F.col("pairs").alias("windows"))
    path = _folder(spark)
    store.write_curves(curves, path)
    return spark.read.parquet(path).select("track", "metric", "lag", "tau", "value", "windows")


@query("""SELECT n_name AS video, 'r' || n_regionkey AS strain, CAST(n_nationkey AS VARCHAR) AS animal, CAST(n_nationkey * 10 AS INTEGER) AS x, CAST(n_nationkey + 0.5 AS DOUBLE) AS radius, CAST(11.5 AS DOUBLE) AS frame_rate FROM nation""")
def stored_setup(spark: SparkSession, d: str) -> DataFrame:
    """Configurations of recordings written as YAML, read, written as tables, and read."""
    n = F.col("n_nationkey")
    nations = tables.read(spark, d, "nation")
    videos = store.conformed(nations.select(F.col("n_name").alias("video"), F.col("n_name").alias("file"), F.lit("s").alias("store"), F.lit(11.5).alias("frame_rate"), F.lit(0.05).alias("pixels_per_micron")), store.VIDEO)
    crop, food = F.struct((n * 10).alias("x"), n.alias("y"), F.lit(5).alias("w"), F.lit(6).alias("h")), F.struct(n.cast("double").alias("x"), n.cast("double").alias("y"), (n + 0.5).alias("r"))
    regions = store.conformed(nations.select(F.col("n_name").alias("video"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("strain"), n.cast("string").alias("animal"), crop.alias("crop"), food.alias("food")), store.REGION)
    path = _folder(spark)
    store.write_setup(*store.read_video_config(spark, store.video_config_as_yaml(videos, regions)), path)
    read_videos, read_regions = store.read_setup(spark, path)
    return read_regions.join(read_videos.select("video", "frame_rate"), "video").select("video", "strain", "animal", F.col("crop.x").alias("x"), F.col("food.r").alias("radius"), "frame_rate")


@query(f"""WITH {POSTURE}, b AS (SELECT strain, frame, p, frame % 5 = 0 AS bad FROM posture) SELECT strain, count(*) FILTER (WHERE NOT bad AND len(list_filter(p[1:3], lambda x: x > 0)) > 0) AS n_skeleton, count(*) AS n FROM b GROUP BY strain""")
def have_skeleton(spark: SparkSession, d: str) -> DataFrame:
    """Frames that are not bad with a positive one of three numbers."""
    rows = tables.posture(spark, d).withColumns({"bad": F.col("frame") % 5 == 0, "posture": F.slice("posture", 1, 3)})
    return rows.groupBy("strain").agg(F.count_if(masks.have_skeleton()).alias("n_skeleton"), F.count("*").alias("n"))


@query(f"""WITH {DERIVED} SELECT track, frame, round(atan2(vx, vy), 6) AS psi, round((atan2(vx, vy) + {PI}) - {TWO_PI} * floor((atan2(vx, vy) + {PI}) / {TWO_PI}) - {PI}, 6) AS wrapped_psi FROM derived""")
def body_bearing(spark: SparkSession, d: str) -> DataFrame:
    """Bearings from the y axis, as recordings have them of the body."""
    rows = derived(spark, d).select("track", "frame", scalar.body_bearing(F.col("vx"), F.col("vy")).alias("psi"))
    return rows.select("track", "frame", digits("psi"), F.round(scalar.wrapped(F.col("psi")), 6).alias("wrapped_psi"))


_CHAIN = f"""{POSTURE}, pt AS (SELECT frame, i, CAST(p[2 * i - 1] AS DOUBLE) AS x, CAST(p[2 * i] AS DOUBLE) AS y FROM (SELECT frame, p, unnest(range(1, 33)) AS i FROM posture))"""


@query(f"""WITH {_CHAIN}, r AS (SELECT frame, i, atan2(lead(y) OVER f - lag(y) OVER f, lead(x) OVER f - lag(x) OVER f) AS a FROM pt WINDOW f AS (PARTITION BY frame ORDER BY i)),
d AS (SELECT frame, i, a, a - lag(a) OVER (PARTITION BY frame ORDER BY i) AS d FROM r WHERE i BETWEEN 2 AND 31), u AS (SELECT frame, i, first_value(a) OVER w + coalesce(sum((d + {PI}) - {TWO_PI} * floor((d + {PI}) / {TWO_PI}) - {PI}) OVER w, 0) AS a FROM d WINDOW w AS (PARTITION BY frame ORDER BY i ROWS UNBOUNDED PRECEDING))
SELECT frame, CAST(i - 2 AS INTEGER) AS i, round(a - avg(a) OVER (PARTITION BY frame), 5) + 0.0::DOUBLE AS angle FROM u""")
def tangent_angles(spark: SparkSession, d: str) -> DataFrame:
    """Angles along each chain of points, unwrapped, less their mean."""
    rows = _points(spark, d).select("frame", F.posexplode(scalar.tangent_angles(F.col("xs"), F.col("ys"))).alias("i", "angle"))
    return rows.select("frame", "i", (F.round("angle", 5) + F.lit(0.0)).alias("angle"))


@query(f"""WITH {_CHAIN}, s AS (SELECT *, coalesce(sqrt((x - lag(x) OVER f) ** 2 + (y - lag(y) OVER f) ** 2), 0) AS step FROM pt WINDOW f AS (PARTITION BY frame ORDER BY i)),
c AS (SELECT *, sum(step) OVER (PARTITION BY frame ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto, sum(step) OVER (PARTITION BY frame) / 2 AS half FROM s), n AS (SELECT *, lead(upto) OVER f AS un, lead(x) OVER f AS xn, lead(y) OVER f AS yn FROM c WINDOW f AS (PARTITION BY frame ORDER BY i)),
m AS (SELECT frame, x + (half - upto) / (un - upto) * (xn - x) AS mx, y + (half - upto) / (un - upto) * (yn - y) AS my FROM n WHERE upto <= half AND un > half),
w AS (SELECT pt.frame, 2 * min(sqrt((x - mx) ** 2 + (y - my) ** 2)) / 0.05 AS width FROM pt JOIN m ON pt.frame = m.frame GROUP BY 1), e AS (SELECT frame, max(x) FILTER (WHERE i = 1) AS hx, max(y) FILTER (WHERE i = 32) AS ty FROM pt GROUP BY frame)
SELECT m.frame, round(mx, 6) AS mid_x, round(my, 6) AS mid_y, round(width, 5) AS width, round((hx + 3) / 0.05, 5) AS head_x, round((ty + 4) / 0.05, 5) AS tail_y FROM m JOIN w ON m.frame = w.frame JOIN e ON m.frame = e.frame""")
def skeleton_measures(spark: SparkSession, d: str) -> DataFrame:
    """Midpoint at half length, width at it, and the ends' places in the recording."""
    rows = _points(spark, d).withColumn("m", scalar.midpoint(F.col("xs"), F.col("ys")))
    return rows.select(
        "frame", F.round("m.x", 6).alias("mid_x"), F.round("m.y", 6).alias("mid_y"), F.round(scalar.body_width(F.col("m.x"), F.col("m.y"), F.col("xs"), F.col("ys"), 0.05), 5).alias("width"),
        F.round(scalar.end_position(F.col("xs"), 1, F.lit(3), 0.05), 5).alias("head_x"), F.round(scalar.end_position(F.col("ys"), -1, F.lit(4), 0.05), 5).alias("tail_y"),
    )


@query(f"""WITH {_CHAIN}, b AS (SELECT a.frame, a.i, p.x - a.x AS ux, p.y - a.y AS uy, q.x - a.x AS vx, q.y - a.y AS vy FROM pt a JOIN pt p ON p.frame = a.frame AND p.i = (a.i + 29) % 32 + 1 JOIN pt q ON q.frame = a.frame AND q.i = (a.i + 1) % 32 + 1)
SELECT frame, CAST(i - 1 AS INTEGER) AS i, round(acos(greatest(least((ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy)), 1.0), -1.0)), 5) AS angle FROM b""")
def boundary_angles(spark: SparkSession, d: str) -> DataFrame:
    """Angles at the points of closed outlines, two points to either side."""
    rows = _points(spark, d).select("frame", F.posexplode(scalar.boundary_angles(F.col("xs"), F.col("ys"))).alias("i", "angle"))
    return rows.select("frame", "i", digits("angle", 5))


@query("""SELECT n_nationkey, round(2.0 * 3.0 * exp(-n_nationkey / 3.0), 9) AS speed_curve, round(exp(-0.25 * n_nationkey), 9) AS bearing_curve, CAST(n_nationkey * n_nationkey * 4.0 / 2 AS DOUBLE) AS variance, n_nationkey - 7 AS cropped, n_nationkey + 7 AS whole,
 'N2 ' || n_nationkey AS label, round((log10(n_nationkey + 1.0) - 1) * 2 + (log10(n_regionkey + 2.0) - 0.5) * 3, 6) AS score, list_sort(list_filter([n_nationkey, n_nationkey + 1, n_nationkey + 2], lambda x: x <> n_regionkey)) AS remaining FROM nation""")
def model_scalars(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    return tables.read(spark, d, "nation").select(
        "n_nationkey", F.round(scalar.speed_curve(n, 2.0, 3.0), 9).alias("speed_curve"), F.round(scalar.bearing_curve(n, 0.25), 9).alias("bearing_curve"), scalar.stationary_variance(n, F.lit(4.0)).alias("variance"),
        scalar.cropped(n, F.lit(7)).alias("cropped"), scalar.uncropped(n, F.lit(7)).alias("whole"), scalar.label(F.lit("N2"), n.cast("string")).alias("label"),
        F.round(scalar.mode_score([n + 1.0, F.col("n_regionkey") + 2.0], [1.0, 0.5], [2.0, 3.0]), 6).alias("score"), F.array_sort(scalar.remaining(F.array(n, n + 1, n + 2), F.array("n_regionkey"))).alias("remaining"),
    )


def _image(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding as an image of 8 by 8 pixels, grey by its numbers."""
    cells = tables.posture(spark, d).select("frame", F.posexplode("posture").alias("i", "a"))
    return cells.select("frame", F.expr("cast(i div 8 AS INT)").alias("r"), (F.col("i") % 8).alias("c"), F.round((F.col("a") + 1) * 100).cast("int").alias("v"))


_IMAGE = f"""{POSTURE}, {CELLS}, im AS (SELECT frame, CAST(i // 8 AS INTEGER) AS r, CAST(i % 8 AS INTEGER) AS c, CAST(round((a + 1) * 100) AS INTEGER) AS v FROM cells)"""


@query(f"""WITH {_IMAGE}, z AS (SELECT * FROM im WHERE c >= 2 AND c < 7 AND r >= 1 AND r < 7), g AS (SELECT z.frame, z.r, z.c, z.v FROM z WHERE NOT (r - 1 = 3 AND c - 2 < 3)), m AS (SELECT frame, min(v) AS lo, max(v) AS hi FROM g GROUP BY frame)
SELECT g.frame, count(*) AS n, CAST(sum(CASE WHEN hi > lo THEN (v - lo) * 255 // (hi - lo) ELSE 0 END) AS BIGINT) AS grey FROM g JOIN m ON g.frame = m.frame GROUP BY 1""")
def pixel_masks(spark: SparkSession, d: str) -> DataFrame:
    """Crops of images, in which an ignored area is left out and grey is spread out."""
    cut = pixels.crop(_image(spark, d), 2, 1, 5, 6)
    ignored = spark.range(3).select(F.lit(3).alias("r"), F.col("id").cast("int").alias("c"))
    return pixels.normalised(pixels.ignoring(cut, ignored)).groupBy("frame").agg(F.count("*").alias("n"), F.sum("v").alias("grey"))


@query(f"""WITH {_IMAGE}, b AS (SELECT * FROM im WHERE v < 96), d AS (SELECT b.*, row_number() OVER (PARTITION BY frame, r, c ORDER BY (k - c) ** 2 + (k - r) ** 2, k) AS o, k FROM (SELECT b.*, unnest(range(0, 8)) AS k FROM b) b), n AS (SELECT * FROM d WHERE o = 1)
SELECT frame, median(v) FILTER (WHERE k < 1) AS first_grey, median(v) FILTER (WHERE k >= 7) AS last_grey FROM n GROUP BY frame""")
def end_brightness(spark: SparkSession, d: str) -> DataFrame:
    """Median grey of the body's pixels nearest to either end of a diagonal skeleton."""
    body = _image(spark, d).where("v < 96")
    line = F.lit([float(i) for i in range(8)])
    lines = body.select("frame").distinct().select("frame", line.alias("xs"), line.alias("ys"))
    return pixels.end_brightness(body, lines).select("frame", F.col("first").alias("first_grey"), F.col("last").alias("last_grey"))


@query(f"""WITH RECURSIVE {POSTURE}, {CELLS}, px AS (SELECT frame, CAST(i // 8 AS INTEGER) AS r, CAST(i % 8 AS INTEGER) AS c FROM cells WHERE a <= -0.05), z AS (SELECT frame, r, c, r * 8 + c AS k FROM px UNION SELECT p.frame, p.r, p.c, z.k FROM z JOIN px p ON p.frame = z.frame AND abs(p.r - z.r) <= 1 AND abs(p.c - z.c) <= 1),
m AS (SELECT frame, r, c, min(k) AS k FROM z GROUP BY 1, 2, 3), t AS (SELECT DISTINCT frame, k FROM m WHERE (r = 0 AND c = 0) OR (r = 4 AND c = 4)), o AS (SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.frame = m.frame AND t.k = m.k))
SELECT frame, count(*) AS n_pixels, count(DISTINCT k) AS n_objects FROM o GROUP BY frame""")
def passing_objects(spark: SparkSession, d: str) -> DataFrame:
    """Components of dark pixels that touch none of the pixels which are always dark."""
    cells = tables.posture(spark, d).select("frame", F.posexplode("posture").alias("i", "a")).where("a <= -0.05")
    labels = pixels.labelled(cells.select("frame", F.expr("cast(i div 8 AS INT)").alias("r"), (F.col("i") % 8).alias("c")))
    always = spark.createDataFrame([(0, 0), (4, 4)], "r int, c int")
    return pixels.not_persistent(labels, always).groupBy("frame").agg(F.count("*").alias("n_pixels"), F.count_distinct("label").alias("n_objects"))


@query(f"""WITH {TRACK}, q AS (SELECT track, frame, CASE WHEN y > 10 THEN CAST(x AS DOUBLE) END AS x FROM track), f AS (SELECT track, frame, lag(x) OVER W AS c, x AS d, max(frame) OVER (PARTITION BY track) AS last FROM q WINDOW {BOX}),
g AS (SELECT *, unnest(range(greatest(CAST(floor((frame - 20) / 2.0) AS BIGINT) + 1, 0), CAST(floor(frame / 2.0) AS BIGINT) + 1)) AS no FROM f)
SELECT track, no * 2 + 10 AS "window", count(*) AS n, sum(c * d) AS s FROM g WHERE no * 2 + 20 <= last + 1 AND c IS NOT NULL AND d IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 15""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    """Of windows that slide by a tenth, those with three quarters of their frames, with one of the sums of a regression."""
    rows = tables.track(spark, d).withColumn("x", F.when(F.col("y") > 10, F.col("x").cast("double")))
    sums = models.autoregression_windows(rows, ["track"], ["x"], 20)
    return sums.where("i = 1 AND j = 1000").select("track", "window", "n", "s")
