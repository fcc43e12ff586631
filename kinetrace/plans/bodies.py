"""Queries of dynamics per window, heads per segment, smoothed skeletons and expected sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.functions import scalar
from kinetrace.operators import ensembles, headtail, models, posture, sequences, skeletons, splines
from kinetrace.plans import chains, frames
from kinetrace.plans import queries as plans
from kinetrace.plans.queries import BOX, ORACLE_SQL, SEGMENTED, TRACK, digits, query
from kinetrace.sources import tables

DT = 1 / tables.FRAME_RATE


@query(f"""WITH {TRACK}, q AS (SELECT track, frame, CASE WHEN y > 10 THEN CAST(x AS DOUBLE) END AS x FROM track), z AS (SELECT track, frame, (x - avg(x) OVER (PARTITION BY track)) / stddev_pop(x) OVER (PARTITION BY track) AS x FROM q),
f AS (SELECT track, frame, lag(x) OVER W AS c, x AS d, max(frame) OVER (PARTITION BY track) AS last FROM z WINDOW {BOX}),
g AS (SELECT *, unnest(range(greatest(CAST(floor((frame - 30) / 3.0) AS BIGINT) + 1, 0), CAST(floor(frame / 3.0) AS BIGINT) + 1)) AS no FROM f),
s AS (SELECT track, no * 3 + 15 AS "window", count(*) AS n, sum(c * d) / sum(c * c) AS w, sum(c * c) AS cc, sum(c * d) AS cd, sum(d * d) AS dd, sum(c) AS c, sum(d) AS d FROM g WHERE no * 3 + 30 <= last + 1 AND c IS NOT NULL AND d IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 22.5)
SELECT track, "window", round(CASE WHEN w < 0 THEN 11.5 / 2 ELSE 0.0 END, 6) AS frequency, round(-sign(w) / (ln(abs(w)) * 11.5), 6) AS damping, round(sqrt(((dd - 2 * w * cd + w * w * cc) / n - ((d - w * c) / n) ** 2) * 11.5), 6) AS noise FROM s""")
def window_dynamics(spark: SparkSession, d: str) -> DataFrame:
    """Dynamics of one normalised series in windows that slide by a tenth: frequency, damping time and residual scale."""
    rows = tables.track(spark, d).withColumn("x", F.when(F.col("y") > 10, F.col("x").cast("double")))
    sums = models.autoregression_windows(models.normalised_modes(rows, ["track"], ["x"]), ["track"], ["x"], 30)
    return models.dynamics(sums, ["track", "window"], 1, DT).select("track", "window", digits("frequency"), digits("damping"), digits("noise"))


@query()
def posture_window_dynamics(spark: SparkSession, d: str) -> DataFrame:
    """Dynamics of the first four modes of posture in windows of 40 frames."""
    rows = plans._skeletons(spark, d)
    _, vectors = posture.modes(posture.covariance(rows.where("posture IS NOT NULL")))
    names = [f"m{k}" for k in range(4)]
    amplitudes = rows.select("track", "frame", *[posture.projection(F.col("posture"), vectors[:, k].tolist()).alias(m) for k, m in enumerate(names)])
    sums = models.autoregression_windows(models.normalised_modes(amplitudes, ["track"], names), ["track"], names, 40, least_present=0.5)
    return models.dynamics(sums, ["track", "window"], 4, DT)


@query(f"""WITH RECURSIVE {SEGMENTED}, tp AS (SELECT track, frame, CASE WHEN flip THEN list_reverse(p) ELSE p END AS p FROM fr), se AS (SELECT * FROM sg WHERE "end" - "begin" > 3),
av AS (SELECT s.track, s."begin", s."end", unnest(range(1, 65)) AS i, unnest(p) AS a FROM se s JOIN tp t ON t.track = s.track AND t.frame >= s."begin" AND t.frame < s."end" WHERE p IS NOT NULL),
sd AS (SELECT track, "begin", "end", i, stddev_pop(a) AS sd FROM av GROUP BY ALL), ra AS (SELECT track, "begin", "end", sum(sd) FILTER (WHERE i <= 6) / nullif(sum(sd) FILTER (WHERE i > 58), 0) AS ratio FROM sd GROUP BY ALL)
SELECT track, "begin", "end", round(ratio, 6) AS ratio, CASE WHEN ratio > 1.2 OR ratio < 1 / 1.2::DOUBLE THEN 3 ELSE 0 END AS method, coalesce((ratio > 1.2 OR ratio < 1 / 1.2::DOUBLE) AND ratio < 1, false) AS flip FROM ra""")
def segment_head_by_variance(spark: SparkSession, d: str) -> DataFrame:
    """Of each segment the end whose angles vary more, by a tenth of the angles at either end."""
    turned, segments = chains._oriented_segments(plans._skeletons(spark, d), least=3, **plans.CUTS)
    held = sequences.in_segments(turned, segments).where("begin IS NOT NULL AND posture IS NOT NULL")
    found = posture.end_variance(held, ["track", "begin"], points=6).join(segments.select("track", "begin", "end"), ["track", "begin"])
    return found.withColumn("h", headtail.by_variance(F.col("ratio"))).select("track", "begin", "end", digits("ratio"), "h.method", "h.flip")


_MIDDLE = f"""WITH RECURSIVE {SEGMENTED}, tq AS (SELECT track, frame, flip, p, list_sum(list_transform(range(1, 33), lambda i: p[2 * i - 1])) / 32 AS x, list_sum(list_transform(range(1, 33), lambda i: p[2 * i])) / 32 AS y, p[31] AS mx, p[32] AS my FROM fr), se AS (SELECT * FROM sg WHERE "end" - "begin" > 3),
te AS (SELECT *, CASE WHEN flip THEN p[63] ELSE p[1] END - mx AS hx, CASE WHEN flip THEN p[64] ELSE p[2] END - my AS hy, CASE WHEN flip THEN p[1] ELSE p[63] END - mx AS tx, CASE WHEN flip THEN p[2] ELSE p[64] END - my AS ty, (lead(x) OVER W - lag(x) OVER W) * 11.5 / 2 AS vx, (lead(y) OVER W - lag(y) OVER W) * 11.5 / 2 AS vy FROM tq WINDOW {BOX}),
ts AS (SELECT s.track, s."begin", s."end", t.* EXCLUDE (track), (lead(hx) OVER S - lag(hx) OVER S) * 11.5 / 2 AS hu, (lead(hy) OVER S - lag(hy) OVER S) * 11.5 / 2 AS hv, (lead(tx) OVER S - lag(tx) OVER S) * 11.5 / 2 AS tu, (lead(ty) OVER S - lag(ty) OVER S) * 11.5 / 2 AS tv
 FROM se s JOIN te t ON t.track = s.track AND t.frame >= s."begin" AND t.frame < s."end" WINDOW S AS (PARTITION BY s.track, s."begin" ORDER BY t.frame)),
tg AS (SELECT track, "begin", "end", median(sqrt(vx * vx + vy * vy)) AS speed, count(*) FILTER (WHERE cos(atan2(hy, hx) - atan2(vy, vx)) > cos(atan2(ty, tx) - atan2(vy, vx))) AS n_first,
 count(*) FILTER (WHERE cos(atan2(ty, tx) - atan2(vy, vx)) > cos(atan2(hy, hx) - atan2(vy, vx))) AS n_last, avg(sqrt(hu * hu + hv * hv)) AS fs, avg(sqrt(tu * tu + tv * tv)) AS ls, avg(200 + 100 * p[5]) AS g1, avg(200 + 100 * p[60]) AS g2 FROM ts GROUP BY 1, 2, 3),
th AS (SELECT *, coalesce(speed, 0) > 40 AND greatest(n_first, n_last) > 0 AND coalesce(greatest(n_first, n_last)::DOUBLE / nullif(least(n_first, n_last), 0), 'inf'::DOUBLE) > 1.3 AS leads, greatest(coalesce(fs, 0), coalesce(ls, 0)) / nullif(least(coalesce(fs, 0), coalesce(ls, 0)), 0) > 1.1 AS ends,
 (g1 - g2) / nullif(g1, 0) > 0.02 AS bright1, (g2 - g1) / nullif(g2, 0) > 0.02 AS bright2 FROM tg)
SELECT track, "begin", "end", round(speed, 6) AS speed, n_first, n_last, round(fs, 6) AS first_speed, round(ls, 6) AS last_speed, """


def _from_middle(spark: SparkSession, d: str) -> DataFrame:
    """Skeletons with their centroid and a midpoint, the sixteenth of 32 points."""
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    return plans._skeletons(spark, d).withColumns({"x": mean("xs"), "y": mean("ys"), "mx": F.element_at("xs", 16), "my": F.element_at("ys", 16)})


@query(_MIDDLE + "CASE WHEN leads THEN 1 WHEN ends THEN 2 ELSE -1 END AS method, CASE WHEN leads THEN n_last > n_first WHEN ends THEN ls > fs ELSE false END AS flip FROM th")
def head_and_tail_from_midpoint(spark: SparkSession, d: str) -> DataFrame:
    """Which end leads in each segment: directions and speeds of the ends against the body's midpoint."""
    found = chains.head_and_tail_by_motion(_from_middle(spark, d), DT, least=3, **plans.CUTS)
    return found.select("track", "begin", "end", digits("speed"), "n_first", "n_last", digits("first_speed"), digits("last_speed"), "method", "flip")


@query(_MIDDLE + """CASE WHEN leads THEN 1 WHEN ends THEN 2 WHEN bright1 OR bright2 THEN 3 ELSE -1 END AS method, CASE WHEN leads THEN n_last > n_first WHEN ends THEN ls > fs WHEN bright1 THEN false WHEN bright2 THEN true ELSE false END AS flip FROM th""")
def head_and_tail_with_brightness(spark: SparkSession, d: str) -> DataFrame:
    """As from the midpoint, and by the brighter end where motion tells nothing."""
    rows = _from_middle(spark, d)
    grey = lambda i: F.avg(200 + 100 * F.element_at("posture", i))
    shown = rows.groupBy("track", "frame").agg(grey(5).alias("first"), grey(60).alias("last"))
    found = chains.head_and_tail_by_motion(rows, DT, least=3, brightness=shown, least_grey=0.02, **plans.CUTS)
    return found.select("track", "begin", "end", digits("speed"), "n_first", "n_last", digits("first_speed"), digits("last_speed"), "method", "flip")


@query("""SELECT p_partkey, round(p_retailprice * 0.05, 6) AS length, round(p_size * 2 * 0.05, 6) AS width, round(p_retailprice * 0.05 * (p_size * 2 * 0.05), 6) AS area,
CASE WHEN p_retailprice * 0.05 > 60 THEN 50 WHEN p_retailprice * 0.05 > 40 THEN 30 WHEN p_retailprice * 0.05 > 20 THEN 15 ELSE 0 END AS points FROM part""")
def expected_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes in pixels of bodies of so many micrometres, and how many angles they carry."""
    sizes = scalar.expected_pixels(F.col("p_retailprice"), F.col("p_size") * F.lit(2.0), F.lit(0.05))
    return tables.read(spark, d, "part").withColumn("e", sizes).select("p_partkey", F.round("e.length", 6).alias("length"), F.round("e.width", 6).alias("width"), F.round("e.area", 6).alias("area"), "e.points")


@query(f"""SELECT track, metric, lag, tau, value, windows FROM ({ORACLE_SQL["correlation_table"]}) UNION ALL SELECT track, 's_dist' AS metric, CAST(speed / 1000 AS BIGINT) AS lag, speed AS tau, density AS value, CAST(1 AS BIGINT) AS windows FROM ({ORACLE_SQL["speed_distribution"]})""")
def metric_bundle(spark: SparkSession, d: str) -> DataFrame:
    """All seven metrics of each track in one table: six curves and the density of speed."""
    rows = chains.with_reversals(plans.derived(spark, d), 3)
    table = chains.metric_bundle(rows, list(range(8)), 20, [1000.0 * i for i in range(20)], 0.3, 1.0, 20)
    scales = plans._SCALES | {"s_dist": (1e-4, 6)}
    value = F.coalesce(*[F.when(F.col("metric") == m, F.round(F.col("value") / k, n)) for m, (k, n) in scales.items()])
    return table.select("track", "metric", "lag", "tau", (value + F.lit(0.0)).alias("value"), "windows")


@query()
def averaged_speed_curves(spark: SparkSession, d: str) -> DataFrame:
    """A curve given by the user, averaged over the tracks of each strain, with its band: the mean squared speed by quarters of a track."""
    rows = plans.derived(spark, d).select("track", "strain", "frame", "s").where("s IS NOT NULL")
    quarters = lambda part: part.assign(q=(4 * (part["frame"] - part["frame"].min()) // (part["frame"].max() - part["frame"].min() + 1))).groupby("q")["s"].apply(lambda s: float((s * s).mean()))
    return ensembles.ensemble_average(rows, quarters, ["strain"], samples=50)


@query()
def smoothed_skeletons(spark: SparkSession, d: str) -> DataFrame:
    """Skeletons of the sample postures smoothed to 16 places, with the middle and their angles."""
    rows = plans._skeletons(spark, d).where("xs IS NOT NULL").withColumn("s", splines.smoothed(F.col("xs"), F.col("ys"), 14, 0.01))
    return rows.select("track", "frame", digits_of("s.mid_x"), digits_of("s.mid_y"), digits_of("s.length"), F.size(scalar.tangent_angles(F.col("s.xs"), F.col("s.ys"))).alias("n_angles"))


def digits_of(column: str):
    return F.round(F.col(column), 6).alias(column.split(".")[-1])


@query()
def smoothed_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths through the largest body of each frame, smoothed, with the width of the body at their middle."""
    body, path = frames.largest_bodies(spark, d)
    chains_ = splines.chains_of(path).withColumn("s", splines.smoothed(F.col("xs"), F.col("ys"), 15))
    middle = chains_.select("frame", F.col("s.mid_x").alias("x"), F.col("s.mid_y").alias("y"), F.col("s.length").alias("length"))
    wide = skeletons.width_at(middle, body)
    return middle.join(wide, "frame").select("frame", digits("x"), digits("y"), digits("length"), digits("width"))
