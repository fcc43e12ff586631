"""Chains of operators: derived tracks, correlation tables and model fits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinetrace.functions.scalar import bearing, speed, wrapped
from kinetrace.operators import distributions, headtail, kinematics, lagstats, masks, models, posture, sequences
from kinetrace.sources import store


def derived_track(rows: DataFrame, dt: float, heading: Column | None = None) -> DataFrame:
    """rows (track, frame, x, y, bad, oriented, excluded) with vx, vy, s, phi, and dpsi against a body heading psi.

    Positions that are not valid are NULL, and so is whatever needs them. All
    windows share one partitioning by track and one order by frame.
    """
    valid = masks.masked(rows, masks.centroid_valid(), "x", "y")
    moving = valid.withColumns({f"v{c}": kinematics.centred_difference(c, dt) for c in ("x", "y")})
    moving = moving.withColumns({"s": speed(F.col("vx"), F.col("vy")), "phi": F.when((F.col("vx") != 0) | (F.col("vy") != 0), bearing(F.col("vx"), F.col("vy")))})
    psi = heading if heading is not None else F.lag("phi").over(masks.by_frame())
    moving = moving.withColumn("psi", F.when(F.col("oriented"), psi))
    return moving.withColumn("dpsi", wrapped(F.col("phi") - F.col("psi")))


def motion_state() -> Column:
    """0 where the motion is unknown, 1 forward, 2 backward: motion against the body's heading."""
    return F.when(F.col("dpsi").isNull(), 0).when(F.abs(F.col("dpsi")) > math.pi / 2, 2).otherwise(1)


def with_reversals(rows: DataFrame, within: int) -> DataFrame:
    """rows with near: fewer than within frames from the start or end of backward motion."""
    return sequences.near_boundaries(rows, sequences.reversals(rows, motion_state()), within)


def _oriented_only(rows: DataFrame) -> DataFrame:
    """rows without the motion of frames in which head and tail are not told apart."""
    return masks.masked(rows, F.col("oriented"), "x", "y", "vx", "vy", "s") if "oriented" in rows.columns else rows


def _off_reversals(rows: DataFrame) -> Column:
    return F.when(~F.col("near"), F.col("s")) if "near" in rows.columns else F.col("s")


METRICS = ("msd", "vacf", "s_acf", "psi_acf", "dpsi_acf", "psi_trend")


def _sufficient(rows: DataFrame, window: int, least_present: float) -> DataFrame:
    """rows once for each window of enough frames with a known speed."""
    listed = masks.windows(rows, window)
    present = F.count(F.col("s")).over(Window.partitionBy("track", "window")) / F.count("*").over(Window.partitionBy("track", "window"))
    return listed.withColumn("__present", present).where(F.col("__present") > least_present).drop("__present")


def correlation_table(rows: DataFrame, lags: list[int], window: int, least_present: float = 0.5, dt: float = 1.0) -> DataFrame:
    """track, metric, lag, tau, value, windows: each curve of METRICS per window of enough valid frames, then the mean over windows.

    rows: derived_track(), with near from with_reversals(). Frames near a reversal
    do not count for the speed; a pair across an excluded frame counts for nothing.
    msd: squared displacement; vacf, psi_acf, dpsi_acf: products of velocities and
    of the unit vectors of both angles; s_acf: covariance of speed; psi_trend: size of
    the mean turn. All curves come from one pass over the pairs.
    """
    kept = _sufficient(kinematics.unwrap(_oriented_only(rows), "psi", "__turned"), window, least_present).withColumn("__free", _off_reversals(rows))
    kept = kept.withColumn("__ds", F.col("__free") - F.avg("__free").over(Window.partitionBy("track", "window")))
    for a in ("psi", "dpsi"):
        kept = kept.withColumns({f"__c{a}": F.cos(a), f"__s{a}": F.sin(a)})
    keys = ["track", "window"]
    excluded = F.col("excluded") if "excluded" in rows.columns else None
    pairs = lagstats.lag_pairs(kept, lags, ["x", "y", "vx", "vy", "__ds", "__cpsi", "__spsi", "__cdpsi", "__sdpsi", "__turned"], keys, excluded)
    change = lambda c: F.col(f"{c}1") - F.col(f"{c}0")
    product = lambda c: F.col(f"{c}1") * F.col(f"{c}0")
    curves = pairs.groupBy(*keys, "lag").agg(
        F.avg(change("x") * change("x") + change("y") * change("y")).alias("msd"),
        F.avg(product("vx") + product("vy")).alias("vacf"),
        F.avg(product("__ds")).alias("s_acf"),
        F.avg(product("__cpsi") + product("__spsi")).alias("psi_acf"),
        F.avg(product("__cdpsi") + product("__sdpsi")).alias("dpsi_acf"),
        F.abs(F.avg(change("__turned"))).alias("psi_trend"),
    )
    means = curves.groupBy("track", "lag").agg(*[F.struct(F.avg(m).alias("value"), F.count(m).alias("windows")).alias(m) for m in METRICS])
    table = means.select("track", "lag", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}.value").alias("value"), F.col(f"{m}.windows").alias("windows")) for m in METRICS])))
    return table.select("track", "metric", "lag", (F.col("lag") * dt).alias("tau"), "value", "windows")


def speed_density(rows: DataFrame, points: list[float], least: int = 101) -> DataFrame:
    """track, point and density of the speed off reversals, over whole tracks with least values or more."""
    return distributions.kde(_oriented_only(rows).withColumn("__free", _off_reversals(rows)), "__free", points, ["track"], least)


def metric_bundle(rows: DataFrame, lags: list[int], window: int, points: list[float], least_present: float = 0.5, dt: float = 1.0, least: int = 101) -> DataFrame:
    """All seven metrics of each track in one long table: correlation_table() and, as s_dist, the density of speed (tau is the speed, windows 1)."""
    places = F.create_map(*[x for i, p in enumerate(points) for x in (F.lit(float(p)), F.lit(i).cast("long"))])
    density = speed_density(rows, points, least).select("track", F.lit("s_dist").alias("metric"), places[F.col("point")].alias("lag"), F.col("point").alias("tau"), F.col("density").alias("value"), F.lit(1).cast("long").alias("windows"))
    return correlation_table(rows, lags, window, least_present, dt).unionByName(density)


PARAMETERS = ("mu_s", "tau_s", "d_s", "k_psi", "d_psi", "tau_forward", "tau_reverse", "length")


def with_food_and_edge(rows: DataFrame, arena: DataFrame, mode: str | None = None, margin: int | None = None, share: float = 1.1) -> DataFrame:
    """rows whose excluded marks frames off the food (mode on_food), on it (off_food), and within margin of the box's border; mode replaces earlier marks, margin adds to them."""
    placed = masks.with_arena(rows, arena)
    on = F.coalesce(masks.on_food(share), F.lit(False))
    excluded = {"on_food": ~on, "off_food": on}.get(mode, F.col("excluded"))
    if margin is not None:
        excluded = excluded | F.coalesce(masks.near_edge(margin), F.lit(False))
    return placed.withColumn("excluded", excluded).select(rows.columns)


def fit_model(rows: DataFrame, lags: list[int], window: int, least_present: float = 0.1, dt: float = 1.0, within: int = 3, least_trend: float = 0.2, heading: Column | None = None) -> DataFrame:
    """track and PARAMETERS: mean speed off reversals, the speed's and the bearing's fits, the mean turning rate of windows, the two stays, the median length.

    rows: track, frame, x, y, bad, oriented, excluded and maybe length. A track with
    a share of least_present valid frames or less has NULL parameters, as has what cannot be fitted.
    """
    moving = with_reversals(derived_track(rows, dt, heading), within)
    curves = correlation_table(moving, lags, window, 0.5, dt).where(F.col("metric").isin("dpsi_acf", "psi_acf", "s_acf"))
    curves = store.kept(curves, "curves")  # three fits read it
    of = lambda metric: curves.where(F.col("metric") == metric)
    turned = masks.windows(kinematics.unwrap(moving, "psi", "__turned").withColumn("__t", F.col("frame") * dt), window)
    share = F.count("__turned").over(Window.partitionBy("track", "window")) / F.count("*").over(Window.partitionBy("track", "window"))
    trend = models.mean_abs_trend(turned.withColumn("__share", share).where(F.col("__share") > least_trend), ["track"], "window", "__t", "__turned")
    length = F.median(F.when(F.col("length") > 0, F.col("length"))) if "length" in rows.columns else F.lit(None).cast("double")
    whole = moving.groupBy("track").agg(F.avg(F.when(~F.col("near"), F.col("s"))).alias("mu_s"), (F.count(F.when(F.col("oriented"), F.col("s"))) / F.count("*")).alias("__share"), length.alias("length"))
    reversal = models.reversal_rates(models.fit_curve(of("dpsi_acf"), ["track"], "tau", "value", "reversal")).select("track", "tau_forward", "tau_reverse")
    heading = models.fit_curve(of("psi_acf"), ["track"], "tau", "value", "bearing").select("track", F.col("diffusion").alias("d_psi"))
    pace = models.fit_curve(of("s_acf"), ["track"], "tau", "value", "speed").select("track", F.col("diffusion").alias("d_s"), F.col("tau").alias("tau_s"))
    found = whole.join(trend.select("track", F.col("trend").alias("k_psi")), "track", "left")
    for part in (reversal, heading, pace):
        found = found.join(part, "track", "left")
    return found.select("track", *[F.when(F.col("__share") > least_present, F.col(p)).alias(p) for p in PARAMETERS])


def head_and_tail(rows: DataFrame, jump: float, gap: int = 3, longest: int = 10_000, least: int = 150, near: int = 4, front: int = 21, back: int = 31, rate: float = 11.5, **limits: float) -> DataFrame:
    """track, begin, end, ratio, delay, move, method and flip: which end leads in each segment, by posture.

    rows: track, frame, xs, ys (the skeleton's points) and posture (its angles), all
    NULL where there is no valid skeleton. Skeletons are oriented like their last one,
    segments break where they lie jump or more apart. ratio is that of the ends'
    variances over the whole track; delay is the lag of the highest correlation between
    two places of the body (front and back), move how much deeper the
    autocorrelation of the first end falls (angle near from either end), both per segment.
    """
    frames, segments = _oriented_segments(rows, jump, gap, longest, least)
    held = sequences.in_segments(frames, segments).where("begin IS NOT NULL")  # missing frames too: lags count frames
    ratio = posture.end_variance(frames.where("posture IS NOT NULL"), ["track"]).select("track", "ratio")
    angle = lambda i: F.try_element_at("posture", F.lit(i))
    parts = held.select("track", "begin", "frame", angle(near).alias("h"), angle(-near + 1).alias("t"), angle(front).alias("a"), angle(back).alias("b"))
    keys = ["track", "begin"]
    cc = lagstats.cross_correlation(parts, 12, "a", "b", keys)
    wave = cc.where("ccf IS NOT NULL").groupBy(*keys).agg((F.max_by("lag", F.struct("ccf", -F.col("lag"))) / rate).alias("delay"))
    found = segments.join(ratio, "track", "left").join(wave, keys, "left")
    for c in ("h", "t"):
        low = lagstats.autocorrelation(parts, list(range(1, 24)), c, keys).groupBy(*keys).agg(F.min("acf").alias(f"__{c}"))
        found = found.join(low, keys, "left")
    found = found.withColumn("move", F.col("__t") - F.col("__h")).drop("__h", "__t")
    told = headtail.by_posture(F.coalesce("ratio", F.lit(1.0)), F.coalesce("delay", F.lit(0.0)), F.coalesce("move", F.lit(0.0)), **limits)
    return found.withColumn("__h", told).select(*keys, "end", "ratio", "delay", "move", "__h.method", "__h.flip")


def _oriented_segments(rows: DataFrame, jump: float, gap: int, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Frames with skeletons turned like their last one, and their segments."""
    seen = sequences.orient_points(rows)
    segments = sequences.greedy_segments(seen, F.col("xs").isNotNull(), F.least("direct", "flipped") >= jump, gap, longest, least)
    turn = lambda c: F.when(F.col("flip"), F.reverse(F.col(c))).otherwise(F.col(c)).alias(c)
    kept = [c for c in rows.columns if c not in ("xs", "ys", "posture")]
    return seen.select(*kept, turn("xs"), turn("ys"), turn("posture")), segments


def head_first(rows: DataFrame, told: DataFrame, jump: float, gap: int = 3, longest: int = 10_000, least: int = 150) -> DataFrame:
    """rows with skeleton and posture from head to tail and oriented (whether a segment with a method holds the frame); told: as of head_and_tail() or head_and_tail_by_motion()."""
    frames, _ = _oriented_segments(rows, jump, gap, longest, least)
    held = sequences.in_segments(frames, told.select("track", "begin", "end", "method", "flip"))
    turned = F.coalesce((F.col("method") > 0) & F.col("flip"), F.lit(False))
    turn = lambda c: F.when(turned, F.reverse(F.col(c))).otherwise(F.col(c)).alias(c)
    kept = [c for c in frames.columns if c not in ("xs", "ys", "posture")]
    return held.select(*kept, turn("xs"), turn("ys"), turn("posture"), F.coalesce(F.col("method") > 0, F.lit(False)).alias("oriented"))


def head_and_tail_by_motion(rows: DataFrame, dt: float, jump: float, gap: int = 3, longest: int = 10_000, least: int = 150, brightness: DataFrame | None = None, least_grey: float = 0.2, **limits: float) -> DataFrame:
    """track, begin, end, speed, n_first, n_last, first_speed, last_speed, method and flip: which end leads in each segment, by motion.

    rows: track, frame, x, y (centroid), xs, ys, posture; NULL where not valid. An
    end leads in a frame if its direction from the origin is nearer to that of the
    motion. Speeds of the ends are those of the points against the origin, which is
    the body's midpoint if rows have it (mx, my), else the centroid.
    brightness: track, frame, first, last (grey values of both ends), for a third rule.
    """
    frames, segments = _oriented_segments(rows, jump, gap, longest, least)
    held = sequences.in_segments(frames, segments)
    origin = {c: f"m{c}" if f"m{c}" in rows.columns else c for c in "xy"}
    ends = {f"{e}{c}": F.try_element_at(f"{c}s", F.lit(i)) - F.col(origin[c]) for e, i in (("h", 1), ("t", -1)) for c in ("x", "y")}
    ends = held.withColumns(ends | {f"v{c}": kinematics.centred_difference(c, dt) for c in ("x", "y")})
    w = Window.partitionBy("track", "begin").orderBy("frame")
    moves = lambda c: (F.lead(c).over(w) - F.lag(c).over(w)) / (2 * dt)
    motion = ends.withColumns({f"{e}v{c}": moves(f"{e}{c}") for e in "ht" for c in "xy"}).where("begin IS NOT NULL")
    pace = speed(F.col("vx"), F.col("vy"))
    aligned = lambda e: F.cos(F.atan2(f"{e}y", f"{e}x") - F.atan2("vy", "vx"))
    found = motion.groupBy("track", "begin").agg(
        F.median(pace).alias("speed"), F.count_if(aligned("h") > aligned("t")).alias("n_first"), F.count_if(aligned("t") > aligned("h")).alias("n_last"),
        F.avg(speed(F.col("hvx"), F.col("hvy"))).alias("first_speed"), F.avg(speed(F.col("tvx"), F.col("tvy"))).alias("last_speed"),
    )
    found = segments.join(found, ["track", "begin"])
    told = headtail.by_motion(*[F.coalesce(c, F.lit(0)) for c in ("speed", "n_first", "n_last", "first_speed", "last_speed")], **limits)
    if brightness is not None:
        grey = sequences.in_segments(brightness, segments.select("track", "begin", "end")).where("begin IS NOT NULL").groupBy("track", "begin").agg(F.avg("first").alias("__first"), F.avg("last").alias("__last"))
        found = found.join(grey, ["track", "begin"], "left")
        told = headtail.by_brightness(told, F.col("__first"), F.col("__last"), least_grey)
    return found.withColumn("__h", told).select(*[c for c in found.columns if not c.startswith("__")], "__h.method", "__h.flip")
