"""Which frames count: flags, masks, slices and windows of tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_frame(*order: str) -> Window:
    return Window.partitionBy("track").orderBy(*(order or ("frame",)))


def flag_bad_size(rows: DataFrame, length: tuple[float, float] = (0.9, 1.1), width: tuple[float, float] = (0.7, 1.3)) -> DataFrame:
    """rows with bad: length or width missing, zero, or outside its band around the track's median of the measured frames.

    The medians are one row per track, joined back; each holds the distinct values of its track in one buffer (distributions.medians() does not).
    """
    measured = F.coalesce((F.col("length") != 0) & (F.col("width") != 0), F.lit(False))
    medians = rows.where(measured).groupBy("track").agg(F.median("length").alias("mid_length"), F.median("width").alias("mid_width"))
    inside = F.col("length").between(length[0] * F.col("mid_length"), length[1] * F.col("mid_length")) & F.col("width").between(width[0] * F.col("mid_width"), width[1] * F.col("mid_width"))
    return rows.join(medians, "track", "left").withColumn("bad", ~F.coalesce(measured & inside, F.lit(False)))


def flag_bad_speed(rows: DataFrame, limit: Column | float) -> DataFrame:
    """rows with too_fast: the centred difference (in units per two frames) is over twice the limit; never at the ends."""
    w = by_frame()
    dx, dy = (F.lead(c).over(w) - F.lag(c).over(w) for c in ("x", "y"))
    return rows.withColumn("too_fast", F.coalesce(dx * dx + dy * dy > 4 * limit * limit, F.lit(False)))


def centroid_valid() -> Column:
    return ~F.col("bad") & ~F.col("excluded") & F.col("x").isNotNull() & F.col("y").isNotNull()


def posture_valid() -> Column:
    return F.col("oriented") & ~F.col("bad") & ~F.col("excluded")


def have_skeleton(posture: str = "posture") -> Column:
    """A frame that is not bad and whose skeleton has a point above 0."""
    return F.coalesce(F.exists(posture, lambda x: x > 0), F.lit(False)) & ~F.col("bad")


def masked(rows: DataFrame, valid: Column, *columns: str) -> DataFrame:
    """rows with NULL in the columns where they are not valid."""
    return rows.withColumns({c: F.when(valid, F.col(c)) for c in columns})


def frame_slice(rows: DataFrame, begin: int, end: int) -> DataFrame:
    """Frames in [begin, end)."""
    if begin < 0:
        raise ValueError("a slice begins at frame 0 or later")
    return rows.where((F.col("frame") >= begin) & (F.col("frame") < end))


def time_slice(rows: DataFrame, begin: float, end: float, rate: float) -> DataFrame:
    """Frames from begin to end seconds, both rounded to whole frames."""
    return frame_slice(rows, int(begin * rate + 0.5), int(end * rate + 0.5))


def windows(rows: DataFrame, size: int, overlap: float = 0.5) -> DataFrame:
    """Each row once for every window of size frames that holds it, with window (its number).

    A track of n frames has round(n / size / (1 - overlap)) windows; the last may be partial.
    """
    step = max(1, round(size * (1 - overlap)))
    last = F.floor(F.col("frame") / step)
    first = F.greatest(F.floor((F.col("frame") - size) / step) + 1, F.lit(0))
    length = F.max("frame").over(Window.partitionBy("track")) + 1
    count = F.floor(length / F.lit(float(step)) + 0.5).cast("long")
    listed = rows.withColumn("__n", count).withColumn("window", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    return listed.where("window < __n").drop("__n")


def present_fraction(rows: DataFrame, valid: Column, *keys: str) -> DataFrame:
    """keys, n and present, the share of rows that are valid."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), (F.count_if(valid) / F.count("*")).alias("present"))


def with_arena(rows: DataFrame, arena: DataFrame) -> DataFrame:
    """rows with the parameters of their strain's arena."""
    return rows.join(arena, "strain")


def on_food(share: float = 1.1) -> Column:
    """Within share food radii of the food's centre."""
    dx, dy = F.col("x") - F.col("food_x"), F.col("y") - F.col("food_y")
    return dx * dx + dy * dy <= F.col("food_r") * F.col("food_r") * (share * share)


def near_edge(margin: int) -> Column:
    """Within margin of the crop box's border, or outside it."""
    x, y = F.col("x") - F.col("box_x"), F.col("y") - F.col("box_y")
    return (x < margin) | (y < margin) | (x > F.col("box_w") - margin) | (y > F.col("box_h") - margin)


def entirely_missing(rows: DataFrame, valid: Column) -> DataFrame:
    """Tracks without a valid frame."""
    return rows.groupBy("track").agg(F.bool_or(valid).alias("any_valid")).where("NOT any_valid").select("track")
