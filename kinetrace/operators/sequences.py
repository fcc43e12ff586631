"""Order-dependent steps along a track: as-of values, orientation, segments and reversals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinetrace.functions.scalar import mean_distance, mean_point_distance
from kinetrace.operators.masks import by_frame

BEFORE = (Window.unboundedPreceding, -1)
UPTO = (Window.unboundedPreceding, 0)
#: Runs of a track that are folded together.
BLOCK = 256


def last_good(rows: DataFrame, valid: Column, *columns: str) -> DataFrame:
    """rows with last_<column> of the latest earlier valid frame, and frames_since it. A window, not a join."""
    w = by_frame().rowsBetween(*BEFORE)
    held = rows.withColumn("__good", valid)
    out = {f"last_{c}": F.last(F.when(F.col("__good"), F.col(c)), ignorenulls=True).over(w) for c in columns}
    since = F.col("frame") - F.last(F.when(F.col("__good"), F.col("frame")), ignorenulls=True).over(w)
    return held.withColumns(out | {"frames_since": since}).drop("__good")


def orient(rows: DataFrame, posture: str = "posture") -> DataFrame:
    """rows with direct and flipped distance to the last posture, and flip: whether an odd number of frames so far turned round.

    Frames without a posture are passed over.
    """
    w = by_frame()
    last = F.last(posture, ignorenulls=True).over(w.rowsBetween(*BEFORE))
    seen = rows.withColumns({"direct": mean_point_distance(F.col(posture), last), "flipped": mean_point_distance(F.reverse(F.col(posture)), last)})
    turn = F.coalesce((F.col("flipped") < F.col("direct")).cast("int"), F.lit(0))
    seen = seen.withColumn("__turn", turn)
    return seen.withColumn("flip", F.sum("__turn").over(w.rowsBetween(*UPTO)) % 2 == 1).drop("__turn")


def orient_points(rows: DataFrame, xs: str = "xs", ys: str = "ys") -> DataFrame:
    """orient() for chains of points: mean Euclidean distance per point to the last chain, as it is and turned round."""
    w = by_frame()
    last = lambda c: F.last(c, ignorenulls=True).over(w.rowsBetween(*BEFORE))
    held = rows.withColumns({"__lx": last(xs), "__ly": last(ys)})
    lx, ly, x, y = F.col("__lx"), F.col("__ly"), F.col(xs), F.col(ys)
    seen = held.withColumns({"direct": mean_distance(x, y, lx, ly), "flipped": mean_distance(F.reverse(x), F.reverse(y), lx, ly)}).drop("__lx", "__ly")
    seen = seen.withColumn("__turn", F.coalesce((F.col("flipped") < F.col("direct")).cast("int"), F.lit(0)))
    return seen.withColumn("flip", F.sum("__turn").over(w.rowsBetween(*UPTO)) % 2 == 1).drop("__turn")


def apply_flip(rows: DataFrame, posture: str = "posture") -> DataFrame:
    return rows.withColumn(posture, F.when(F.col("flip"), F.reverse(F.col(posture))).otherwise(F.col(posture)))


def islands(rows: DataFrame, member: Column) -> DataFrame:
    """track, island, begin, end (exclusive) and n of each run of member rows without a gap."""
    w = by_frame()
    runs = rows.where(member).withColumn("island", F.col("frame") - F.row_number().over(w))
    return runs.groupBy("track", "island").agg(F.min("frame").alias("begin"), (F.max("frame") + 1).alias("end"), F.count("*").alias("n")).drop("island")


def greedy_segments(rows: DataFrame, present: Column, jump: Column, gap: int = 3, longest: int = 10_000, least: int = 150) -> DataFrame:
    """track, begin and end (exclusive) of stretches of consistent frames of more than least frames.

    From its first frame a segment goes on until a frame at which jump holds, until
    more than gap frames in a row are missing (not present; the last of them still
    belongs to it) or until it has longest frames; the next begins right there, be it in
    missing frames. A segment's own first frame counts neither as missing nor as a jump.

    Where a segment ends depends on where it began, but only at jumps and in runs
    of missing frames: windows cut each track into runs, and a fold over the runs, far
    fewer than the frames, does the rest. A jump begins anew whatever came before, so each stretch
    between jumps is a fold of its own; within it runs are folded BLOCK at a time, so that
    the work grows with the runs. Within a run the breaks are evenly spaced.
    """
    w = by_frame()
    flags = rows.select("track", "frame", F.coalesce(present, F.lit(False)).alias("__here"), F.coalesce(jump, F.lit(False)).alias("__jump"))
    flags = flags.withColumn("__jump", F.col("__jump") & F.col("__here"))
    cut = F.col("__jump") | (F.col("__here") != F.coalesce(F.lag("__here").over(w), ~F.col("__here")))
    runs = flags.withColumn("__run", F.sum(cut.cast("int")).over(w.rowsBetween(*UPTO))).groupBy("track", "__run").agg(
        F.min("frame").alias("start"), F.max("frame").alias("last"), F.min_by("__here", "frame").alias("here"), F.min_by("__jump", "frame").alias("jump")
    )
    by_run = Window.partitionBy("track").orderBy("start")
    runs = runs.withColumns({"__stretch": F.sum(F.col("jump").cast("int")).over(by_run.rowsBetween(*UPTO)), "next": F.lead("start").over(by_run)})
    lists = runs.groupBy("track", "__stretch").agg(F.array_sort(F.collect_list(F.struct("start", "last", "here", "next"))).alias("runs"))
    spans = "array<struct<begin:bigint,end:bigint>>"
    state = f"struct<begin:bigint,out:{spans}>"
    period = min(gap + 2, longest)
    none = F.array().cast(spans)

    def span(begin: Column, end: Column) -> Column:
        return F.when(end - begin > least, F.array(F.struct(begin.cast("bigint").alias("begin"), end.cast("bigint").alias("end")))).otherwise(none)

    def even(first: Column, many: Column, step: int) -> Column:
        """many spans of step frames from first on."""
        if step <= least:
            return none
        each = F.transform(F.sequence(F.lit(0).cast("bigint"), many - 1), lambda i: F.struct((first + i * step).cast("bigint").alias("begin"), (first + (i + 1) * step).cast("bigint").alias("end")))
        return F.when(many > 0, each).otherwise(none).cast(spans)

    def step(s: Column, r: Column) -> Column:
        # frames that are here: the length is cut
        many = F.floor((r["last"] - s["begin"]) / longest).cast("bigint")
        here = F.struct((s["begin"] + many * longest).alias("begin"), F.concat(s["out"], even(s["begin"], many, longest)).alias("out"))
        # missing frames: the first break, then one each period
        natural = F.when(s["begin"] == r["start"], s["begin"] + gap + 2).otherwise(r["start"] + gap + 1)
        first = F.least(natural, s["begin"] + longest)
        more = F.floor((r["last"] + 1 - first) / period).cast("bigint")
        away = F.when(first <= r["last"] + 1, F.struct((first + more * period).alias("begin"), F.concat(s["out"], span(s["begin"], first), even(first, more, period)).alias("out"))).otherwise(F.struct(s["begin"].alias("begin"), s["out"].alias("out")))
        return F.when(r["here"], here.cast(state)).otherwise(away.cast(state))

    def block(s: Column, i: Column) -> Column:
        begun = F.struct(s["begin"].alias("begin"), none.alias("out")).cast(state)
        folded = F.array(F.aggregate(F.slice("runs", i, F.lit(BLOCK)), begun, step))  # a lambda takes it once
        return F.element_at(F.transform(folded, lambda f: F.struct(f["begin"].alias("begin"), F.concat(s["out"], F.array(f["out"])).alias("out"))), 1)

    start = F.struct(F.element_at("runs", 1)["start"].cast("bigint").alias("begin"), F.array().cast(f"array<{spans}>").alias("out"))
    end = F.coalesce(F.element_at("runs", -1)["next"], F.element_at("runs", -1)["last"] + 1)
    blocks = F.sequence(F.lit(1), F.size("runs"), F.lit(BLOCK))
    folded = lists.select("track", F.aggregate(blocks, start, block, lambda s: F.concat(F.flatten(s["out"]), span(s["begin"], end))).alias("s"))
    return folded.select("track", F.inline("s"))


def segments_by_present(rows: DataFrame, present: Column, jump: Column, gap: int = 10, longest: int = 500, least: int = 150) -> DataFrame:
    """greedy_segments() of any length that have more than least frames present, with n, their number."""
    spans = greedy_segments(rows, present, jump, gap, longest, 0)
    held = in_segments(rows.select("track", "frame", F.coalesce(present, F.lit(False)).alias("__here")), spans)
    counts = held.where("begin IS NOT NULL AND __here").groupBy("track", "begin").agg(F.count("*").alias("n")).where(F.col("n") > least)
    return spans.join(counts, ["track", "begin"])


def in_segments(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """rows with the segment of the same track that holds their frame, NULL outside.

    Segments of a track do not overlap, so the latest begin so far is the only
    candidate: one union and one window instead of a range join.
    """
    extra = [c for c in segments.columns if c not in ("track", "begin", "end")]
    marks = segments.select("track", F.col("begin").alias("frame"), F.struct("begin", "end", *extra).alias("__seg"))
    both = rows.withColumn("__seg", F.lit(None).cast(marks.schema["__seg"].dataType)).withColumn("__row", F.lit(1)).unionByName(marks.withColumn("__row", F.lit(0)), allowMissingColumns=True)
    held = both.withColumn("__seg", F.last("__seg", ignorenulls=True).over(Window.partitionBy("track").orderBy("frame", "__row").rowsBetween(*UPTO))).where("__row = 1")
    inside = F.col("frame") < F.col("__seg.end")
    return held.select(*rows.columns, *[F.when(inside, F.col(f"__seg.{c}")).alias(c) for c in (*extra, "begin")])


def reversals(rows: DataFrame, state: Column) -> DataFrame:
    """track, begin and end of stretches of backward motion.

    state is 0 (unknown), 1 (forward) or 2 (backward). Backward motion starts at
    two 2s in a row; it ends at two 1s in a row or at any 0. The first frame and the
    last two start and end nothing; what has not ended by then is left out. A begin right
    after a 0, and an end at a 0, is not known: NULL.

    Each start or end is an event at its first frame, and the latest event so far
    tells the motion: a forward fill, then runs without gaps.
    """
    w = by_frame()
    stated = rows.select("track", "frame", state.alias("s"))
    stated = stated.withColumns({"__next": F.lead("s").over(w), "__last": F.lag("s").over(w), "__left": F.lead("s", 2).over(w)})
    event = F.when((F.col("s") == 2) & (F.col("__next") == 2), 1).when((F.col("s") == 0) | ((F.col("s") == 1) & (F.col("__next") == 1)), 0)
    marked = stated.withColumn("__event", F.when(F.col("__last").isNotNull() & F.col("__left").isNotNull(), event))
    filled = marked.withColumn("__back", F.coalesce(F.last("__event", ignorenulls=True).over(w.rowsBetween(*UPTO)) == 1, F.lit(False)))
    backward = filled.where("__back").withColumn("__run", F.col("frame") - F.row_number().over(w))
    runs = backward.groupBy("track", "__run").agg(
        F.min("frame").alias("__from"), (F.max("frame") + 1).alias("__to"), F.min_by("__last", "frame").alias("__before"), F.max_by("__next", "frame").alias("__after"), F.count_if(F.col("__next").isNull()).alias("__open")
    )
    known = lambda at, s: F.when(F.col(s) != 0, F.col(at))
    return runs.where("__open = 0").select("track", known("__from", "__before").alias("begin"), known("__to", "__after").alias("end"))


def near_boundaries(rows: DataFrame, intervals: DataFrame, within: int) -> DataFrame:
    """rows with near: a known begin or end of the track's intervals lies fewer than within frames away.

    The nearest boundary before and after each frame comes from one window over
    rows and boundaries together, instead of a range join.
    """
    edges = intervals.select("track", F.explode(F.array_compact(F.array("begin", "end"))).alias("frame"))
    both = rows.withColumn("__edge", F.lit(None).cast("long")).unionByName(edges.withColumn("__edge", F.col("frame")), allowMissingColumns=True)
    w = Window.partitionBy("track").orderBy("frame").rangeBetween
    before = F.max("__edge").over(w(Window.unboundedPreceding, 0))
    after = F.min("__edge").over(w(0, Window.unboundedFollowing))
    marked = both.withColumns({"__before": before, "__after": after}).where(F.col("__edge").isNull())
    near = (F.col("frame") - F.col("__before") < within) | (F.col("__after") - F.col("frame") < within)
    return marked.withColumn("near", F.coalesce(near, F.lit(False))).select(*rows.columns, "near")
