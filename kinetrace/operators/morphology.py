"""Grey and binary morphology of frames, as windows over rows and columns of pixels.

A frame is dense: one row (frame, r, c, v) for each of its pixels; a binary frame has v 1
for the body and 0 elsewhere. A structuring element is a list of row runs (dr, lo,
hi). A maximum over it is taken in two steps: of each run within the pixel's row
(a window along c), then of those over the element's rows (a window along
r). The window's unit is a row or a column of one frame, so large frames spread
over the cluster, and only one number for each pixel is shuffled, twice.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from kinetrace.operators import pixels
from kinetrace.sources.store import dealt, kept

Element = list[tuple[int, int, int]]


def _row() -> WindowSpec:
    return Window.partitionBy("frame", "r").orderBy("c")


def _column() -> WindowSpec:
    return Window.partitionBy("frame", "c").orderBy("r")


def box(height: int, width: int) -> Element:
    """A rectangle whose centre is at half its height and width, rounded down."""
    return [(i - height // 2, -(width // 2), width - 1 - width // 2) for i in range(height)]


def ellipse(height: int, width: int) -> Element:
    """An ellipse filling a box of that size; an even size has its centre to the right and below."""
    y, x = height // 2, width // 2
    runs = []
    for dr in range(-y, height - y):
        if abs(dr) <= y:
            reach = round(x * sqrt(1 - (dr / y) ** 2)) if y else x
            runs.append((dr, -reach, min(reach, width - 1 - x)))
    return runs


def _over(frames: DataFrame, element: Element, extreme: str) -> DataFrame:
    """v becomes the extreme (max or min) of the element's pixels; those outside the frame do not count."""
    pick, both = (F.max, F.greatest) if extreme == "max" else (F.min, F.least)
    spans = sorted({(lo, hi) for _, lo, hi in element})
    along = frames.withColumns({f"__{i}": pick("v").over(_row().rangeBetween(lo, hi)) for i, (lo, hi) in enumerate(spans)})
    met = [pick(f"__{spans.index((lo, hi))}").over(_column().rangeBetween(dr, dr)) for dr, lo, hi in element]
    return along.withColumn("v", both(*met) if len(met) > 1 else met[0]).drop(*[f"__{i}" for i in range(len(spans))])


def dilated(frames: DataFrame, element: Element) -> DataFrame:
    return _over(frames, element, "max")


def eroded(frames: DataFrame, element: Element) -> DataFrame:
    return _over(frames, element, "min")


def closed(frames: DataFrame, element: Element) -> DataFrame:
    return eroded(dilated(frames, element), element)


def opened(frames: DataFrame, element: Element) -> DataFrame:
    return dilated(eroded(frames, element), element)


def background_removed(frames: DataFrame, radius: int, depth: int = 255) -> DataFrame:
    """depth less how much the closing by an ellipse of radius + 1 pixels across brightens the pixel: dark spots narrower than that stay dark, all else turns white."""
    disk = ellipse(radius + 1, radius + 1)
    return closed(frames.withColumn("__v", F.col("v")), disk).withColumn("v", depth - (F.col("v") - F.col("__v"))).drop("__v")


def thresholded(frames: DataFrame, threshold: float, depth: int = 255) -> DataFrame:
    """Binary frames: 1 where the pixel is not brighter than threshold of the depth."""
    return frames.withColumn("v", (F.col("v") <= depth * threshold).cast("int"))


def _marked(frames: DataFrame, chosen: DataFrame, inside: int, v: int) -> DataFrame:
    """frames with v at those of the pixels of value inside which chosen (frame, r, c) names."""
    named = chosen.select("frame", "r", "c", F.lit(True).alias("__chosen"))
    marked = frames.join(dealt(named), ["frame", "r", "c"], "left")
    return marked.withColumn("v", F.when(F.col("__chosen") & (F.col("v") == inside), v).otherwise(F.col("v")).cast("int")).drop("__chosen")


def _reaching(frames: DataFrame, value: int, height: int, width: int, eight: bool) -> tuple[DataFrame, DataFrame]:
    """(labels of the pixels of a value, labels among them that touch the frame's border)."""
    labels = pixels.labelled(frames.where(F.col("v") == value).select("frame", "r", "c"), eight)
    edge = F.col("r").isin(0, height - 1) | F.col("c").isin(0, width - 1)
    return labels, labels.where(edge).select("frame", "label").distinct()


def border_cleared(frames: DataFrame, height: int, width: int) -> DataFrame:
    """Without the bodies (pixels joined at sides or corners) that touch the border."""
    labels, touching = _reaching(frames, 1, height, width, True)
    return _marked(frames, labels.join(dealt(touching), ["frame", "label"], "left_semi"), 1, 0)


def filled(frames: DataFrame, height: int, width: int) -> DataFrame:
    """With the holes filled: background, joined at sides only, that does not reach the border."""
    labels, outside = _reaching(frames, 0, height, width, False)
    return _marked(frames, labels.join(dealt(outside), ["frame", "label"], "left_anti"), 0, 1)


def majority(frames: DataFrame) -> DataFrame:
    """1 where at least four of the eight neighbours are 1; beyond the border the frame is mirrored."""
    beside = lambda v, w: F.coalesce(F.lag(v).over(w), v) + F.coalesce(F.lead(v).over(w), v)
    v = F.col("v")
    across = frames.withColumn("__three", v + beside(v, _row()))
    three = F.col("__three")
    return across.withColumn("v", (three + beside(three, _column()) - v >= 4).cast("int")).drop("__three")


def neighbourhoods(frames: DataFrame, name: str = "hood") -> DataFrame:
    """frames with the code of each pixel's 3 by 3 neighbourhood: nine bits row by row, the first the highest; 0 beyond the border."""
    at = lambda v, w: (F.coalesce(F.lag(v).over(w), F.lit(0)), v, F.coalesce(F.lead(v).over(w), F.lit(0)))
    a, b, c = at(F.col("v"), _row())
    across = frames.withColumn("__row", (a * 4 + b * 2 + c).cast("int"))
    a, b, c = at(F.col("__row"), _column())
    return across.withColumn(name, (a * 64 + b * 8 + c).cast("int")).drop("__row")


def hood(*rows: str) -> int:
    """The code of a neighbourhood drawn as three rows of 0 and 1."""
    return int("".join(rows), 2)


# A pixel of 0 between two pixels of 1 that meet at a corner, all other neighbours 0.
DIAGONAL = (hood("010", "100", "000"), hood("000", "100", "010"), hood("000", "001", "010"), hood("010", "001", "000"))


def hits(frames: DataFrame, hoods: tuple[int, ...]) -> DataFrame:
    """hit-or-miss: frames with hit, whether the neighbourhood is exactly one of hoods."""
    return neighbourhoods(frames, "__hood").withColumn("hit", F.col("__hood").isin(*hoods)).drop("__hood")


def diagonals_filled(frames: DataFrame) -> DataFrame:
    """1 also where a pixel joins two others that meet only at a corner."""
    return hits(frames, DIAGONAL).withColumn("v", (F.col("hit") | (F.col("v") == 1)).cast("int")).drop("hit")


def inverted(frames: DataFrame) -> DataFrame:
    return frames.withColumn("v", 1 - F.col("v"))


def cleaned(frames: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """Binary frames without bodies at the border, closed by a disk as wide as the body, with holes filled, parts that barely touch put right and the background's diagonals filled.

    What is labelled and then marked is stored first: it is read twice.
    """
    disk = ellipse(radius + 1, radius + 1)
    apart = border_cleared(kept(frames, "dark"), height, width)
    whole = filled(kept(closed(apart, disk), "closed"), height, width)
    return inverted(diagonals_filled(inverted(majority(whole))))


def distances(frames: DataFrame) -> DataFrame:
    """frames with squared, the exact squared distance of each body pixel to the nearest background pixel (0 outside the body, NULL in a frame without background).

    First along the column, by the last background row on either side; then along
    the row, where no pixel farther than the distance so far can be nearer.
    """
    blank = F.when(F.col("v") == 0, F.col("r"))
    above = F.col("r") - F.last(blank, True).over(_column().rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(blank, True).over(_column().rowsBetween(0, Window.unboundedFollowing)) - F.col("r")
    down = frames.select("frame", "r", "c", "v", F.least(above, below).alias("g"))
    rows = down.groupBy("frame", "r").agg(F.array_sort(F.collect_list(F.struct("c", "v", "g"))).alias("row"))
    size = F.size("row")

    def nearest(cell: Column, i: Column) -> Column:
        reach = F.coalesce(cell["g"], size)
        around = F.sequence(F.greatest(i - reach, F.lit(0)), F.least(i + reach, size - 1))
        return F.array_min(F.transform(around, lambda j: (i - j) * (i - j) + F.get("row", j)["g"] * F.get("row", j)["g"]))

    found = rows.select("frame", "r", F.inline(F.transform("row", lambda cell, i: F.struct(cell["c"].alias("c"), cell["v"].alias("v"), nearest(cell, i).cast("long").alias("squared")))))
    return found.select("frame", "r", "c", "v", "squared")
