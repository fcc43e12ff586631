"""From frames to measured bodies: the chain of image operators, for many animals in one frame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.functions import scalar
from kinetrace.operators import morphology, pixels, skeletons, splines
from kinetrace.sources.store import dealt, kept


@dataclass(frozen=True)
class Settings:
    """Of one camera: the size of its frames, radii of disks in pixels, and the areas a body may have."""

    height: int
    width: int
    threshold: float = 0.9
    background_radius: int = 5
    body_radius: int = 2
    areas: tuple[int, int] = (20, 2000)
    #: Angles of a posture.
    points: int = 15
    #: Side of the cells by which bodies and regions are matched.
    cell: int = 64


def bodies(frames: DataFrame, s: Settings) -> DataFrame:
    """Binary frames of what may be bodies: background removed, dark pixels, cleaned."""
    dark = morphology.thresholded(morphology.background_removed(frames, s.background_radius), s.threshold)
    return morphology.cleaned(dark, s.body_radius, s.height, s.width)


def in_regions(parts: DataFrame, regions: DataFrame, cell: int) -> DataFrame:
    """parts (with x and y) with the animal of each region (animal, left, top, w, h) that holds their centre; a join on cells, then a comparison."""
    per = lambda lo, n: F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(lo) + F.col(n) - 1) / cell))
    spread = regions.select("animal", *[F.col(c).alias(f"__{c}") for c in ("left", "top", "w", "h")], F.explode(per("left", "w")).alias("__i"), per("top", "h").alias("__rows"))
    spread = spread.select("*", F.explode("__rows").alias("__j")).drop("__rows")
    placed = parts.withColumns({"__i": F.floor((F.col("x") + 0.5) / cell), "__j": F.floor((F.col("y") + 0.5) / cell)})
    met = placed.join(F.broadcast(spread), ["__i", "__j"])
    within = lambda at, lo, n: (F.col(at) >= F.col(lo) - 0.5) & (F.col(at) < F.col(lo) + F.col(n) - 0.5)
    inside = within("x", "__left", "__w") & within("y", "__top", "__h")
    return met.where(inside).drop("__i", "__j", "__left", "__top", "__w", "__h")


def measured(clean: DataFrame, regions: DataFrame, s: Settings) -> DataFrame:
    """frame, animal, reason, area, x, y, n_ends, length, width, mid_x, mid_y and posture: one row for each frame and region.

    The body of a region is its largest component of a plausible area. reason is
    measured, or why there is no more: nothing (no component), size (none of a plausible
    area), crossed (the skeleton has fewer than two ends), spurs (more), broken (its ends are not joined).
    length is that of the path between the ends; the middle and the posture (angles along the
    body, less their mean) are those of the smoothed path, and width is twice the distance from the middle to the outline. Such a row has what could be measured.
    """
    labels = kept(pixels.labelled(clean.where("v = 1").select("frame", "r", "c")), "labels")
    parts = in_regions(pixels.components(labels), regions, s.cell)
    fits = F.col("area").between(*s.areas)
    best = F.max_by(F.struct("label", "area", "x", "y"), F.when(fits, F.struct("area", "label"))).alias("best")
    found = kept(parts.groupBy("frame", "animal").agg(best), "found")
    chosen = found.where("best IS NOT NULL").select("frame", "animal", F.col("best.label").alias("label"))
    own = kept(labels.join(chosen, ["frame", "label"]).select(F.struct("frame", "animal").alias("frame"), "r", "c"), "bodies")
    skeleton = skeletons.thinned(own)
    path = kept(skeletons.path_between_ends(skeleton), "path")
    curves = splines.chains_of(path).select("frame", splines.smoothed(F.col("xs"), F.col("ys"), s.points).alias("s"))
    curves = kept(curves.select("frame", F.col("s.mid_x").alias("mid_x"), F.col("s.mid_y").alias("mid_y"), scalar.tangent_angles(F.col("s.xs"), F.col("s.ys")).alias("posture")), "curves")
    wide = skeletons.width_at(curves.select("frame", F.col("mid_y").alias("y"), F.col("mid_x").alias("x")), own)
    of_body = skeletons.verdicts(skeleton).join(skeletons.path_length(path), "frame", "left").join(wide, "frame", "left").join(curves, "frame", "left")
    of_body = of_body.select("frame.*", "n_ends", "crossed", "bad", "length", "width", "mid_x", "mid_y", "posture")
    everywhere = clean.select("frame").distinct().withColumn("__all", F.lit(1)).join(F.broadcast(regions.select("animal", F.lit(1).alias("__all"))), "__all").drop("__all")
    rows = everywhere.join(found, ["frame", "animal"], "left").join(dealt(of_body), ["frame", "animal"], "left")
    seen = found.select("frame", "animal", F.lit(True).alias("__seen"))
    reason = (
        F.when(F.col("__seen").isNull(), "nothing").when(F.col("best").isNull(), "size").when(F.col("crossed"), "crossed")
        .when(F.col("bad"), "spurs").when(F.col("length").isNull(), "broken").otherwise("measured")
    )
    return rows.join(seen, ["frame", "animal"], "left").select("frame", "animal", reason.alias("reason"), "best.area", "best.x", "best.y", "n_ends", "length", "width", "mid_x", "mid_y", "posture")
