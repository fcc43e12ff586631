"""Frames as tables of pixels (frame, r, c, v): thresholds, masks, labelled components and their measures.

Each step is a filter, a join on pixel positions, a grouped aggregate or work on a tile of a
frame, so a frame is no unit of memory and frames of any size spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrace.sources.store import dealt, kept


def crop(pixels: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """The rectangle, with positions relative to it."""
    inside = pixels.where(F.col("c").between(x, x + w - 1) & F.col("r").between(y, y + h - 1))
    return inside.withColumns({"r": F.col("r") - y, "c": F.col("c") - x})


def dark(pixels: DataFrame, threshold: float, depth: int = 255) -> DataFrame:
    """Pixels of the body: those not brighter than threshold of the depth."""
    return pixels.where(F.col("v") <= depth * threshold)


def ignoring(pixels: DataFrame, ignored: DataFrame) -> DataFrame:
    """Pixels that the table of ignored (r, c) does not name."""
    return pixels.join(ignored.select("r", "c").distinct(), ["r", "c"], "left_anti")


def normalised(pixels: DataFrame) -> DataFrame:
    """v spread over 0 to 255 in each frame."""
    span = pixels.groupBy("frame").agg(F.min("v").alias("__lo"), F.max("v").alias("__hi"))
    scaled = F.when(F.col("__hi") > F.col("__lo"), (F.col("v") - F.col("__lo")) * 255 / (F.col("__hi") - F.col("__lo"))).otherwise(0)
    return pixels.join(span, "frame").withColumn("v", scaled.cast("int")).drop("__lo", "__hi")


#: Side of the square tiles in which pixels are labelled at once.
TILE = 64


def _tile_of(column: str | Column) -> Column:
    return F.floor((F.col(column) if isinstance(column, str) else column) / TILE)


def _least_in_tile(r: np.ndarray, c: np.ndarray, eight: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of each pixel of one tile the least (r, c) that it is connected to within the tile: least codes of the neighbours, and jumps to the code's own code."""
    y, x = r - r.min() + 1, c - c.min() + 1
    wide = int(x.max()) + 2
    own = y * wide + x
    none = (int(y.max()) + 2) * wide
    label = np.full(none + 1, none)
    label[own] = own
    aside = [1, wide] + ([wide - 1, wide + 1] if eight else [])
    while True:
        now = label[own]
        for d in aside:
            now = np.minimum(now, np.minimum(label[own - d], label[own + d]))
        now = np.minimum(now, label[now])
        if (now == label[own]).all():
            return now // wide - 1 + r.min(), now % wide - 1 + c.min()
        label[own] = now


def in_one_tile(cells: DataFrame) -> bool:
    """Whether all pixels of a stored table lie in the same tile of their frames: then nothing goes on from tile to tile."""
    span = cells.agg(*[f(_tile_of(n)) for n in ("r", "c") for f in (F.min, F.max)]).first()
    return span[0] == span[1] and span[2] == span[3]


def by_tiles(cells: DataFrame, step: Callable[[pa.Table], pa.Table], schema: T.StructType, halo: int = 0) -> DataFrame:
    """step of each tile's rows of cells (frame, r, c and more), the most that a task holds at once.

    halo: up to TILE; step also gets the rows of pixels so far beyond the tile, and own tells which are the tile's.
    """
    rows = cells.withColumns({"__i": _tile_of("r"), "__j": _tile_of("c")})
    if halo:
        near = lambda n: F.explode(F.array_distinct(F.array(*[_tile_of(F.col(n) + d) for d in (-halo, 0, halo)])))
        rows = cells.select("*", near("r").alias("__i")).select("*", near("c").alias("__j"))
    rows = rows.withColumn("own", (F.col("__i") == _tile_of("r")) & (F.col("__j") == _tile_of("c")))
    return rows.groupBy("frame", "__i", "__j").applyInArrow(lambda tile: step(tile.drop_columns(["__i", "__j"])), schema)


def _tiles_labelled(pixels: DataFrame, eight: bool) -> DataFrame:
    """pixels with label, the least pixel of their component within their tile."""
    rows = pixels.drop("label")
    kinds = {f.name: f.dataType for f in pixels.schema}
    label = T.StructField("label", T.StructType([T.StructField(n, kinds[n]) for n in ("r", "c")]))

    def label_tile(tile: pa.Table) -> pa.Table:
        tile = tile.drop_columns(["own"])
        at = _least_in_tile(*(tile[n].to_numpy().astype(np.int64) for n in ("r", "c")), eight)
        least = pa.StructArray.from_arrays([pa.array(v).cast(tile[n].type) for n, v in zip(("r", "c"), at, strict=True)], ["r", "c"])
        return tile.append_column("label", least)

    return by_tiles(rows, label_tile, T.StructType([*rows.schema.fields, label]))


def labelled(pixels: DataFrame, eight: bool = True) -> DataFrame:
    """pixels with label, the least pixel of their connected component.

    Frames are cut into tiles of TILE pixels across; within a tile, the most that a task holds at once, labels come
    from arrays. What goes on are components of tiles that touch those of the next tile: the least labels of the
    neighbours and a jump to the label's own label, until nothing moves; each round is
    written to the shared folder, so a lost executor costs one round. Frames within one tile take no round.
    """
    tiled = kept(_tiles_labelled(pixels, eight), "tiles")
    if in_one_tile(tiled):
        return tiled
    beyond = F.explode(F.array(*[F.struct((F.col("r") + y).alias("r"), (F.col("c") + x).alias("c")) for y, x in ([(0, 1), (1, -1), (1, 0), (1, 1)] if eight else [(0, 1), (1, 0)])]))
    other = (_tile_of(F.col("to.r")) != _tile_of("r")) | (_tile_of(F.col("to.c")) != _tile_of("c"))
    across = tiled.select("frame", "r", "c", F.col("label").alias("a"), beyond.alias("to")).where(other).select("frame", "to.r", "to.c", "a")
    edge = F.pmod(F.col("r"), F.lit(TILE)).isin(0, TILE - 1) | F.pmod(F.col("c"), F.lit(TILE)).isin(0, TILE - 1)
    ties = across.join(tiled.where(edge).select("frame", "r", "c", F.col("label").alias("b")), ["frame", "r", "c"]).select("frame", "a", "b").distinct()
    ties = kept(ties.union(ties.select("frame", F.col("b").alias("a"), F.col("a").alias("b"))), "ties")
    labels = kept(ties.select("frame", F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while True:
        beside = labels.select("frame", F.col("node").alias("b"), "label")
        least = ties.join(beside, ["frame", "b"]).groupBy("frame", F.col("a").alias("node")).agg(F.min("label").alias("__near"))
        lower = labels.join(least, ["frame", "node"], "left").withColumn("__new", F.least("label", "__near"))
        root = lower.select("frame", F.col("node").alias("__new"), F.col("__new").alias("__root"))
        stepped = kept(lower.join(dealt(root), ["frame", "__new"]).select("frame", "node", F.least("__new", "__root").alias("label"), (F.least("__new", "__root") != F.col("label")).alias("moved")), "labels")
        labels = stepped.drop("moved")
        if stepped.where("moved").isEmpty():
            whole = labels.select("frame", F.col("node").alias("label"), F.col("label").alias("__whole"))
            return tiled.join(whole, ["frame", "label"], "left").select(*[c for c in tiled.columns if c != "label"], F.coalesce("__whole", "label").alias("label"))


def components(labels: DataFrame) -> DataFrame:
    """frame, label, area, centroid and box of each component."""
    return labels.groupBy("frame", "label").agg(
        F.count("*").alias("area"), F.avg("c").alias("x"), F.avg("r").alias("y"),
        F.min("c").alias("left"), F.min("r").alias("top"), (F.max("c") - F.min("c") + 1).alias("w"), (F.max("r") - F.min("r") + 1).alias("h"),
    )


def off_border(parts: DataFrame, width: Column | int, height: Column | int, margin: int = 0) -> DataFrame:
    """Components whose box stays more than margin away from the frame's border."""
    return parts.where((F.col("left") > margin) & (F.col("top") > margin) & (F.col("left") + F.col("w") < width - margin) & (F.col("top") + F.col("h") < height - margin))


#: Most persistent pixels that every task gets, some MB through the driver. More are met by position, dealt out: then positions are keys enough.
MASK_PIXELS = 100_000


def not_persistent(labels: DataFrame, persistent: DataFrame) -> DataFrame:
    """Labels of components that touch none of the persistent (r, c) pixels."""
    mask = kept(persistent.select("r", "c").distinct(), "mask")
    mask = F.broadcast(mask) if mask.count() <= MASK_PIXELS else mask
    touched = labels.join(mask, ["r", "c"], "left_semi").select("frame", "label").distinct()
    return labels.join(dealt(touched), ["frame", "label"], "left_anti")


def end_brightness(pixels: DataFrame, skeletons: DataFrame, share: float = 1 / 6) -> DataFrame:
    """frame, first and last: median grey of the body's pixels nearest to the first and to the last share of the skeleton's points.

    pixels: frame, r, c, v of the body only; skeletons: frame, xs (columns) and ys
    (rows), one row per frame. A pixel goes to the point that is least far; of equally near ones to the first.
    """
    met = pixels.join(skeletons.select("frame", "xs", "ys"), "frame")
    far = F.zip_with("xs", "ys", lambda x, y: (x - F.col("c")) * (x - F.col("c")) + (y - F.col("r")) * (y - F.col("r")))
    placed = met.withColumn("__far", far).withColumn("__at", F.array_position("__far", F.array_min("__far")))
    n = F.round(F.size("xs") * share)
    first, last = F.when(F.col("__at") <= n, F.col("v")), F.when(F.col("__at") > F.size("xs") - n, F.col("v"))
    return placed.groupBy("frame").agg(F.median(first).alias("first"), F.median(last).alias("last"))
