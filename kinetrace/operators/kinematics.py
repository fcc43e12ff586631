"""Velocities, angles and derivatives along a track; one sort by (track, frame) serves them all."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinetrace.functions.scalar import wrapped
from kinetrace.operators.masks import by_frame


def centred_difference(column: str, dt: float = 1.0) -> Column:
    """(next - last) / 2 dt; NULL at the ends and next to missing values."""
    w = by_frame()
    return (F.lead(column).over(w) - F.lag(column).over(w)) / (2 * dt)


def local_polynomial_weights(half: int, degree: int = 3) -> list[float]:
    """Weights over 2 half + 1 even samples whose sum of products is the slope at the centre of a least-squares polynomial."""
    ks = range(-half, half + 1)
    if degree < 3:
        return [k / sum(k * k for k in ks) for k in ks]
    s2, s4, s6 = (sum(k**p for k in ks) for p in (2, 4, 6))
    det = s2 * s6 - s4 * s4
    return [(s6 * k - s4 * k**3) / det for k in ks]


def local_slope(column: str, half: int, degree: int = 3, dt: float = 1.0) -> Column:
    """Slope of the local polynomial; NULL unless the whole window is there and valid."""
    w = by_frame()
    terms = [F.lag(column, -k).over(w) * F.lit(c) for k, c in zip(range(-half, half + 1), local_polynomial_weights(half, degree), strict=True) if k]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.when(F.count(column).over(w.rowsBetween(-half, half)) == 2 * half + 1, total / dt)


def first_difference(column: str) -> Column:
    return F.col(column) - F.lag(column).over(by_frame())


def moving_average(column: str, half: int) -> Column:
    return F.avg(column).over(by_frame().rowsBetween(-half, half))


def path_curvature(angle: str, apart: int) -> Column:
    """Change of direction over so many frames, wrapped."""
    return wrapped(F.lead(angle, apart).over(by_frame()) - F.col(angle))


def unwrap(rows: DataFrame, angle: str, out: str = "unwrapped") -> DataFrame:
    """rows with the angle made continuous over its valid samples; gaps stay NULL and are skipped.

    The correction is a running sum of whole turns: the turns between a sample and the last valid one.
    """
    w = by_frame()
    last = F.last(angle, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    step = F.col(angle) - last
    turns = F.when(F.abs(step) > math.pi, -F.floor((step + math.pi) / (2 * math.pi))).otherwise(0)
    marked = rows.withColumn("__turns", F.coalesce(turns, F.lit(0)).cast("long"))
    total = F.sum("__turns").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn(out, F.col(angle) + total * (2 * math.pi)).drop("__turns")


def cumulative_trapezoid(column: str, dt: float = 1.0) -> Column:
    """Running integral from the first frame."""
    w = by_frame()
    part = F.coalesce((F.col(column) + F.lag(column).over(w)) / 2 * dt, F.lit(0.0))
    return part


def integrate(rows: DataFrame, column: str, out: str, dt: float = 1.0) -> DataFrame:
    stepped = rows.withColumn("__part", cumulative_trapezoid(column, dt))
    return stepped.withColumn(out, F.sum("__part").over(by_frame().rowsBetween(Window.unboundedPreceding, 0))).drop("__part")
