"""Geometry of points, angles and arrays of angles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def speed(vx: Column, vy: Column) -> Column:
    return F.sqrt(vx * vx + vy * vy)


def bearing(vx: Column, vy: Column) -> Column:
    """Direction of motion, from the x axis."""
    return F.atan2(vy, vx)


def body_bearing(dx: Column, dy: Column) -> Column:
    """Direction of the body, from the y axis, as stored recordings have it: rows and columns of the skeleton are swapped against x and y."""
    return F.atan2(dx, dy)


def wrapped(angle: Column) -> Column:
    """The same angle in [-pi, pi)."""
    return F.pmod(angle + math.pi, F.lit(2 * math.pi)) - math.pi


def distance(x: Column, y: Column, to_x: Column, to_y: Column) -> Column:
    return speed(x - to_x, y - to_y)


def next_power_of_two(n: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(n))).cast("long")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; NULL if an element is."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def arc_length(xs: Column, ys: Column) -> Column:
    """Length of a chain of points."""
    steps = F.zip_with(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))), lambda a, b: a - b)
    rises = F.zip_with(F.slice(ys, 2, F.greatest(F.size(ys) - 1, F.lit(0))), F.slice(ys, 1, F.greatest(F.size(ys) - 1, F.lit(0))), lambda a, b: a - b)
    return F.aggregate(F.zip_with(steps, rises, lambda a, b: F.sqrt(a * a + b * b)), F.lit(0.0), lambda s, x: s + x)


def mean_point_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def mean_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Mean Euclidean distance of two chains of equally many points, point by point."""
    across = F.zip_with(ax, bx, lambda p, q: (p - q) * (p - q))
    along = F.zip_with(ay, by, lambda p, q: (p - q) * (p - q))
    return F.aggregate(F.zip_with(across, along, lambda p, q: F.sqrt(p + q)), F.lit(0.0), lambda s, x: s + x) / F.size(ax)


def midpoint(xs: Column, ys: Column) -> Column:
    """Struct (x, y) at half the length of a chain, between its points by the straight line; NULL for no points."""
    n = F.size(xs)
    steps = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i == 1, F.lit(0.0)).otherwise(distance(F.get(xs, i - 1), F.get(ys, i - 1), F.get(xs, i - 2), F.get(ys, i - 2))))
    run = F.aggregate(steps, F.array().cast("array<double>"), lambda done, x: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0.0)) + x)))

    def found(upto: Column) -> Column:
        half = F.element_at(upto, -1) / 2
        at = F.greatest(F.size(F.filter(upto, lambda x: x <= half)), F.lit(1))
        after = F.least(at + 1, n)
        part = F.element_at(upto, after) - F.element_at(upto, at)
        share = F.when(part > 0, (half - F.element_at(upto, at)) / part).otherwise(0.0)
        between = lambda v: F.element_at(v, at) + share * (F.element_at(v, after) - F.element_at(v, at))
        return F.struct(between(xs).alias("x"), between(ys).alias("y"))

    return F.when(n > 0, F.get(F.transform(F.array(run), found), F.lit(0)))


def body_width(mid_x: Column, mid_y: Column, xs: Column, ys: Column, scale: Column | float = 1.0) -> Column:
    """Twice the least distance of the midpoint from the points of the outline, over scale; NULL without points."""
    return F.array_min(F.zip_with(xs, ys, lambda x, y: distance(x, y, mid_x, mid_y))) * 2 / scale


def end_position(points: Column, end: int, origin: Column, scale: Column | float) -> Column:
    """One coordinate of the first (end 1) or last (end -1) point of a chain in its box, as a place in the recording: (point + origin) / scale."""
    return (F.try_element_at(points, F.lit(end)) + origin) / scale


def boundary_angles(xs: Column, ys: Column, apart: int = 2) -> Column:
    """At each point of a closed outline the angle between the points so many steps before and behind, in radians; NULL where two of them coincide."""
    n = F.size(xs)
    at = lambda v, i: F.element_at(v, (F.pmod(i - 1, n) + 1).cast("int"))

    def angle(i: Column) -> Column:
        ux, uy = at(xs, i - apart) - at(xs, i), at(ys, i - apart) - at(ys, i)
        vx, vy = at(xs, i + apart) - at(xs, i), at(ys, i + apart) - at(ys, i)
        sizes = F.nullif(speed(ux, uy) * speed(vx, vy), F.lit(0.0))
        return F.acos(F.greatest(F.least((ux * vx + uy * vy) / sizes, F.lit(1.0)), F.lit(-1.0)))

    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), angle)).otherwise(F.array().cast("array<double>"))


def cropped(x: Column, origin: Column) -> Column:
    """A coordinate of the recording in a box that starts at origin."""
    return x - origin


def uncropped(x: Column, origin: Column) -> Column:
    """A coordinate in a box that starts at origin, in the recording."""
    return x + origin


def remaining(indices: Column, taken: Column) -> Column:
    """Distinct elements of one array of indices that another lacks."""
    return F.array_except(indices, taken)


def label(*parts: Column) -> Column:
    """The name shown for a track: its parts, as a rule strain and animal, with a space between."""
    return F.concat_ws(" ", *parts)


def tangent_angles(xs: Column, ys: Column) -> Column:
    """Angles of central differences along a chain, unwrapped, with their mean taken off."""
    inner = F.sequence(F.lit(2), F.size(xs) - 1)
    raw = F.transform(inner, lambda i: F.atan2(F.element_at(ys, i + 1) - F.element_at(ys, i - 1), F.element_at(xs, i + 1) - F.element_at(xs, i - 1)))
    first = F.array(F.element_at(raw, 1))
    straight = F.aggregate(F.slice(raw, 2, F.greatest(F.size(raw) - 1, F.lit(0))), first, lambda done, a: F.concat(done, F.array(F.element_at(done, -1) + wrapped(a - F.element_at(done, -1)))))
    mean = F.aggregate(straight, F.lit(0.0), lambda s, x: s + x) / F.size(straight)
    return F.when(F.size(xs) >= 3, F.transform(straight, lambda a: a - mean))


def posture_points(pixels: Column) -> Column:
    """How many angles a body of so many pixels in length carries."""
    return F.when(pixels > 60, 50).when(pixels > 40, 30).when(pixels > 20, 15).otherwise(0)


def expected_pixels(length: Column, width: Column, scale: Column) -> Column:
    """Struct (length, width, area, points) in pixels of a body of so many micrometres, by pixels per micrometre."""
    return F.struct((length * scale).alias("length"), (width * scale).alias("width"), (length * scale * width * scale).alias("area"), posture_points(length * scale).alias("points"))


def contour_area_and_centroid(xs: Column, ys: Column) -> Column:
    """Struct (area, x, y) of a closed polygon by the shoelace sums; x and y NULL for area 0."""
    n = F.size(xs)
    ring = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(xs, i).alias("x"), F.element_at(ys, i).alias("y"), F.element_at(xs, i % n + 1).alias("u"), F.element_at(ys, i % n + 1).alias("v")))
    total = lambda f: F.aggregate(ring, F.lit(0.0), lambda s, p: s + f(p))
    cross = lambda p: p["x"] * p["v"] - p["u"] * p["y"]
    area = total(cross) / 2
    x = total(lambda p: (p["x"] + p["u"]) * cross(p)) / (6 * F.nullif(area, F.lit(0.0)))
    y = total(lambda p: (p["y"] + p["v"]) * cross(p)) / (6 * F.nullif(area, F.lit(0.0)))
    return F.struct(F.abs(area).alias("area"), x.alias("x"), y.alias("y"))


def clock(seconds: Column) -> Column:
    """hh:mm:ss."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def exponential_decay(tau: Column, scale: float) -> Column:
    return F.exp(-tau / scale)


def reversal_curve(tau: Column, scale: float, plateau: float) -> Column:
    """Correlation of a two-state process: (1 - C) e^(-tau/scale) + C."""
    return (1 - plateau) * F.exp(-tau / scale) + plateau


def speed_curve(tau: Column, diffusion: float, scale: float) -> Column:
    """Covariance of a mean-reverting speed: D s e^(-tau/s)."""
    return diffusion * scale * F.exp(-tau / scale)


def bearing_curve(tau: Column, diffusion: float) -> Column:
    """Correlation of a diffusing bearing: e^(-D tau)."""
    return F.exp(-diffusion * tau)


def mode_score(parameters: list[Column], means: list[float], mode: list[float]) -> Column:
    """Projection of log10 of the parameters' sizes, less their means, on a mode; as many of the parameters count as the mode has entries."""
    terms = [(F.log10(F.abs(p)) - m) * w for p, m, w in zip(parameters, means, mode)]  # noqa: B905
    return sum(terms[1:], terms[0])


def stationary_variance(sigma: Column, tau: Column) -> Column:
    return sigma * sigma * tau / 2
