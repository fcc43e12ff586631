"""Smoothing splines of skeletons: the smoothest curve whose squared residuals sum to a stated bound.

A natural cubic smoothing spline over the arc length minimises residuals + weight *
(integral of the squared second derivative). Its values are those of a symmetric
system, (I + weight K) g = y; from the eigenvectors of K the residuals are a rising
function of one number, so the weight that gives the bound is found by bisection. A row
holds one skeleton, as long as a body has pixels; rows are handled where they lie.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMOOTHED = "struct<xs:array<double>,ys:array<double>,mid_x:double,mid_y:double,length:double>"


def _roughness(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """K, by which g K g is the natural spline's integral, and the matrix that gives its second derivatives at the inner places."""
    h, n = np.diff(t), len(t)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j, j], q[j + 1, j], q[j + 2, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j + 1 < n - 2:
            r[j, j + 1] = r[j + 1, j] = h[j + 1] / 6
    second = np.linalg.solve(r, q.T)
    return q @ second, second


def smoothing_spline(t: np.ndarray, ys: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Values and second derivatives at rising places t of the curve for each row of ys, whose squared residuals sum to bound (or less, if a straight line leaves less)."""
    n = len(t)
    if n < 3:
        return ys.copy(), np.zeros_like(ys)
    k, second = _roughness(t)
    d, u = np.linalg.eigh((k + k.T) / 2)
    d[:2] = 0.0  # straight lines cost nothing
    out = []
    for y in ys:
        c = (u.T @ y) ** 2
        residual = lambda w: float((c * (w * d / (1 + w * d)) ** 2).sum())
        lo, hi = -40.0, 40.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if residual(10.0**mid) < bound else (lo, mid)
        out.append(u @ ((u.T @ y) / (1 + 10.0**lo * d)))
    g = np.array(out)
    m = np.zeros_like(g)
    m[:, 1:-1] = g @ second.T
    return g, m


def spline_at(t: np.ndarray, g: np.ndarray, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The natural cubic spline with values g and second derivatives m at t, at other places within."""
    if len(t) == 1:
        return np.repeat(g, len(at), axis=1)
    i = np.clip(np.searchsorted(t, at, "right") - 1, 0, len(t) - 2)
    h = t[i + 1] - t[i]
    b = (at - t[i]) / h
    a = 1 - b
    return a * g[:, i] + b * g[:, i + 1] + ((a**3 - a) * m[:, i] + (b**3 - b) * m[:, i + 1]) * h**2 / 6


def smoothed(xs: Column, ys: Column, points: int, smoothing: float = 0.05) -> Column:
    """Struct of points + 2 places along the smoothed chain of (xs, ys) (even in its length), its middle, and the chain's own length.

    smoothing: the bound per point on the squared residuals of either coordinate.
    Points that repeat the one before are left out; NULL for no points.
    """

    @F.pandas_udf(SMOOTHED)
    def smooth(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for one, other in zip(x, y, strict=True):
            if one is None or other is None or not len(one):
                rows.append((None, None, None, None, None))
                continue
            p = np.array([one, other], float)
            steps = np.hypot(*np.diff(p, axis=1))
            p = p[:, np.r_[True, steps > 0]]
            t = np.r_[0.0, np.cumsum(steps[steps > 0])]
            whole = t[-1]
            g, m = smoothing_spline(t / (whole or 1.0), p, smoothing * p.shape[1])
            sx, sy = spline_at(t / (whole or 1.0), g, m, np.linspace(0, 1, points + 2))
            mx, my = spline_at(t / (whole or 1.0), g, m, np.array([0.5]))[:, 0] if p.shape[1] > 1 else p[:, 0]
            rows.append((sx.tolist(), sy.tolist(), float(mx), float(my), float(whole)))
        return pd.DataFrame(rows, columns=["xs", "ys", "mid_x", "mid_y", "length"])

    return smooth(xs, ys)


def chains_of(path: DataFrame) -> DataFrame:
    """frame, xs and ys (columns and rows) of a path of pixels in order: one row per frame."""
    points = F.array_sort(F.collect_list(F.struct("place", F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"))))
    return path.groupBy("frame").agg(points.alias("p")).select("frame", F.transform("p", lambda s: s["x"]).alias("xs"), F.transform("p", lambda s: s["y"]).alias("ys"))
