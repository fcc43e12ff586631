"""Smoothing splines, dynamics per window and simulations from parameters against dense and plain versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetrace.functions import scalar
from kinetrace.operators import models, simulate, splines


def dense_roughness(t):
    """The integral of the squared second derivative of the natural spline through unit values, by its defining equations on all places."""
    n, h = len(t), np.diff(t)
    a, b = np.zeros((n, n)), np.zeros((n, n))
    a[0, 0] = a[-1, -1] = 1
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1] / 6, (h[i - 1] + h[i]) / 3, h[i] / 6
        b[i, i - 1 : i + 2] = 1 / h[i - 1], -1 / h[i - 1] - 1 / h[i], 1 / h[i]
    m = np.linalg.solve(a, b)  # second derivatives from values
    gram = np.zeros((n, n))
    for i in range(n - 1):
        gram[i, i] += h[i] / 3
        gram[i + 1, i + 1] += h[i] / 3
        gram[i, i + 1] += h[i] / 6
        gram[i + 1, i] += h[i] / 6
    return m.T @ gram @ m, m


@pytest.mark.parametrize("n", [3, 4, 12, 60, 150])
def test_spline_is_the_smoothest_within_its_bound(n):
    rng = np.random.default_rng(n)
    t = np.sort(rng.random(n))
    t = (t - t[0]) / (t[-1] - t[0])
    ys = np.stack([np.sin(7 * t) * 5 + rng.normal(0, 0.5, n), np.cumsum(rng.normal(0, 1, n))])
    bound = 0.05 * n
    g, m = splines.smoothing_spline(t, ys, bound)
    k, second = dense_roughness(t)
    line = np.stack([np.ones(n), t], axis=1)
    for y, z, s in zip(ys, g, m, strict=True):
        np.testing.assert_allclose(second @ z, s, atol=1e-6 * max(1, np.abs(s).max()))
        straight = ((y - line @ np.linalg.lstsq(line, y, rcond=None)[0]) ** 2).sum()
        if straight <= bound:
            assert abs(((y - z) ** 2).sum() - straight) < 1e-6
            continue
        assert abs(((y - z) ** 2).sum() - bound) < 1e-6 * bound
        weight = ((y - z) @ (k @ z)) / ((k @ z) @ (k @ z))
        np.testing.assert_allclose(np.linalg.solve(np.eye(n) + weight * k, y), z, atol=1e-5 * np.abs(y).max())


def test_spline_values_between_places():
    t = np.array([0.0, 0.3, 0.45, 1.0])
    g, m = splines.smoothing_spline(t, np.array([[0.0, 1.0, 3.0, -2.0]]), 1e-9)
    at = np.linspace(0, 1, 2001)
    y = splines.spline_at(t, g, m, at)[0]
    np.testing.assert_allclose(splines.spline_at(t, g, m, t), g, atol=1e-9)
    assert np.abs(np.diff(y, 2)).max() < 0.01 and abs(y[1] - y[0] - (y[2] - y[1])) < 1e-5  # smooth, and natural at the end


def test_smoothed_chains(spark):
    arc = [(math.cos(a) * 20, math.sin(a) * 20) for a in np.linspace(0, math.pi, 41)]
    rows = [(1, [x for x, _ in arc], [y for _, y in arc]), (2, None, None), (3, [], []), (4, [5.0], [6.0]), (5, [0.0, 0.0, 3.0], [0.0, 0.0, 4.0])]
    df = spark.createDataFrame(rows, "frame long, xs array<double>, ys array<double>").withColumn("s", splines.smoothed(F.col("xs"), F.col("ys"), 9, 0.001))
    got = {r.frame: r.s for r in df.collect()}
    assert len(got[1].xs) == 11 and abs(got[1].mid_x) < 0.1 and abs(got[1].mid_y - 20) < 0.2
    assert abs(got[1].length - 20 * math.pi) < 0.1 and all(abs(math.hypot(x, y) - 20) < 0.3 for x, y in zip(got[1].xs, got[1].ys, strict=True))
    assert got[2].xs is None and got[3].xs is None and (got[4].mid_x, got[4].mid_y, got[4].length) == (5.0, 6.0, 0.0)
    assert (got[5].length, round(got[5].mid_x, 6), round(got[5].mid_y, 6)) == (5.0, 1.5, 2.0)


def test_dynamics_per_window(spark):
    """Windows, step matrix, residual scale and sign of the damping time, as a plain fit of each window gives them."""
    rng, dt, size = np.random.default_rng(2), 0.1, 40
    step = np.array([[0.8, 0.3, 0.0], [-0.3, 0.8, 0.0], [0.0, 0.0, -0.7]])
    z = np.zeros((200, 3))
    for i in range(1, 200):
        z[i] = step @ z[i - 1] + rng.normal(0, 1, 3)
    frame = pd.DataFrame(z, columns=list("abc")).assign(track=1, frame=range(200))
    frame.loc[60:70, "b"] = np.nan
    df = spark.createDataFrame(frame).select("track", "frame", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "abc"])
    got = models.dynamics(models.autoregression_windows(df, ["track"], list("abc"), size, least_present=0.7), ["track", "window"], 3, dt).toPandas()
    assert (got.damping < 0).any()  # the third mode changes sign from frame to frame
    known = ~np.isnan(frame[list("abc")].to_numpy()).any(axis=1)
    seen = 0
    for first in range(0, 200 - size + 1, size // 10):
        pairs = [i for i in range(max(first, 1), first + size) if known[i] and known[i - 1]]
        part = got[got.window == first + size // 2].sort_values("mode")
        assert (len(part) == 3) == (len(pairs) > 0.7 * size)
        if not len(part):
            continue
        x, y = z[[i - 1 for i in pairs]], z[pairs]
        w = np.linalg.lstsq(x, y, rcond=None)[0]
        values = np.linalg.eigvals(w).astype(complex)
        tau = -np.sign(values.real) / (np.log(np.abs(values)) / dt)
        order = np.lexsort((np.abs(np.angle(values)), -tau))
        np.testing.assert_allclose(part.damping, tau[order], rtol=1e-6)
        np.testing.assert_allclose(part.frequency, np.abs(np.angle(values))[order] / dt / 2 / np.pi, rtol=1e-6, atol=1e-9)
        np.testing.assert_allclose(part.noise, (y - x @ w).std(axis=0) / np.sqrt(dt), rtol=1e-6)
        seen += 1
    assert seen > 20
    sums = models.autoregression_sums(df, ["track"], list("abc"))
    damped, free = (models.dynamics(sums, ["track"], 3, dt, damp).toPandas().noise.sum() for damp in (50.0, 0.0))
    assert damped > free


def test_paths_from_parameters(spark):
    rows = [(1, 5.0, 2.0, 0.5), (7, -3.0, 0.5, 2.0), (9, 0.0, 1.0, 0.0)]
    got = simulate.mean_reverting_of(spark.createDataFrame(rows, "track long, mu double, tau double, sigma double"), 4000, 0.05, seed=4).toPandas()
    assert len(got) == 12_000
    for track, mu, tau, sigma in rows:
        y = got[got.track == track].sort_values("frame").y.to_numpy()
        assert abs(y.mean() - mu) <= 4 * sigma * math.sqrt(tau / 2) / math.sqrt(4000 * 0.05 / tau / 2) + 1e-12
        assert abs(y.std() - sigma * math.sqrt(tau / 2)) <= 0.25 * sigma * math.sqrt(tau / 2) + 1e-12
    again = simulate.mean_reverting_of(spark.createDataFrame(rows[1:2], "track long, mu double, tau double, sigma double"), 4000, 0.05, seed=4).toPandas()
    np.testing.assert_array_equal(again.y, got[got.track == 7].sort_values("frame").y)


def test_expected_pixels(spark):
    r = spark.range(1).select(scalar.expected_pixels(F.lit(1000.0), F.lit(70.0), F.lit(0.05)).alias("e")).first().e
    assert (r.length, r.width, r.area, r.points) == (50.0, 3.5, 175.0, 30)
