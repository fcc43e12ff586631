"""Blocks of long tracks against the windows over whole tracks, and binned densities against all kernels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.operators import blocks, distributions, kinematics, lagstats, sequences


@pytest.fixture(scope="module")
def tracks(spark):
    """Tracks with gaps, runs of missing values longer than a block, and one that starts late."""
    rng = np.random.default_rng(4)
    rows = []
    for track, (begin, n) in enumerate([(0, 200), (13, 60), (0, 1), (40, 90)]):
        angle = np.cumsum(rng.normal(0, 2, n))
        for i in range(n):
            missing = 30 <= i < 55 or rng.random() < 0.15
            a = None if missing else float((angle[i] + math.pi) % (2 * math.pi) - math.pi)
            posture = None if missing else rng.normal(0, 1, 4).tolist()
            rows.append((track, begin + i, a, None if rng.random() < 0.1 else int(rng.integers(0, 100)), posture, bool(rng.random() < 0.05)))
    return spark.createDataFrame(rows, "track long, frame long, angle double, x long, posture array<double>, cut boolean").where("frame % 17 != 5").persist()


def rows_of(df, *columns):
    return sorted(map(tuple, df.select("track", "frame", *columns).collect()))


@pytest.mark.parametrize("size", [7, 16, 1000])
def test_blocks_equal_windows(tracks, size):
    close = lambda a, b: all(x[:2] == y[:2] and (x[2] is None) == (y[2] is None) and (x[2] is None or abs(x[2] - y[2]) < 1e-9) for x, y in zip(a, b, strict=True))
    assert close(rows_of(blocks.unwrap(tracks, "angle", size=size), "unwrapped"), rows_of(kinematics.unwrap(tracks, "angle"), "unwrapped"))
    assert close(rows_of(blocks.integrate(tracks, "x", "p", 0.5, size), "p"), rows_of(kinematics.integrate(tracks, "x", "p", 0.5), "p"))
    got, want = rows_of(blocks.orient(tracks, size=size), "flip", "direct"), rows_of(sequences.orient(tracks), "flip", "direct")
    assert got == want and any(r[2] for r in want)
    lags = [0, 1, 3, 6]
    pairs = lambda df: sorted(map(tuple, df.select("track", "lag", "x0", "x1").collect()), key=str)
    assert pairs(blocks.lag_pairs(tracks, lags, ["x"], F.col("cut"), size)) == pairs(lagstats.lag_pairs(tracks, lags, ["x"], exclude=F.col("cut")))


def test_no_window_holds_more_than_a_block(tracks):
    near = blocks.with_margins(tracks, 2, 3, 10)
    assert near.groupBy("track", "__block").count().agg(F.max("count")).first()[0] <= 15
    assert near.where("__own").count() == tracks.count()
    with pytest.raises(ValueError, match="shorter"):
        blocks.lag_pairs(tracks, [10], ["x"], size=10)


def test_binned_densities(spark):
    rng = np.random.default_rng(8)
    rows = [(k, float(x), float(0.5 * x + y)) for k, n in (("a", 400), ("b", 30)) for x, y in zip(rng.normal(0, 3, n), rng.gamma(2, 1, n), strict=True)] + [("c", 1.0, 2.0), ("a", None, 1.0), ("d", 1.0, 1.0), ("d", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    values = {k: np.array([(x, y) for g, x, y in rows if g == k and x is not None]) for k in "ab"}
    got = {(r.k, round(r.point, 6)): r.density for r in distributions.kde_binned(df, "x", -9.0, 0.25, 80, ["k"]).collect()}
    for k, v in values.items():
        h = len(v) ** -0.2 * v[:, 0].std(ddof=1)
        for i in range(80):
            p = -9 + 0.25 * i
            want = np.exp(-(((p - v[:, 0]) / h) ** 2) / 2).mean() / (h * math.sqrt(2 * math.pi))
            assert abs(got.get((k, round(p, 6)), 0.0) - want) <= distributions.binned_error() / (h * math.sqrt(2 * math.pi))
    assert not {k for k, _ in got} & {"c", "d"}
    both = df.where("x IS NOT NULL")
    got = {(r.k, round(r.gx, 6), round(r.gy, 6)): r.density for r in distributions.kde_2d_binned(both, "x", "y", (-8.0, 0.8, 20), (-4.0, 0.6, 25), ["k"]).collect()}
    assert distributions.binned_error(2) < 1e-6
    for k, v in values.items():
        cov = np.cov(v.T) * len(v) ** (-1 / 3)
        inv, height = np.linalg.inv(cov), 1 / (2 * math.pi * math.sqrt(np.linalg.det(cov)))
        for i in range(20):
            for j in range(25):
                d = np.array([-8 + 0.8 * i, -4 + 0.6 * j]) - v
                want = np.exp(-np.einsum("na,ab,nb->n", d, inv, d) / 2).mean() * height
                assert abs(got.get((k, round(-8 + 0.8 * i, 6), round(-4 + 0.6 * j, 6)), 0.0) - want) <= distributions.binned_error(2) * height


def test_cost_does_not_follow_the_rows(spark):
    """Bins grow with the range in kernel widths: a hundred times the rows in the same places make no more of them."""
    one = spark.range(200).select(F.lit(1).alias("k"), (F.col("id") * 0.37 % 11).alias("x"))
    cells = lambda df: len(distributions.kde_binned(df, "x", 0.0, 1.0, 12, ["k"]).collect())
    many = one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(100)))).drop("copy")
    assert cells(one) == cells(many) == 12
