"""Operators against closed forms, brute-force loops and invariants."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetrace.functions import scalar
from kinetrace.operators import distributions, ensembles, headtail, kinematics, lagstats, masks, models, pixels, posture, sequences, simulate
from kinetrace.plans import chains, protocol
from kinetrace.sources import store, tables

TRACK = "track long, frame long, x double, y double"


def line(spark, n=50):
    return spark.createDataFrame([(1, i, 2.0 * i, -1.0 * i) for i in range(n)], TRACK)


def random_track(spark, seed=0, tracks=3, n=60, missing=0.15):
    r = random.Random(seed)
    rows = [(t, i, None if r.random() < missing else r.uniform(-3, 3), r.random() < 0.1) for t in range(tracks) for i in range(n)]
    return rows, spark.createDataFrame(rows, "track long, frame long, x double, cut boolean")


def test_slopes_are_exact_on_polynomials(spark):
    rows = spark.createDataFrame([(1, i, float(i**3 - 2 * i), float(3 * i)) for i in range(30)], TRACK)
    got = rows.select("frame", kinematics.local_slope("x", 6).alias("a"), kinematics.local_slope("y", 3, 1).alias("b"), kinematics.centred_difference("y").alias("c")).collect()
    for r in got:
        inside = 6 <= r.frame < 24
        assert (r.a is not None) == inside and (not inside or abs(r.a - (3 * r.frame**2 - 2)) < 1e-6)
        assert (r.b is None) != (3 <= r.frame < 27) and (r.b is None or abs(r.b - 3) < 1e-9)
        assert (r.c is None) == (r.frame in (0, 29))


def test_unwrap_follows_a_turning_angle(spark):
    true = [0.7 * i for i in range(80)]
    wrapped = [(1, i, None if i % 11 == 5 else math.remainder(a, 2 * math.pi), 0.0) for i, a in enumerate(true)]
    got = kinematics.unwrap(spark.createDataFrame(wrapped, TRACK), "x").orderBy("frame").collect()
    for r in got:
        assert (r.unwrapped is None) == (r.x is None) and (r.x is None or abs(r.unwrapped - true[r.frame]) < 1e-9)


def test_displacement_and_correlation_closed_forms(spark):
    for r in lagstats.squared_displacement(line(spark), [0, 1, 5, 60], ["x", "y"]).collect():
        assert abs(r.msd - 5.0 * r.lag**2) < 1e-9 and r.lag != 60
    circle = spark.createDataFrame([(1, i, math.cos(0.3 * i), math.sin(0.3 * i)) for i in range(200)], TRACK)
    for r in lagstats.vector_autocorrelation(circle, list(range(20)), ["x", "y"]).collect():
        assert abs(r.dotacf - math.cos(0.3 * r.lag)) < 1e-9


def test_lag_pairs_match_a_loop_on_both_paths(spark):
    rows, df = random_track(spark)
    lags = [0, 1, 2, 7, 30, 59, 60]
    want = []
    at = {(t, i): (x, c) for t, i, x, c in rows}
    for t, i, x, _ in rows:
        for n in lags:
            if (t, i + n) in at and not any(at[t, j][1] for j in range(i + 1, i + n + 1)):
                want.append((t, n, x, at[t, i + n][0]))
    key = lambda r: tuple((v is None, v or 0) for v in r)
    want.sort(key=key)
    for few in (64, 3):
        old, lagstats.FEW_LAGS = lagstats.FEW_LAGS, few
        got = sorted((tuple(r) for r in lagstats.lag_pairs(df, lags, ["x"], exclude=F.col("cut")).collect()), key=key)
        lagstats.FEW_LAGS = old
        assert got == want


def test_autocorrelation_bounds_and_pacf(spark):
    r = np.random.default_rng(1)
    y = [0.0]
    for _ in range(4000):
        y.append(0.6 * y[-1] + r.normal())
    df = spark.createDataFrame([(1, i, float(v), 0.0) for i, v in enumerate(y)], TRACK)
    acf = lagstats.autocorrelation(df, list(range(7)), "x")
    values = {x.lag: x.acf for x in acf.collect()}
    assert values[0] == 1.0 and abs(values[1] - 0.6) < 0.05 and all(abs(v) <= 1.01 for v in values.values())
    pacf = {x.lag: x.pacf for x in lagstats.partial_autocorrelation(acf).collect()}
    assert abs(pacf[1] - values[1]) < 1e-12 and all(abs(pacf[k]) < 0.06 for k in range(2, 7))
    fit = models.mean_reverting_fit(df, ["track"], "x", 1.0).first()
    assert abs(fit.slope - 0.6) < 0.05 and abs(fit.sigma - 1) < 0.05 and abs(fit.tau - 2.5) < 0.4


def loop_reversals(states):
    """(begin, end) by one pass over the states; None where one is not known."""
    out, begin, inside = [], None, False
    for j in range(1, len(states) - 2):
        if not inside and states[j] == 2 == states[j + 1]:
            begin, inside = (None if states[j - 1] == 0 else j), True
        elif inside and states[j] == 1 == states[j + 1]:
            out.append((begin, j))
            inside = False
        elif inside and states[j] == 0:
            out.append((begin, None))
            inside = False
    return out


def test_reversals_match_a_state_machine(spark):
    r = random.Random(5)
    rows = [(t, i, r.choices([0, 1, 2], [1, 3, 4])[0]) for t in range(6) for i in range(70)]
    df = spark.createDataFrame(rows, "track long, frame long, s int")
    order = lambda x: tuple(-1 if v is None else v for v in x)
    got = sorted(((x.track, x.begin, x.end) for x in sequences.reversals(df, F.col("s")).collect()), key=order)
    want = sorted(((t, *x) for t in range(6) for x in loop_reversals([s for k, _, s in rows if k == t])), key=order)
    assert got == want and {x[1] is None for x in want} == {x[2] is None for x in want} == {True, False}
    spans = sequences.reversals(df, F.col("s"))
    edges = {(x.track, e) for x in spans.collect() for e in (x.begin, x.end) if e is not None}
    for x in sequences.near_boundaries(df, spans, 3).collect():
        assert x.near == any((x.track, x.frame + k) in edges for k in (-2, -1, 0, 1, 2))


@pytest.mark.parametrize(
    ("states", "want"),
    [
        ([1, 1, 2, 2, 2, 1, 1, 1], [(2, 5)]),  # plain
        ([1, 0, 2, 2, 2, 1, 1, 1], [(None, 5)]),  # begins after a missing frame
        ([1, 1, 2, 2, 0, 1, 1, 1], [(2, None)]),  # ends at a missing frame
        ([1, 1, 2, 0, 2, 2, 1, 1, 1], [(None, 6)]),  # a single 2 and a gap start nothing
        ([2, 2, 2, 1, 1, 1, 1], [(1, 3)]),  # the first frame starts nothing
        ([1, 1, 2, 2, 2, 2, 2], []),  # does not end
        ([1, 1, 2, 2, 2, 1, 1], []),  # the last two frames end nothing
        ([0, 2], []),
    ],
)
def test_reversals_by_hand(spark, states, want):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(states)], "track long, frame long, s int")
    assert [(x.begin, x.end) for x in sequences.reversals(df, F.col("s")).collect()] == want == loop_reversals(states)


def loop_segments(here, jump, gap, longest, least):
    """Segments by one pass over the frames."""
    out, i, n = [], 0, len(here)
    while i < n:
        begin, missing = i, 0
        i += 1
        while i < n and i - begin < longest and not (here[i] and jump[i]):
            missing = 0 if here[i] else missing + 1
            i += 1
            if missing > gap:
                break
        out.append((begin, i))
    return [x for x in out if x[1] - x[0] > least]


@pytest.mark.parametrize(("gap", "longest", "least"), [(3, 10_000, 4), (1, 6, 0), (2, 7, 2), (3, 4, 0), (5, 3, 0), (0, 9, 1)])
def test_segments_match_a_loop(spark, gap, longest, least):
    r = random.Random(gap)
    rows = []
    for t in range(12):
        away = False
        for i in range(60):
            away = r.random() < (0.85 if away else 0.12)
            rows.append((t, i, not away, r.random() < 0.1))
    rows += [(90, 0, False, False), (91, 0, True, True)] + [(92, i, False, False) for i in range(40)]
    df = spark.createDataFrame(rows, "track long, frame long, here boolean, jump boolean")
    want = sorted((t, *x) for t in {x[0] for x in rows} for x in loop_segments([x[2] for x in rows if x[0] == t], [x[3] for x in rows if x[0] == t], gap, longest, least))
    got = sorted((x.track, x.begin, x.end) for x in sequences.greedy_segments(df, F.col("here"), F.col("jump"), gap, longest, least).collect())
    assert got == want
    many = sequences.segments_by_present(df, F.col("here"), F.col("jump"), gap, longest, 2).collect()
    every = {(t, *x) for t in {x[0] for x in rows} for x in loop_segments([x[2] for x in rows if x[0] == t], [x[3] for x in rows if x[0] == t], gap, longest, 0)}
    held = {(t, b, e): sum(h for k, i, h, _ in rows if k == t and b <= i < e) for t, b, e in every}
    assert {(x.track, x.begin, x.end): x.n for x in many} == {k: n for k, n in held.items() if n > 2}


@pytest.mark.parametrize("block", [1, 3, 256])
def test_segments_of_flickering_tracks_in_blocks(spark, monkeypatch, block):
    """Runs are folded in blocks, and stretches between jumps apart; frames may be absent altogether."""
    monkeypatch.setattr(sequences, "BLOCK", block)
    r = random.Random(block)
    seen = [(t, i, r.random() < 0.5, r.random() < t / 20) for t in range(4) for i in range(400)]
    df = spark.createDataFrame(seen, "track long, frame long, here boolean, jump boolean")
    for gap, longest, least in ((0, 50, 0), (1, 9, 2), (6, 10_000, 4)):
        want = sorted((t, *x) for t in range(4) for x in loop_segments([x[2] for x in seen if x[0] == t], [x[3] for x in seen if x[0] == t], gap, longest, least))
        got = sorted((x.track, x.begin, x.end) for x in sequences.greedy_segments(df, F.col("here"), F.col("jump"), gap, longest, least).collect())
        assert got == want and len(got) > 4


def test_segments_of_an_empty_table(spark):
    df = spark.createDataFrame([], "track long, frame long, here boolean, jump boolean")
    assert sequences.greedy_segments(df, F.col("here"), F.col("jump")).count() == 0


def test_frames_find_their_segment(spark):
    _, df = random_track(spark, 3)
    spans = sequences.islands(df, F.col("x").isNotNull()).where("n > 2")
    held = {(s.track, f): (s.n, s.begin) for s in spans.collect() for f in range(s.begin, s.end)}
    for r in sequences.in_segments(df, spans).collect():
        assert (r.n, r.begin) == held.get((r.track, r.frame), (None, None))


def test_orientation_is_restored(spark):
    r = random.Random(2)
    base = [0.1, 0.5, 0.9, 2.0]
    turned, rows = False, []
    for i in range(40):
        turned ^= r.random() < 0.4
        rows.append((1, i, None if i % 6 == 4 else (base[::-1] if turned else base)))
    df = spark.createDataFrame(rows, "track long, frame long, posture array<double>")
    fixed = sequences.apply_flip(sequences.orient(df)).where("posture IS NOT NULL").select("posture").distinct().collect()
    assert len(fixed) == 1


def test_last_good_and_windows(spark):
    rows, df = random_track(spark, 7)
    seen = {}
    for r in sequences.last_good(df, F.col("x").isNotNull(), "x").orderBy("track", "frame").collect():
        assert (r.last_x, r.frames_since) == ((None, None) if r.track not in seen else (seen[r.track][0], r.frame - seen[r.track][1]))
        if r.x is not None:
            seen[r.track] = (r.x, r.frame)
    listed = masks.windows(df, 20).groupBy("track", "window").agg(F.min("frame").alias("a"), F.count("*").alias("n")).collect()
    assert {(r.window, r.a) for r in listed} == {(w, 10 * w) for w in range(6)} and all(r.n == (20 if r.window < 5 else 10) for r in listed)
    with pytest.raises(ValueError):
        masks.frame_slice(df, -1, 3)


def test_masks(spark):
    rows = [(1, i, 10.0 if i != 3 else 0.0, 2.0 if i != 5 else 9.0) for i in range(20)] + [(2, 0, None, None)]
    got = masks.flag_bad_size(spark.createDataFrame(rows, "track long, frame long, length double, width double")).where("bad").select("track", "frame").collect()
    assert sorted(map(tuple, got)) == [(1, 3), (1, 5), (2, 0)]
    fast = masks.flag_bad_speed(line(spark), 2.0).where("too_fast").count()
    assert fast == 48


def test_densities_integrate_to_one(spark):
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in r.normal(size=(300, 2))], "track long, x double, y double")
    points = distributions.grid(-7, 7, 141)
    total = distributions.kde(df, "x", points, ["track"]).agg(F.sum("density")).first()[0] * 0.1
    assert abs(total - 1) < 1e-3
    side = distributions.grid(-6, 6, 41)
    assert abs(distributions.kde_2d(df, "x", "y", side, side, ["track"]).agg(F.sum("density")).first()[0] * 0.09 - 1) < 1e-2
    h = distributions.histogram(df, "x", -4, 4, 16)
    assert abs(h.agg(F.sum("density")).first()[0] * 0.5 - 1) < 1e-9
    assert distributions.hexbin(df, F.col("x"), F.col("y"), 1.0).agg(F.sum("n")).first()[0] == 300


def test_end_variance_sums_deviations_of_points(spark):
    """Points with different means and no spread have no variance."""
    rows = [(1, i, [5.0 + (i % 2), -3.0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0 + 3 * (i % 2)]) for i in range(10)]
    got = posture.end_variance(spark.createDataFrame(rows, "track long, frame long, posture array<double>"), ["track"]).first()
    assert abs(got.head_sd - 0.5) < 1e-12 and abs(got.tail_sd - 1.5) < 1e-12 and abs(got.ratio - 1 / 3) < 1e-12


def test_size_bands(spark):
    """Length within a tenth, width within three tenths of the median."""
    rows = [(1, i, 100.0, 10.0) for i in range(21)] + [(1, 100, 112.0, 10.0), (1, 101, 109.0, 10.0), (1, 102, 100.0, 12.5), (1, 103, 100.0, 13.5)]
    got = masks.flag_bad_size(spark.createDataFrame(rows, "track long, frame long, length double, width double")).where("bad").select("frame").collect()
    assert sorted(r.frame for r in got) == [100, 103]


def test_covariance_of_keys_and_lengths(spark):
    r = np.random.default_rng(3)
    rows = [(k, r.normal(size=4).tolist()) for k in ("a", None, "b") for _ in range(30)]
    df = spark.createDataFrame(rows, "k string, posture array<double>")
    got = {(x.k, x.i, x.j): x.cov for x in posture.covariance(df, keys=["k"]).collect()}
    for k in ("a", None, "b"):
        want = np.cov(np.array([v for q, v in rows if q == k]).T)
        assert all(abs(got[k, i, j] - want[i, j]) < 1e-12 for i in range(4) for j in range(4))
    assert posture.covariance(df.limit(0)).count() == 0


@pytest.mark.parametrize("bins", [1, 3, 4096])
def test_medians_are_exact(spark, bins):
    r = random.Random(bins)
    rows = [(k, r.choice([None, 1.0, r.uniform(-5, 5), r.gauss(0, 1e6)])) for k in range(7) for _ in range(40 + k)] + [(50, 2.5), (51, None), (52, 1.0), (52, 4.0)]
    got = {x.k: (x.median, x.n) for x in distributions.medians(spark.createDataFrame(rows, "k long, x double"), ["k"], "x", bins).collect()}
    for k in {k for k, _ in rows} - {51}:
        values = [x for q, x in rows if q == k and x is not None]
        assert got[k][1] == len(values) and abs(got[k][0] - np.median(values)) < 1e-9
    assert 51 not in got


def test_divergences(spark):
    table = lambda ns: spark.createDataFrame(list(enumerate(ns)), "bin long, n long")
    p, q = [1, 3, 0, 4], [2, 2, 3, 1]
    got = distributions.divergences(table(p), table(q)).first()
    a, b = np.array(p) / 8, np.array(q) / 8
    kl = lambda x, y: sum(u * math.log2(u / v) for u, v in zip(x, y) if u)
    assert abs(got.kl - kl(a, b)) < 1e-12 and got.kl_strict == 0.0 and abs(got.js - (kl(a, (a + b) / 2) + kl(b, (a + b) / 2)) / 2) < 1e-12
    back = distributions.divergences(table(q), table(p)).first()
    assert back.kl is None and abs(back.js - got.js) < 1e-12 and 0 <= got.js <= 1
    assert distributions.divergences(table(q), table(q)).first().js == 0


def test_posture_modes(spark):
    r = np.random.default_rng(8)
    data = r.normal(size=(200, 5)) @ r.normal(size=(5, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(999, [1.0, None, 0.0, 0.0, 0.0])], "frame long, posture array<double>")
    cov = posture.covariance(df)
    want = np.cov(data.T)
    assert all(abs(c.cov - want[c.i, c.j]) < 1e-9 for c in cov.collect())
    values, vectors = posture.modes(cov)
    assert abs(values.sum() - np.trace(want)) < 1e-9 and (np.diff(values) <= 0).all()
    amplitude = df.select(posture.projection(F.col("posture"), vectors[:, 0].tolist()).alias("a")).agg(F.var_samp("a"), F.count("a")).first()
    assert abs(amplitude[0] - values[0]) < 1e-9 and amplitude[1] == 200
    assert abs(posture.explained(spark, values).agg(F.max("cumulated")).first()[0] - 1) < 1e-12


def test_curve_fits_recover_parameters(spark):
    t = np.linspace(0, 20, 60)
    rows = [(k, float(x), float(y)) for k, ys in ((1, 0.7 * np.exp(-t / 3) + 0.3), (2, 0.9 * np.exp(-t / 1.5) + 0.1)) for x, y in zip(t, ys)]
    fits = {r.track: r for r in models.reversal_rates(models.fit_curve(spark.createDataFrame(rows, "track long, tau double, value double"), ["track"], "tau", "value", "reversal")).collect()}
    assert abs(fits[1].tau - 3) < 1e-3 and abs(fits[1].plateau - 0.3) < 1e-4 and abs(fits[2].tau - 1.5) < 1e-3
    assert abs(fits[1].tau_reverse * (1 - fits[1].reverse_share) - fits[1].tau) < 1e-9
    speed = spark.createDataFrame([(1, float(x), float(4 * 2 * math.exp(-x / 2))) for x in t] + [(2, 0.0, 1.0)], "track long, tau double, value double")
    got = {r.track: r for r in models.fit_curve(speed, ["track"], "tau", "value", "speed").collect()}
    assert abs(got[1].diffusion - 4) < 1e-2 and abs(got[1].tau - 2) < 1e-2 and got[2].tau is None
    diff = models.fit_curve(spark.createDataFrame([(1, float(x), math.exp(-0.25 * x)) for x in t], "track long, tau double, value double"), ["track"], "tau", "value", "bearing").first()
    assert abs(diff.diffusion - 0.25) < 1e-6


def test_simulations_are_seeded_and_fit_back(spark):
    a = simulate.mean_reverting(spark, 6, 4000, 0.1, 1.0, 2.0, 0.5, seed=9)
    again = simulate.mean_reverting(spark, 6, 4000, 0.1, 1.0, 2.0, 0.5, seed=9).repartition(3)
    assert a.exceptAll(again).isEmpty()
    fit = models.mean_reverting_fit(a, ["replicate"], "y", 0.1).agg(F.avg("tau").alias("tau"), F.avg("sigma").alias("s"), F.avg("mu").alias("mu")).first()
    assert abs(fit.tau - 2) < 0.3 and abs(fit.s - 0.5) < 0.03 and abs(fit.mu - 1) < 0.15
    drift = simulate.drift_diffusion(spark, 4, 3000, 0.1, 0.7, 0.2, seed=2).withColumn("t", F.col("frame") * 0.1)
    assert abs(models.drift_diffusion_fit(drift, ["replicate"], "t", "y", 0.1).agg(F.avg("drift")).first()[0] - 0.7) < 0.1
    events = simulate.poisson_events(spark, 3, 2.0, 2000.0, seed=4)
    assert abs(models.poisson_scale(events, ["replicate"], "t").agg(F.avg("scale")).first()[0] - 2) < 0.15
    share = simulate.two_state(spark, 3, 20_000, 0.1, 6.0, 2.0, seed=1).agg(F.avg(F.col("reverse").cast("int"))).first()[0]
    assert abs(share - 0.25) < 0.05


def test_surrogates_keep_the_spectrum(spark):
    y = np.random.default_rng(0).normal(size=64).cumsum()
    got = simulate.phase_surrogates(spark.createDataFrame([(1, i, float(v), 0.0) for i, v in enumerate(y)], TRACK), ["track"], "x", seed=5).orderBy("frame").toPandas()
    assert len(got) == 63
    assert np.allclose(np.abs(np.fft.rfft(got["surrogate"])), np.abs(np.fft.rfft(y[:63]))) and not np.allclose(got["surrogate"], y[:63])


def test_bands(spark):
    values = spark.createDataFrame([("e", i, float(i)) for i in range(40)], "ensemble string, place long, value double")
    sizes = values.groupBy("ensemble").agg(F.count("*").alias("n"))
    narrow = ensembles.one_swap_band(values, ensembles.draws(sizes, ["ensemble"], 300), ["ensemble"]).first()
    wide = ensembles.bootstrap_band(values, ["ensemble"], 300).first()
    assert narrow.low < 19.5 < narrow.high and narrow.high - narrow.low < 2
    assert 5 < wide.high - wide.low < 10 and abs(wide.mean - 19.5) < 0.5


def test_ensembles(spark):
    bag = lambda names: spark.createDataFrame([("e", n) for n in names], "ensemble string, animal string")
    a, b = bag(["10", "9", "9", "1"]), bag(["9", "x"])
    assert sorted(r.animal for r in ensembles.difference(a, b).collect()) == ["1", "10", "9"]
    assert sorted(r.animal for r in ensembles.without(a, b, ["animal"]).collect()) == ["1", "10"]
    assert ensembles.union(a, b).count() == 6 and not ensembles.same_members(a, b, ["animal"]) and ensembles.same_members(a, a.distinct(), ["animal"])
    placed = ensembles.ordered(a, ensembles.numeric_order()).orderBy("place").collect()
    assert [r.animal for r in placed] == ["1", "9", "9", "10"]


def test_head_tail_cascades(spark):
    df = spark.createDataFrame([(1.5, 0.0, 0.0), (0.5, 0.0, 0.0), (1.0, -0.2, 0.0), (1.0, 0.0, 0.1), (1.0, 0.0, 0.0)], "r double, d double, m double")
    got = [(x.h.method, x.h.flip) for x in df.select(headtail.by_posture(F.col("r"), F.col("d"), F.col("m")).alias("h")).collect()]
    assert got == [(1, False), (1, True), (3, True), (2, False), (0, False)]
    df = spark.createDataFrame([(50.0, 9, 3, 1.0, 1.0), (50.0, 3, 9, 1.0, 1.0), (50.0, 0, 4, 1.0, 1.0), (10.0, 9, 3, 1.0, 2.0), (10.0, 9, 3, 1.0, 1.0)], "s double, h long, t long, hs double, ts double")
    got = [(x.h.method, x.h.flip) for x in df.select(headtail.by_motion(*[F.col(c) for c in ("s", "h", "t", "hs", "ts")]).alias("h")).collect()]
    assert got == [(1, False), (1, True), (1, True), (2, True), (-1, False)]


def test_scalars(spark):
    square = spark.createDataFrame([([0.0, 2.0, 2.0, 0.0], [0.0, 0.0, 2.0, 2.0])], "xs array<double>, ys array<double>")
    got = square.select(scalar.contour_area_and_centroid(F.col("xs"), F.col("ys")).alias("c"), scalar.arc_length(F.col("xs"), F.col("ys")).alias("l")).first()
    assert (got.c.area, got.c.x, got.c.y, got.l) == (4.0, 1.0, 1.0, 6.0)
    arc = [(float(math.cos(a)), float(math.sin(a))) for a in np.linspace(0, 3, 20)]
    bent = spark.createDataFrame([([p[0] for p in arc], [p[1] for p in arc])], "xs array<double>, ys array<double>").select(scalar.tangent_angles(F.col("xs"), F.col("ys")).alias("a")).first().a
    assert len(bent) == 18 and abs(sum(bent)) < 1e-9 and np.allclose(np.diff(bent), 3 / 19)


def test_skeleton_scalars(spark):
    df = spark.createDataFrame([([0.0, 3.0, 3.0], [0.0, 0.0, 1.0]), ([2.0], [5.0]), ([], [])], "xs array<double>, ys array<double>")
    got = [r[0] for r in df.select(scalar.midpoint(F.col("xs"), F.col("ys"))).collect()]
    assert (got[0].x, got[0].y) == (2.0, 0.0) and (got[1].x, got[1].y) == (2.0, 5.0) and got[2] is None
    ends = df.select(scalar.body_width(F.lit(0.0), F.lit(0.0), F.col("xs"), F.col("ys"), 2.0).alias("w"), scalar.end_position(F.col("xs"), -1, F.lit(10), 2.0).alias("e")).collect()
    assert [(r.w, r.e) for r in ends] == [(0.0, 6.5), (math.sqrt(29), 6.0), (None, None)]
    square = spark.createDataFrame([([0.0, 1.0, 2.0, 2.0, 2.0, 1.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0, 2.0, 2.0, 2.0, 1.0])], "xs array<double>, ys array<double>")
    angles = square.select(scalar.boundary_angles(F.col("xs"), F.col("ys")).alias("a")).first().a
    assert np.allclose(angles[::2], math.pi / 2) and len(angles) == 8
    one = spark.range(1).select(scalar.remaining(F.array(*[F.lit(i) for i in (1, 2, 2, 3)]), F.array(F.lit(3))).alias("r"), scalar.label(F.lit("N2"), F.lit("7")).alias("l"), scalar.mode_score([F.lit(10.0), F.lit(-100.0), F.lit(5.0)], [1.0, 1.0], [2.0, 3.0]).alias("s"))
    assert one.first().asDict() == {"r": [1, 2], "l": "N2 7", "s": 3.0}
    curves = spark.range(1).select(scalar.speed_curve(F.lit(2.0), 3.0, 4.0), scalar.bearing_curve(F.lit(2.0), 0.5), scalar.cropped(F.lit(7), F.lit(2)), scalar.uncropped(F.lit(5), F.lit(2))).first()
    assert np.allclose(list(curves), [12 * math.exp(-0.5), math.exp(-1), 5, 7])


def test_binned_events_and_centroid_model(spark):
    events = spark.createDataFrame([(0, 0, 0.26), (0, 1, 0.31), (0, 2, 0.9), (1, 0, 0.0)], "replicate long, event long, t double")
    got = {(r.replicate, r.frame): r.event for r in simulate.binned_events(events, 1.0, 0.1).collect()}
    assert len(got) == 20 and {k for k, v in got.items() if v} == {(0, 3), (0, 9), (1, 0)}
    rows = simulate.centroid_model(spark, 2, 400, 0.1, 5.0, 2.0, 0.5, 0.1, 0.05, 6.0, 2.0, seed=4).orderBy("replicate", "frame").toPandas()
    one = rows[rows.replicate == 0]
    assert len(rows) == 800 and (rows.s >= 0).all() and set(rows.dpsi.round(6)) == {0.0, round(math.pi, 6)}
    assert np.allclose(one.phi, one.psi + one.dpsi) and np.allclose(one.vx, one.s * np.cos(one.phi))
    assert np.allclose(one.x, np.r_[0, np.cumsum((one.vx.to_numpy()[1:] + one.vx.to_numpy()[:-1]) / 2 * 0.1)])


def test_sliding_autoregression(spark):
    r = np.random.default_rng(5)
    y, z = [0.0], [0.0]
    for _ in range(399):
        y.append(0.9 * y[-1] + 0.1 * z[-1] + r.normal())
        z.append(-0.1 * y[-2] + 0.8 * z[-1] + r.normal())
    rows = [(1, i, None if 200 <= i < 240 else float(a), float(b)) for i, (a, b) in enumerate(zip(y, z))]
    df = spark.createDataFrame(rows, TRACK)
    sums = models.autoregression_windows(df, ["track"], ["x", "y"], 100)
    found = {x.window: x.n for x in sums.select("window", "n").distinct().collect()}
    want = {}
    for i in range(50, 351, 10):
        n = sum(1 for k in range(i - 50, i + 50) if k > 0 and all(rows[q][2] is not None for q in (k, k - 1)))
        if n > 75:
            want[i] = n
    assert found == want
    at = 120
    k = np.arange(at - 50, at + 50)
    a = np.stack([np.ones(100), np.array(y)[k - 1], np.array(z)[k - 1]], axis=1)
    step = np.linalg.lstsq(a, np.stack([np.array(y)[k], np.array(z)[k]], axis=1), rcond=None)[0][1:].T
    rates = np.log(np.linalg.eigvals(step).astype(complex)) / 0.1
    fits = models.autoregression(sums, ["track", "window"], 2, 1, 0.1).where(F.col("window") == at).collect()
    assert np.allclose(sorted(f.frequency for f in fits), sorted(abs(rates.imag) / 2 / np.pi)) and np.allclose(sorted(f.damping for f in fits), sorted(-1 / rates.real))
    modes = models.normalised_modes(df, ["track"], ["y"]).agg(F.avg("y"), F.stddev_pop("y")).first()
    assert abs(modes[0]) < 1e-9 and abs(modes[1] - 1) < 1e-9


def test_posture_dynamics_of_a_known_system(spark):
    """A rotation that shrinks: its frequency and damping time come back."""
    turn, shrink = 0.3, 0.95
    p, rows = np.array([1.0, 0.0]), []
    for i in range(60):
        rows.append((1, i, float(p[0]), float(p[1])))
        p = shrink * np.array([[math.cos(turn), -math.sin(turn)], [math.sin(turn), math.cos(turn)]]) @ p
    sums = models.autoregression_sums(spark.createDataFrame(rows, TRACK), ["track"], ["x", "y"])
    for r in models.autoregression(sums, ["track"], 2, 1, 0.5).collect():
        assert abs(r.frequency - turn / 0.5 / 2 / math.pi) < 1e-6 and abs(r.damping + 0.5 / math.log(shrink)) < 1e-4


def test_user_curves_of_ensembles(spark):
    rows = [(g, t, i, float(t + i * i)) for g in ("a", "b") for t in range(6) for i in range(8)]
    df = spark.createDataFrame(rows, "grp string, track long, frame long, x double")

    def curve(part):
        x = part["x"].to_numpy()
        return pd.Series({lag: float((x[lag:] - x[: len(x) - lag]).mean()) for lag in (1, 2)})

    for swap in (True, False):
        got = {(r.grp, r.point): r for r in ensembles.ensemble_average(df, curve, ["grp"], 50, swap=swap).collect()}
        assert set(got) == {(g, p) for g in "ab" for p in (1.0, 2.0)} and abs(got["a", 1.0].mean - 7.0) < 1e-9 and abs(got["b", 2.0].low - 14.0) < 1e-9
    some = ensembles.subsample(df, 10, ["grp", "track", "frame"], 3)
    assert some.count() == 10 and some.exceptAll(ensembles.subsample(df.repartition(3), 10, ["grp", "track", "frame"], 3)).isEmpty()


def test_brightness(spark):
    pixels_ = [(0, r, c, 10 * c) for r in range(3) for c in range(13)]
    df = spark.createDataFrame(pixels_, "frame int, r int, c int, v int")
    line_ = spark.createDataFrame([(0, [float(x) for x in range(13)], [1.0] * 13)], "frame int, xs array<double>, ys array<double>")
    got = pixels.end_brightness(df, line_).first()
    assert (got["first"], got["last"]) == (5.0, 115.0)
    told = F.struct(F.lit(-1).alias("method"), F.lit(False).alias("flip"))
    rows = spark.createDataFrame([(10.0, 5.0), (5.0, 10.0), (10.0, 9.0), (None, 1.0)], "a double, b double").select(headtail.by_brightness(told, F.col("a"), F.col("b")).alias("h")).collect()
    assert [(x.h.method, x.h.flip) for x in rows] == [(3, False), (3, True), (-1, False), (-1, False)]


def test_food_and_edges_exclude(spark):
    arena = spark.createDataFrame([(0, 0, 0, 10, 0, 0, 100, 100)], "strain int, food_x long, food_y long, food_r long, box_x long, box_y long, box_w long, box_h long")
    df = spark.createDataFrame([(1, 0, 50, 50, False), (1, 1, 5, 60, False), (1, 2, 5, 5, True), (1, 3, 0, 11, False)], "track long, frame long, x long, y long, excluded boolean").withColumn("strain", F.lit(0))
    off = lambda **k: [r.excluded for r in chains.with_food_and_edge(df, arena, **k).orderBy("frame").collect()]
    assert off(mode="on_food") == [True, True, False, False] and off(mode="off_food") == [False, False, True, True]
    assert off(margin=10) == [False, True, True, True] and off() == [False, False, True, False]


def test_exclusion_reaches_every_curve(spark):
    """A pair across an excluded frame counts for none of the curves."""
    rows = [(1, i, 2.0 * i, 0.0, 2.0, 0.0, 2.0, 0.1, 0.0, i == 5, True) for i in range(10)]
    df = spark.createDataFrame(rows, "track long, frame long, x double, y double, vx double, vy double, s double, psi double, dpsi double, excluded boolean, oriented boolean")
    df = df.withColumns({c: F.when(~F.col("excluded"), F.col(c)) for c in ("x", "y", "vx", "vy", "s", "psi", "dpsi")})
    table = chains.correlation_table(df, [0, 2, 6], 10, 0.3)
    first = {(r.metric, r.lag): r for r in table.collect()}
    assert first["msd", 2].value == 16.0 and first["vacf", 2].value == 4.0 and abs(first["psi_acf", 2].value - 1) < 1e-12 and first["psi_trend", 2].value == 0
    assert not any(k[1] == 6 and r.value is not None for k, r in first.items())


def test_bundle_has_seven_metrics(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 2)).cumsum(axis=0)
    rows = spark.createDataFrame([(1, i, float(a), float(b), False, True, False) for i, (a, b) in enumerate(x)], "track long, frame long, x double, y double, bad boolean, oriented boolean, excluded boolean")
    moving = chains.with_reversals(chains.derived_track(rows, 1.0), 2)
    table = chains.metric_bundle(moving, [0, 1, 5], 50, [0.0, 0.5, 1.0, 2.0], 0.3)
    assert {x.metric for x in table.select("metric").distinct().collect()} == {*chains.METRICS, "s_dist"}
    assert table.where("metric = 's_dist'").count() == 4
    fits = chains.fit_model(rows, list(range(12)), 50).collect()
    assert len(fits) == 1 and set(chains.PARAMETERS) < set(fits[0].asDict()) and fits[0].mu_s > 0 and fits[0].k_psi > 0 and fits[0].length is None
    model = protocol.CentroidModel(tuple(range(12)), 50, 100)
    assert model.vectors(model.fit(rows)).first().vector[0] == fits[0].mu_s
    again = model.simulate(spark, {"mu_s": 2.0, "tau_s": 3.0, "d_s": 0.1, "k_psi": 0.1, "d_psi": 0.02, "tau_forward": 9.0, "tau_reverse": 3.0}, 2)
    assert again.count() == 200 and model.scores(model.fit(rows).withColumns({p: F.lit(10.0) for p in chains.PARAMETERS}), [0.0] * 7, [1.0] * 7).first().score == 7.0


def test_model_recovers_what_was_simulated(spark):
    true = {"mu_s": 50.0, "tau_s": 1.0, "d_s": 40.0, "k_psi": 0.15, "d_psi": 0.01, "tau_forward": 8.0, "tau_reverse": 3.0}
    runs = simulate.centroid_model(spark, 6, 4000, 0.1, *true.values(), seed=3)
    rows = runs.select(F.col("replicate").alias("track"), "frame", "x", "y", F.col("psi").alias("body"), F.lit(False).alias("bad"), F.lit(True).alias("oriented"), F.lit(False).alias("excluded"), F.lit(900.0).alias("length"))
    fits = chains.fit_model(rows, list(range(0, 120, 2)), 1000, dt=0.1, within=10, heading=F.col("body")).agg(*[F.avg(p).alias(p) for p in chains.PARAMETERS]).first()
    assert fits.length == 900.0 and abs(fits.mu_s / true["mu_s"] - 1) < 0.1 and abs(fits.k_psi / true["k_psi"] - 1) < 0.25
    assert 0.4 < fits.tau_s < 2.0 and 5 < fits.tau_forward < 14 and 1.5 < fits.tau_reverse < 5
    assert true["d_psi"] < fits.d_psi < 0.3  # the curve is not freed of the drift, which decorrelates too


def test_pixel_components_match_flood_fill(spark):
    r = random.Random(6)
    grid = {(y, x) for y in range(14) for x in range(14) if r.random() < 0.45}
    df = spark.createDataFrame([(0, y, x, 10 if (y, x) in grid else 250) for y in range(14) for x in range(14)], "frame int, r int, c int, v int")
    parts = pixels.components(pixels.labelled(pixels.dark(df, 0.5)))
    left, want = set(grid), []
    while left:
        stack, size = [left.pop()], 0
        while stack:
            y, x = stack.pop()
            size += 1
            for p in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if p in left:
                    left.remove(p)
                    stack.append(p)
        want.append(size)
    assert sorted(p.area for p in parts.collect()) == sorted(want)
    assert pixels.off_border(parts, 14, 14).count() <= parts.count()
    assert pixels.crop(df, 2, 3, 4, 5).count() == 20 and pixels.ignoring(df, df.where("r = 0")).count() == 13 * 14
    assert pixels.normalised(df).agg(F.min("v"), F.max("v")).first()[:] == (0, 255)


def test_labels_across_tiles_match_flood_fill(spark):
    r, side = random.Random(8), 2 * pixels.TILE + 9
    grids = {0: {(y, x) for y in range(side) for x in range(side) if r.random() < 0.4}, 1: {(y, x) for y in range(side) for x in range(side) if y % 4 == 0 or x == (side - 1) * (y % 8 > 4)}, 2: {(3, 4)}}
    df = spark.createDataFrame([(f, y, x) for f, grid in grids.items() for y, x in grid], "frame int, r int, c int")
    for eight in (True, False):
        near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if eight or not (a and b)]
        want = {}
        for f, grid in grids.items():
            left = set(grid)
            while left:
                stack, seen = [left.pop()], []
                while stack:
                    y, x = stack.pop()
                    seen.append((y, x))
                    for p in [(y + a, x + b) for a, b in near]:
                        if p in left:
                            left.remove(p)
                            stack.append(p)
                want |= {(f, *p): min(seen) for p in seen}
        assert {(p.frame, p.r, p.c): tuple(p.label) for p in pixels.labelled(df, eight).collect()} == want


def test_joins_of_stored_tables_pass_nothing_through_the_driver(spark):
    one, two = (store.kept(spark.range(50).select((F.col("id") % 7).alias("frame"), F.col("id").alias(n)), "small") for n in "ab")
    met = one.where("a > 3").join(two.groupBy("frame").agg(F.max("b").alias("b")), "frame")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and met.count() == 46
    labels = pixels.labelled(one.select("frame", F.col("a").cast("int").alias("r"), F.lit(60).alias("c")))
    plan = pixels.not_persistent(labels, spark.createDataFrame([(0, 60)], "r int, c int"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_a_large_mask_of_persistent_pixels_is_no_broadcast(spark):
    labels = pixels.labelled(spark.createDataFrame([(f, 0, c) for f in range(3) for c in (0, 1, 3 + f, 9)], "frame int, r int, c int"))
    few = spark.createDataFrame([(0, 1), (0, 1), (0, 4), (7, 9)], "r int, c int")
    many = few.union(spark.range(100_000).select((F.col("id") + 9).cast("int"), F.lit(4)))
    left = [pixels.not_persistent(labels, mask) for mask in (few, many)]
    assert ["Broadcast" in x._jdf.queryExecution().executedPlan().toString() for x in left] == [True, False]
    want = [(0, 3), (0, 9), (1, 9), (2, 5), (2, 9)]
    assert [sorted((p.frame, p.c) for p in x.collect()) for x in left] == [want, want]


@pytest.mark.parametrize("lags", [list(range(71)), [0, 5, *range(600, 700)]])
def test_pairs_of_many_lags_come_without_a_join(spark, monkeypatch, lags):
    monkeypatch.setattr(lagstats, "BLOCK_FRAMES", 40)
    r = random.Random(4)
    rows = [(k, i, r.uniform(-1, 1), r.random() < 0.01) for k in range(2) for i in range(720) if r.random() < 0.9]
    df = spark.createDataFrame(rows, "track long, frame long, x double, cut boolean")
    pairs = lagstats.lag_pairs(df, lags, ["x"], exclude=F.col("cut"))
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
    want = {}
    for k in range(2):
        own = {i: (x, c) for t, i, x, c in rows if t == k}
        cuts = np.cumsum([own.get(i, (0, False))[1] for i in range(720)])
        want |= {(k, n, x, own[i + n][0]): 1 for i, (x, _) in own.items() for n in lags if i + n in own and cuts[i] == cuts[i + n]}
    assert sorted(tuple(p) for p in pairs.collect()) == sorted(want)


def test_short_lists_share_a_call_from_spark(spark):
    r = random.Random(5)
    rows = spark.createDataFrame([(k, i, r.gauss(0, 1)) for k in range(30) for i in range(40)], "track long, frame long, x double")
    found = models.dynamics(models.autoregression_sums(rows, ["track"], ["x"]), ["track"], 1, 1.0)
    assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 30
    means = spark.createDataFrame([(k, float(x), math.exp(-0.01 * (k + 1) * x)) for k in range(40) for x in range(3 + k % 9)], "track long, tau double, value double")
    fits = models.fit_curve(means, ["track"], "tau", "value", "bearing")
    assert "InPandas" not in fits._jdf.queryExecution().executedPlan().toString()
    assert all(abs(f.diffusion - 0.01 * (f.track + 1)) < 1e-6 for f in fits.collect()) and fits.count() == 40


def test_a_curve_given_by_the_user_runs_once_for_each_track(spark):
    runs = spark.sparkContext.accumulator(0)

    def curve(part):
        runs.add(1)
        return part.groupby("frame")["x"].mean()

    rows = spark.createDataFrame([(k % 2, k, i, float(k * i)) for k in range(10) for i in range(4)], "strain int, track long, frame long, x double")
    assert ensembles.ensemble_average(rows, curve, ["strain"], samples=5).count() == 8 and runs.value == 10


def test_tasks_of_tracks_grow_in_number_and_not_in_rows(spark, monkeypatch):
    rows = spark.range(4000).select((F.col("id") % 800).alias("user_id"), "id")
    assert tables.in_even_tasks(rows, "user_id").rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    dealt = tables.in_even_tasks(rows, "user_id")
    assert dealt.rdd.getNumPartitions() == 40 and dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 250
