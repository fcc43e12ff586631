"""Fits of stochastic models: regressions as aggregates, curves by damped least squares on small tables of means."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window


def poisson_scale(events: DataFrame, keys: list[str], time: str) -> DataFrame:
    """keys, scale (mean gap less the least gap, which is the fitted offset) and gaps."""
    w = Window.partitionBy(*keys).orderBy(time)
    gaps = events.withColumn("__gap", F.col(time) - F.lag(time).over(w))
    return gaps.groupBy(*keys).agg((F.avg("__gap") - F.min("__gap")).alias("scale"), F.count("__gap").alias("gaps"))


def mean_reverting_fit(rows: DataFrame, keys: list[str], value: str, dt: float) -> DataFrame:
    """keys, slope, mu, tau, sigma and n of y' = a + b y: tau = dt / (1 - b), sigma = residual deviation / sqrt(dt).

    The residual deviation follows from the regression's own sums.
    """
    w = Window.partitionBy(*keys).orderBy("frame")
    pairs = rows.select(*keys, F.col(value).cast("double").alias("__y"), F.lead(value).over(w).cast("double").alias("__z"))
    sums = pairs.groupBy(*keys).agg(
        F.regr_slope("__z", "__y").alias("slope"), F.regr_intercept("__z", "__y").alias("__a"), F.regr_syy("__z", "__y").alias("__szz"), F.regr_sxy("__z", "__y").alias("__szy"), F.regr_count("__z", "__y").alias("n"),
    )
    residual = (F.col("__szz") - F.col("slope") * F.col("__szy")) / F.col("n")
    gap = F.nullif(1 - F.col("slope"), F.lit(0.0))
    return sums.select(*keys, "slope", (F.col("__a") / gap).alias("mu"), (dt / gap).alias("tau"), F.sqrt(F.greatest(residual, F.lit(0.0)) / dt).alias("sigma"), "n")


def drift_diffusion_fit(rows: DataFrame, keys: list[str], time: str, value: str, dt: float) -> DataFrame:
    """keys, drift (slope in time), start, diffusion (residual variance / 2 dt) and n."""
    t, y = F.col(time).cast("double"), F.col(value).cast("double")
    sums = rows.groupBy(*keys).agg(F.regr_slope(y, t).alias("drift"), F.regr_intercept(y, t).alias("start"), F.regr_syy(y, t).alias("__yy"), F.regr_sxy(y, t).alias("__ty"), F.regr_count(y, t).alias("n"))
    return sums.select(*keys, "drift", "start", ((F.col("__yy") - F.col("drift") * F.col("__ty")) / F.col("n") / (2 * dt)).alias("diffusion"), "n")


def mean_abs_trend(rows: DataFrame, keys: list[str], window: str, time: str, value: str) -> DataFrame:
    """keys and trend: the mean over windows of the absolute slope in each."""
    slopes = rows.groupBy(*keys, window).agg(F.regr_slope(F.col(value).cast("double"), F.col(time).cast("double")).alias("__k"))
    return slopes.groupBy(*keys).agg(F.avg(F.abs("__k")).alias("trend"), F.count("__k").alias("windows"))


Curve = Callable[[np.ndarray, np.ndarray], np.ndarray]
CURVES: dict[str, tuple[Curve, list[float], list[tuple[float, float]], list[str]]] = {
    # name: curve, start, bounds, names of its parameters
    "reversal": (lambda t, p: (1 - p[1]) * np.exp(-t / p[0]) + p[1], [1.0, 0.5], [(1e-6, 1e6), (0.0, 1.0)], ["tau", "plateau"]),
    "bearing": (lambda t, p: np.exp(-p[0] * t), [0.1], [(0.0, 1e6)], ["diffusion"]),
    "speed": (lambda t, p: p[0] * p[1] * np.exp(-t / p[1]), [1.0, 1.0], [(0.0, 1e12), (1e-6, 1e6)], ["diffusion", "tau"]),
}


def least_squares(curve: Curve, t: np.ndarray, y: np.ndarray, start: list[float], bounds: list[tuple[float, float]], rounds: int = 200) -> np.ndarray:
    """Damped Gauss-Newton within bounds."""
    lo, hi = np.array(bounds).T
    p, damp = np.clip(np.array(start, float), lo, hi), 1e-2
    cost = float(((curve(t, p) - y) ** 2).sum())
    for _ in range(rounds):
        base = curve(t, p)
        step = 1e-6 * np.maximum(np.abs(p), 1e-3)
        jac = np.stack([(curve(t, p + s * e) - base) / s for s, e in zip(step, np.eye(len(p)), strict=True)], axis=1)
        a, g = jac.T @ jac, jac.T @ (base - y)
        move = -np.linalg.lstsq(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), g, rcond=None)[0]
        new = np.clip(p + move, lo, hi)
        trial = float(((curve(t, new) - y) ** 2).sum())
        if trial <= cost:
            done = cost - trial <= 1e-14 * max(cost, 1e-300)
            p, cost, damp = new, trial, max(damp / 4, 1e-12)
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return p


def _listed(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each of the keys, with the columns as lists, ordered by the first of them."""
    cells = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("__cells"))
    return cells.select(*keys, *[F.col(f"__cells.{n}").alias(n) for n in columns])


def _of_each(listed: DataFrame, keys: list[str], columns: list[str], solve: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """keys and the rows that solve makes of the lists of each. Many short lists share a batch: a call from Spark for each of them would cost more than the work."""
    kinds = T.StructType.fromDDL(schema)
    names = [f.name for f in kinds][len(keys) :]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(kinds)
        for b in batches:
            made = [solve(*lists) for lists in zip(*[b[c].to_pylist() for c in columns], strict=True)]
            at = pa.array(np.repeat(np.arange(len(made)), [len(rows) for rows in made]), pa.int64())
            held = [b[k].take(at) for k in keys]
            own = [pa.array([row[i] for rows in made for row in rows], types.field(len(keys) + i).type) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*held, *own], names=[*keys, *names])

    return listed.select(*keys, *columns).mapInArrow(read, kinds)


def fit_curve(means: DataFrame, keys: list[str], time: str, value: str, kind: str, scale_start: bool = True) -> DataFrame:
    """keys and the parameters of one of CURVES, fitted to each key's few hundred means; NULL where a fit fails.

    The means come from a grouped aggregate, so a group has one row per lag however long its track is.
    """
    curve, start, bounds, names = CURVES[kind]
    key_types = ", ".join(f"{k} {means.schema[k].dataType.simpleString()}" for k in keys)

    def fit(times: list[float], values: list[float]) -> list[tuple]:
        t, y = np.array(times, float), np.array(values, float)
        out = [None] * len(names)
        if len(t) > len(names):
            first = list(start)
            if scale_start and kind == "speed":
                first = [max(y[np.argmin(t)], 1e-9), max(float(np.ptp(t)) / 3, 1e-3)]
            elif scale_start and kind == "reversal":
                first = [max(float(np.ptp(t)) / 5, 1e-3), float(np.clip(y[np.argmax(t)], 0, 1))]
            p = least_squares(curve, t, y, first, bounds)
            out = p.tolist() if np.isfinite(p).all() else out
        return [tuple(out)]

    present = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    points = F.when(present(time) & present(value), F.struct(F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("v")))
    listed = means.groupBy(*keys).agg(F.array_sort(F.collect_list(points)).alias("__p")).select(*keys, F.col("__p.t").alias("__t"), F.col("__p.v").alias("__v"))
    return _of_each(listed, keys, ["__t", "__v"], fit, f"{key_types}, {', '.join(f'{n} double' for n in names)}")


def reversal_rates(fits: DataFrame) -> DataFrame:
    """The fits of "reversal" with the fraction of time in reverse and the two mean stays."""
    share = 0.5 - F.sqrt(F.col("plateau") / 4)
    rows = fits.withColumn("reverse_share", share)
    return rows.withColumns({"tau_reverse": F.col("tau") / (1 - F.col("reverse_share")), "tau_forward": F.col("tau") / F.nullif("reverse_share", F.lit(0.0))})


def autoregression_sums(rows: DataFrame, keys: list[str], columns: list[str], order: int = 1) -> DataFrame:
    """keys, i, j, s and n: sums of products of the regressors (1, then lags 1..order of each column) and, from index 1000 on, the present values."""
    w = Window.partitionBy(*keys).orderBy("frame")
    terms = _terms(w, columns, order)
    lagged = rows.select(*keys, *[e.alias(f"__{i}") for i, e in terms])
    return _sums(lagged.dropna(subset=[f"__{i}" for i, _ in terms]), keys, terms)


def _terms(w: Window, columns: list[str], order: int) -> list[tuple[int, Column]]:
    """(index, value) of the constant, the lagged and, from 1000 on, the present values."""
    past = [F.lag(c, k).over(w) for k in range(1, order + 1) for c in columns]
    return [(0, F.lit(1.0)), *[(i + 1, e.cast("double")) for i, e in enumerate(past)], *[(1000 + i, F.col(c).cast("double")) for i, c in enumerate(columns)]]


def _sums(whole: DataFrame, keys: list[str], terms: list[tuple[int, Column]]) -> DataFrame:
    sums = whole.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(F.col(f"__{i}") * F.col(f"__{j}")).alias(f"{i}_{j}") for i, _ in terms for j, _ in terms if i <= j])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"{i}_{j}").alias("s")) for i, _ in terms for j, _ in terms if i <= j])
    return sums.select(*keys, "n", F.inline(cells))


def autoregression_windows(rows: DataFrame, keys: list[str], columns: list[str], size: int, order: int = 1, least_present: float = 0.75) -> DataFrame:
    """keys, window (the middle frame) and autoregression_sums() of each window of size frames whose columns are present in more than least_present of them.

    Windows start every tenth of their size. The lags look back before windows are
    formed, so a window's first frames keep their past.
    """
    step, w = max(1, size // 10), Window.partitionBy(*keys).orderBy("frame")
    terms = _terms(w, columns, order)
    lagged = rows.select(*keys, "frame", *[e.alias(f"__{i}") for i, e in terms], F.max("frame").over(Window.partitionBy(*keys)).alias("__last"))
    half = size // 2
    first = F.greatest(F.floor((F.col("frame") - size) / step) + 1, F.lit(0))
    listed = lagged.withColumn("__no", F.explode(F.sequence(first, F.floor(F.col("frame") / step)))).withColumn("window", F.col("__no") * step + half).where(F.col("window") + half <= F.col("__last") + 1)
    whole = listed.dropna(subset=[f"__{i}" for i, _ in terms])
    return _sums(whole, [*keys, "window"], terms).where(F.col("n") > least_present * size)


def normalised_modes(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows with each column less its mean over its deviation, within keys."""
    w = Window.partitionBy(*keys)
    return rows.withColumns({c: (F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_pop(c).over(w), F.lit(0.0)) for c in columns})


def autoregression(sums: DataFrame, keys: list[str], dims: int, order: int, dt: float) -> DataFrame:
    """keys, mode, frequency and damping time of each eigenvalue of the fitted dynamics, from autoregression_sums()."""
    p = 1 + dims * order
    key_types = ", ".join(f"{k} {sums.schema[k].dataType.simpleString()}" for k in keys)

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        at = {i: i for i in range(p)} | {1000 + d: p + d for d in range(dims)}
        m = np.zeros((p + dims, p + dims))
        for i, j, s in zip(part["i"], part["j"], part["s"], strict=True):
            m[at[i], at[j]] = m[at[j], at[i]] = s
        b = np.linalg.lstsq(m[:p, :p], m[:p, p:], rcond=None)[0]
        step = np.zeros((dims * order, dims * order))
        step[:dims] = b[1:].T
        step[dims:, :-dims] = np.eye(dims * (order - 1))
        rates = np.log(np.linalg.eigvals(step).astype(complex) + 1e-300) / dt
        order_ = np.lexsort((rates.imag, -rates.real))
        return pd.DataFrame([[*key, i, abs(r.imag) / (2 * np.pi), -1 / r.real if r.real else None] for i, r in enumerate(rates[order_])], columns=[*keys, "mode", "frequency", "damping"])

    return sums.groupBy(*keys).applyInPandas(solve, f"{key_types}, mode int, frequency double, damping double")


def dynamics(sums: DataFrame, keys: list[str], dims: int, dt: float, damp: float = 0.0) -> DataFrame:
    """keys, mode, frequency, damping and noise of first-order dynamics without a constant, from autoregression_sums() or autoregression_windows().

    The step matrix comes from least squares, with damp**2 added to its diagonal. Of each eigenvalue l, frequency is
    its angle over a turn, and damping -sign(Re l) / log|l|, in time: a mode that changes
    its sign from frame to frame has the opposite one. noise is the deviation of the residuals of the
    amplitude of that number, over the root of dt. Modes come by falling damping time.
    """
    key_types = ", ".join(f"{k} {sums.schema[k].dataType.simpleString()}" for k in keys)

    def solve(i_: list[int], j_: list[int], sums_: list[float]) -> list[tuple]:
        at = {0: 0} | {i + 1: i + 1 for i in range(dims)} | {1000 + d: 1 + dims + d for d in range(dims)}
        m = np.zeros((1 + 2 * dims, 1 + 2 * dims))
        for i, j, s in zip(i_, j_, sums_, strict=True):
            m[at[i], at[j]] = m[at[j], at[i]] = s
        n, past, now = m[0, 0], slice(1, 1 + dims), slice(1 + dims, None)
        w = np.linalg.lstsq(m[past, past] + damp**2 * np.eye(dims), m[past, now], rcond=None)[0]
        squares = np.diag(m[now, now] - w.T @ m[past, now] - m[now, past] @ w + w.T @ m[past, past] @ w)
        noise = np.sqrt(np.maximum(squares / n - ((m[0, now] - m[0, past] @ w) / n) ** 2, 0) / dt)
        l = np.linalg.eigvals(w).astype(complex)  # noqa: E741
        with np.errstate(divide="ignore", invalid="ignore"):
            damping = -np.sign(l.real) / (np.log(np.abs(l)) / dt)
        frequency = np.abs(np.angle(l)) / dt / (2 * np.pi)
        order = np.lexsort((frequency, -damping))
        return [(i, float(frequency[k]), float(damping[k]) if np.isfinite(damping[k]) else None, float(noise[i])) for i, k in enumerate(order)]

    listed = _listed(sums.withColumn("s", F.coalesce("s", F.lit(float("nan")))), keys, ["i", "j", "s"])
    return _of_each(listed, keys, ["i", "j", "s"], solve, f"{key_types}, mode int, frequency double, damping double, noise double")
