"""Seeded simulations, one replicate per group: rows of (replicate, frame, …)."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.operators import kinematics

Step = Callable[[float, float], float]


def euler(spark: SparkSession, replicates: int, frames: int, dt: float, start: float, pull: Step, push: Step, seed: int = 0) -> DataFrame:
    """replicate, frame, y of dy = pull(y, t) dt + push(y, t) dW by Euler-Maruyama; a replicate's numbers depend on seed and replicate only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rep in batch["id"]:
                noise = np.random.default_rng([seed, int(rep)]).standard_normal(frames)
                y = np.empty(frames)
                y[0] = start
                for i in range(1, frames):
                    t = (i - 1) * dt
                    y[i] = y[i - 1] + pull(y[i - 1], t) * dt + push(y[i - 1], t) * np.sqrt(dt) * noise[i]
                yield pd.DataFrame({"replicate": int(rep), "frame": np.arange(frames), "y": y})

    return spark.range(replicates).mapInPandas(run, "replicate long, frame long, y double")


def mean_reverting(spark: SparkSession, replicates: int, frames: int, dt: float, mu: float, tau: float, sigma: float, seed: int = 0) -> DataFrame:
    return euler(spark, replicates, frames, dt, mu, lambda y, t: (mu - y) / tau, lambda y, t: sigma, seed)


def mean_reverting_of(parameters: DataFrame, frames: int, dt: float, seed: int = 0) -> DataFrame:
    """track, frame, y: one path for each row of (track, mu, tau, sigma), all paths of a batch stepped together; a track's numbers depend on seed and track only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            mu, tau, sigma = (batch[c].to_numpy(float) for c in ("mu", "tau", "sigma"))
            noise = np.stack([np.random.default_rng([seed, int(t)]).standard_normal(frames) for t in batch["track"]], axis=1) if len(batch) else np.empty((frames, 0))
            y = np.empty((frames, len(batch)))
            y[0] = mu
            for i in range(1, frames):
                y[i] = y[i - 1] + (mu - y[i - 1]) / tau * dt + sigma * np.sqrt(dt) * noise[i]
            yield pd.DataFrame({"track": np.repeat(batch["track"].to_numpy(), frames), "frame": np.tile(np.arange(frames), len(batch)), "y": y.T.ravel()})

    return parameters.select("track", "mu", "tau", "sigma").mapInPandas(run, "track long, frame long, y double")


def drift_diffusion(spark: SparkSession, replicates: int, frames: int, dt: float, rate: float, diffusion: float, seed: int = 0) -> DataFrame:
    return euler(spark, replicates, frames, dt, 0.0, lambda y, t: rate, lambda y, t: float(np.sqrt(2 * diffusion)), seed)


def poisson_events(spark: SparkSession, replicates: int, scale: float, until: float, seed: int = 0) -> DataFrame:
    """replicate, event, t: exponential gaps of mean scale up to the time until."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rep in batch["id"]:
                r, times, t = np.random.default_rng([seed, 7, int(rep)]), [], 0.0
                while (t := t + r.exponential(scale)) <= until:
                    times.append(t)
                yield pd.DataFrame({"replicate": int(rep), "event": np.arange(len(times)), "t": times})

    return spark.range(replicates).mapInPandas(run, "replicate long, event long, t double")


def binned_events(events: DataFrame, until: float, dt: float) -> DataFrame:
    """replicate, frame and event (1 where some event's time is nearest to the frame, else 0) of poisson_events() up to until."""
    frames = int(until / dt + 0.5)
    hit = events.select("replicate", F.rint(F.col("t") / dt).cast("long").alias("frame")).distinct().withColumn("__hit", F.lit(1))
    every = events.select("replicate").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(frames - 1).cast("long"))))
    return every.join(hit, ["replicate", "frame"], "left").select("replicate", "frame", F.coalesce("__hit", F.lit(0)).alias("event"))


def centroid_model(spark: SparkSession, replicates: int, frames: int, dt: float, mu_s: float, tau_s: float, d_s: float, k_psi: float, d_psi: float, tau_forward: float, tau_reverse: float, seed: int = 0) -> DataFrame:
    """replicate, frame, t, s, psi, dpsi, phi, vx, vy, x, y of an animal by the parameters of the model.

    A mean-reverting speed (not below 0), a drifting and diffusing body bearing
    and a two-state process of reversals (dpsi is pi in reverse) give the velocity;
    its running trapezoid sums are the positions, from 0.
    """
    keys = ["replicate", "frame"]
    pace = mean_reverting(spark, replicates, frames, dt, mu_s, tau_s, float(np.sqrt(2 * d_s)), seed).select(*keys, F.greatest("y", F.lit(0.0)).alias("s"))
    heading = drift_diffusion(spark, replicates, frames, dt, k_psi, d_psi, seed + 1).withColumnRenamed("y", "psi")
    back = two_state(spark, replicates, frames, dt, tau_forward, tau_reverse, seed + 2)
    rows = pace.join(heading, keys).join(back, keys).withColumn("dpsi", F.when(F.col("reverse"), math.pi).otherwise(0.0)).withColumn("phi", F.col("psi") + F.col("dpsi"))
    rows = rows.withColumns({"vx": F.col("s") * F.cos("phi"), "vy": F.col("s") * F.sin("phi")}).withColumn("track", F.col("replicate"))
    placed = kinematics.integrate(kinematics.integrate(rows, "vx", "x", dt), "vy", "y", dt)
    return placed.select(*keys, (F.col("frame") * dt).alias("t"), "s", "psi", "dpsi", "phi", "vx", "vy", "x", "y")


def two_state(spark: SparkSession, replicates: int, frames: int, dt: float, tau_forward: float, tau_reverse: float, seed: int = 0) -> DataFrame:
    """replicate, frame, reverse: a process that stays exponential times in each state, forward first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rep in batch["id"]:
                r, out, state, t = np.random.default_rng([seed, 11, int(rep)]), np.zeros(frames, bool), False, 0.0
                while t < frames * dt:
                    stay = r.exponential(tau_reverse if state else tau_forward)
                    out[int(np.ceil(t / dt)) : int(np.ceil((t + stay) / dt))] = state
                    t, state = t + stay, not state
                yield pd.DataFrame({"replicate": int(rep), "frame": np.arange(frames), "reverse": out})

    return spark.range(replicates).mapInPandas(run, "replicate long, frame long, reverse boolean")


def phase_surrogates(rows: DataFrame, keys: list[str], value: str, seed: int = 0) -> DataFrame:
    """keys, frame, surrogate: each series with its amplitude spectrum and random phases (one less frame if their number is even)."""
    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def shuffle(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("frame")
        x = part[value].to_numpy(float)
        x = x[: len(x) - (len(x) % 2 == 0)]
        spectrum = np.fft.rfft(x)
        phases = np.random.default_rng([seed, *[zlib.crc32(str(k).encode()) for k in key]]).uniform(0, 2 * np.pi, len(spectrum))
        phases[0] = 0
        new = np.fft.irfft(np.abs(spectrum) * np.exp(1j * (np.angle(spectrum) * (np.arange(len(spectrum)) == 0) + phases)), n=len(x))
        out = pd.DataFrame({"frame": part["frame"].to_numpy()[: len(x)], "surrogate": new})
        for k, v in zip(keys, key, strict=True):
            out.insert(0, k, v)
        return out[[*keys, "frame", "surrogate"]]

    return rows.select(*keys, "frame", value).groupBy(*keys).applyInPandas(shuffle, f"{types}, frame long, surrogate double")
