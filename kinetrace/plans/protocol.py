"""What a model of tracks offers, and the model of centroids as one."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.functions.scalar import mode_score
from kinetrace.operators import simulate
from kinetrace.plans import chains


class TrackModel(Protocol):
    """A model has named parameters, is fitted to many tracks at once, and simulates replicates of one set of parameters."""

    parameters: tuple[str, ...]

    def fit(self, rows: DataFrame) -> DataFrame:
        """track and a column for each of the parameters."""

    def simulate(self, spark: SparkSession, vector: dict[str, float], replicates: int, seed: int = 0) -> DataFrame:
        """replicate, frame and the simulated columns."""


@dataclass(frozen=True)
class CentroidModel:
    """Mean-reverting speed, drifting and diffusing bearing, reversals as a two-state process."""

    lags: tuple[int, ...]
    window: int
    frames: int
    dt: float = 1.0
    parameters: tuple[str, ...] = chains.PARAMETERS

    def fit(self, rows: DataFrame) -> DataFrame:
        return chains.fit_model(rows, list(self.lags), self.window, dt=self.dt)

    def simulate(self, spark: SparkSession, vector: dict[str, float], replicates: int, seed: int = 0) -> DataFrame:
        return simulate.centroid_model(spark, replicates, self.frames, self.dt, *[vector[p] for p in self.parameters[:7]], seed=seed)

    def vectors(self, fits: DataFrame) -> DataFrame:
        """track and vector: the parameters in their order."""
        return fits.select("track", F.array(*self.parameters).alias("vector"))

    def scores(self, fits: DataFrame, means: list[float], mode: list[float]) -> DataFrame:
        """track and score on a mode of traits with an entry for each of the first parameters."""
        return fits.select("track", mode_score([F.col(p) for p in self.parameters], means, mode).alias("score"))
