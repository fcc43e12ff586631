"""Covariances, modes and projections of posture vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrace.functions.scalar import dot


MOST_KEYS = 256


def covariance(rows: DataFrame, posture: str = "posture", keys: list[str] | None = None) -> DataFrame:
    """keys, i, j and cov (sample covariance) over the complete vectors; i, j count from 0.

    Each task adds up vectors and products before the shuffle, so what is
    shuffled is one matrix per task and key.
    """
    keys = keys or []
    complete = rows.where(~F.exists(posture, lambda x: x.isNull()))
    sums = complete.select(*keys, F.col(posture).alias("__v")).mapInArrow(_products(keys), _sum_schema(complete, keys))
    totals = sums.groupBy(*keys, "i", "j").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("ab").alias("ab"))
    return totals.select(*keys, "i", "j", ((F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))).alias("cov"))


def _sum_schema(rows: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([*[rows.schema[k] for k in keys], *T.StructType.fromDDL("i int, j int, n long, a double, b double, ab double").fields])


def _products(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per batch and key the sums of vectors and of their products, one matrix each: MOST_KEYS matrices are held before they go on."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def table() -> Iterator[pa.RecordBatch]:
            for (key, n), (count, total, products) in held.items():
                i, j = np.divmod(np.arange(n * n, dtype=np.int32), n)
                columns = [pa.array([k] * (n * n), kinds[x]) for x, k in enumerate(key)]
                numbers = [pa.array(i), pa.array(j), pa.array(np.full(n * n, count)), pa.array(total[i]), pa.array(total[j]), pa.array(products.ravel())]
                yield pa.RecordBatch.from_arrays([*columns, *numbers], names=[*keys, "i", "j", "n", "a", "b", "ab"])
            held.clear()

        for batch in batches:
            kinds = [batch[k].type for k in keys]
            groups: dict[tuple, list[int]] = {}
            for row, key in enumerate(zip(*[batch[k].to_pylist() for k in keys], strict=True) if keys else [()] * batch.num_rows):
                groups.setdefault(key, []).append(row)
            for key, at in groups.items():
                part = batch["__v"].take(pa.array(at))
                sizes = np.diff(part.offsets.to_numpy())
                flat = part.flatten().to_numpy(zero_copy_only=False)
                for n in np.unique(sizes):
                    x = flat[np.repeat(sizes == n, sizes)].reshape(-1, n) if n else np.zeros((0, 0))
                    old = held.get((key, int(n)), (0, 0.0, 0.0))
                    held[key, int(n)] = (old[0] + len(x), old[1] + x.sum(axis=0), old[2] + x.T @ x)
            if len(held) > MOST_KEYS:
                yield from table()
        yield from table()

    return add


def modes(cov: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and eigenvectors in columns, each with its largest component positive, of one covariance table.

    The table has one row per pair of posture points, some thousands whatever the number of frames.
    """
    cells = cov.select("i", "j", "cov").toPandas()
    n = int(cells["i"].max()) + 1
    matrix = np.zeros((n, n))
    matrix[cells["i"], cells["j"]] = cells["cov"]
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(n)]
    return values, vectors * np.where(lead < 0, -1.0, 1.0)


def explained(spark: SparkSession, values: np.ndarray) -> DataFrame:
    """mode, eigenvalue and the cumulated share of variance."""
    share = np.cumsum(values) / values.sum()
    return spark.createDataFrame([(i + 1, float(v), float(s)) for i, (v, s) in enumerate(zip(values, share, strict=True))], "mode int, eigenvalue double, cumulated double")


def projection(posture: Column, vector: list[float]) -> Column:
    """Amplitude of a mode; NULL if an angle is missing."""
    return F.when(~F.exists(posture, lambda x: x.isNull()), dot(posture, F.array(*[F.lit(float(v)) for v in vector])))


def end_variance(rows: DataFrame, keys: list[str], posture: str = "posture", points: int = 5) -> DataFrame:
    """keys, head_sd, tail_sd and ratio: deviations over frames of each of the first and last angles, summed over the angles of an end."""
    angles = rows.select(*keys, F.size(posture).alias("__n"), F.posexplode(posture).alias("__i", "__a"))
    ends = angles.where((F.col("__i") < points) | (F.col("__i") >= F.col("__n") - points))
    each = ends.groupBy(*keys, "__i").agg(F.stddev_pop("__a").alias("__sd"), F.max("__n").alias("__n"))
    head, tail = F.when(F.col("__i") < points, F.col("__sd")), F.when(F.col("__i") >= F.col("__n") - points, F.col("__sd"))
    out = each.groupBy(*keys).agg(F.sum(head).alias("head_sd"), F.sum(tail).alias("tail_sd"))
    return out.withColumn("ratio", F.col("head_sd") / F.nullif("tail_sd", F.lit(0.0)))
