"""Which end of each segment is the head: CASE cascades over segment aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_posture(ratio: Column, delay: Column, move: Column, least_ratio: float = 1.2, least_delay: float = 0.08, least_move: float = 0.05) -> Column:
    """Struct (method, flip): 1 by variance of the ends, 3 by the wave's delay, 2 by head movements, 0 if none tells."""
    return (
        F.when(ratio > least_ratio, F.struct(F.lit(1).alias("method"), F.lit(False).alias("flip")))
        .when(ratio < 1 / least_ratio, F.struct(F.lit(1).alias("method"), F.lit(True).alias("flip")))
        .when(F.abs(delay) > least_delay, F.struct(F.lit(3).alias("method"), (delay < 0).alias("flip")))
        .when(F.abs(move) > least_move, F.struct(F.lit(2).alias("method"), (move < 0).alias("flip")))
        .otherwise(F.struct(F.lit(0).alias("method"), F.lit(False).alias("flip")))
    )


def by_variance(ratio: Column, least: float = 1.2) -> Column:
    """Struct (method, flip): 3 where the ends' variances tell, else 0."""
    told = (ratio > least) | (ratio < 1 / least)
    return F.struct(F.when(told, 3).otherwise(0).alias("method"), F.coalesce(told & (ratio < 1), F.lit(False)).alias("flip"))


def leading_counts(rows: DataFrame, keys: list[str], forward: Column, valid: Column) -> DataFrame:
    """keys, n_head and n_tail: valid frames in which motion is towards the first end, and towards the last."""
    return rows.groupBy(*keys).agg(F.count_if(valid & forward).alias("n_head"), F.count_if(valid & ~forward).alias("n_tail"))


def by_motion(speed: Column, head: Column, tail: Column, head_speed: Column, tail_speed: Column, least_speed: float = 40.0, least_lead: float = 1.3, least_end: float = 1.1) -> Column:
    """Struct (method, flip): 1 by which end leads in fast segments, else 2 by the faster end, else -1."""
    lead = F.greatest(head, tail) / F.nullif(F.least(head, tail), F.lit(0))
    leads = (speed > least_speed) & (F.greatest(head, tail) > 0) & (F.coalesce(lead, F.lit(float("inf"))) > least_lead)
    ends = F.greatest(head_speed, tail_speed) / F.nullif(F.least(head_speed, tail_speed), F.lit(0.0)) > least_end
    return (
        F.when(leads, F.struct(F.lit(1).alias("method"), (tail > head).alias("flip")))
        .when(ends, F.struct(F.lit(2).alias("method"), (tail_speed > head_speed).alias("flip")))
        .otherwise(F.struct(F.lit(-1).alias("method"), F.lit(False).alias("flip")))
    )


def by_brightness(told: Column, first: Column, last: Column, least: float = 0.2) -> Column:
    """told (method, flip), and 3 by the brighter end where no other rule tells."""
    first_leads, last_leads = (first - last) / F.nullif(first, F.lit(0.0)) > least, (last - first) / F.nullif(last, F.lit(0.0)) > least
    grey = F.when(first_leads, F.struct(F.lit(3).alias("method"), F.lit(False).alias("flip"))).when(last_leads, F.struct(F.lit(3).alias("method"), F.lit(True).alias("flip")))
    return F.when(told["method"] > 0, told).otherwise(F.coalesce(grey, told))


def nearest_ends(hx: Column, hy: Column, tx: Column, ty: Column, px: Column, py: Column, qx: Column, qy: Column) -> Column:
    """Whether head (h) and tail (t) lie nearer to the last tail (q) and head (p): then the ends are crossed."""
    d = lambda ax, ay, bx, by: (ax - bx) * (ax - bx) + (ay - by) * (ay - by)
    return d(hx, hy, qx, qy) + d(tx, ty, px, py) < d(hx, hy, px, py) + d(tx, ty, qx, qy)
