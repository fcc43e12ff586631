"""Statistics of a track against itself or another series some frames later.

lag_pairs() gives the pairs (frame, frame + lag). For some dozens of lags they
come from one window per track: each row looks ahead, so nothing is joined and
the pairs meet in partial sums before the next shuffle. For more lags the windows are
those of blocks of frames, with copies of the frames that the block before looks at, which
spreads a long track over the cluster; AT_ONCE lags are looked up in one pass. A pair is left out if an excluded frame lies in (frame, frame + lag];
the first frame itself is not tested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


FEW_LAGS = 64
#: Lags of one pass over the blocks, and the least frames of a block; longest lags ask for longer ones.
AT_ONCE, BLOCK_FRAMES = 128, 50_000


def lag_pairs(rows: DataFrame, lags: list[int], values: list[str], keys: list[str] | None = None, exclude: Column | None = None) -> DataFrame:
    """keys, lag, and for each value v its v0 at a frame and v1 at lag frames later. keys default to track; frames are unique in them."""
    keys = keys or ["track"]
    w = Window.partitionBy(*keys).orderBy("frame")
    flag = F.coalesce(exclude, F.lit(False)).cast("int") if exclude is not None else F.lit(0)
    base = rows.select(*keys, "frame", *values, F.sum(flag).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__cut"))
    now = [F.col(v).alias(f"{v}0") for v in values]
    if len(lags) <= FEW_LAGS:
        later = F.struct("frame", "__cut", *values)
        looked = base.withColumns({f"__to{n}": F.lead(later, n).over(w) if n else later for n in lags})
        ahead = F.array(*[F.struct(F.lit(n).cast("long").alias("lag"), F.col(f"__to{n}").alias("to")) for n in lags])
        pairs = looked.select(*keys, "frame", "__cut", *now, F.explode(ahead).alias("p")).where((F.col("p.to.frame") == F.col("frame") + F.col("p.lag")) & (F.col("p.to.__cut") == F.col("__cut")))
        return pairs.select(*keys, F.col("p.lag").alias("lag"), *[f"{v}0" for v in values], *[F.col(f"p.to.{v}").alias(f"{v}1") for v in values])
    size, farthest = max(BLOCK_FRAMES, 4 * max(lags)), max(lags)
    own = F.floor(F.col("frame") / size)
    before = F.floor(F.greatest(F.col("frame") - farthest, F.lit(0)) / size)
    blocks = base.withColumn("__block", F.explode(F.sequence(F.least(before, own), own)))
    ahead = Window.partitionBy(*keys, "__block").orderBy("frame")
    later, out = F.struct("frame", "__cut", *values), None
    # of dense lags all rows up to the farthest frame are looked at, of few far ones the frames themselves
    dense = farthest < 2 * len(lags)
    steps = list(range(farthest + 1)) if dense else lags
    for part in (steps[i : i + AT_ONCE] for i in range(0, len(steps), AT_ONCE)):
        at = {f"__to{n}": (F.lead(later, n).over(ahead) if n else later) if dense else F.first(later).over(ahead.rangeBetween(n, n)) for n in part}
        looked = blocks.withColumns(at).where(F.col("__block") == own)
        pairs = looked.select(*keys, "frame", "__cut", *now, F.explode(F.array(*at)).alias("to")).withColumn("lag", F.col("to.frame") - F.col("frame"))
        pairs = pairs.where(F.col("lag").isin(*lags) & (F.col("to.__cut") == F.col("__cut"))).select(*keys, F.col("lag").cast("long").alias("lag"), *[f"{v}0" for v in values], *[F.col(f"to.{v}").alias(f"{v}1") for v in values])
        out = pairs if out is None else out.unionByName(pairs)
    return out


def mean_over_pairs(pairs: DataFrame, keys: list[str], out: str, value: Column) -> DataFrame:
    return pairs.groupBy(*keys, "lag").agg(F.avg(value).alias(out), F.count(value).alias("pairs"))


def squared_displacement(rows: DataFrame, lags: list[int], columns: list[str], keys: list[str] | None = None, exclude: Column | None = None) -> DataFrame:
    """keys, lag, msd and pairs: mean squared distance between frames lag apart; 0 at lag 0 only."""
    keys = keys or ["track"]
    total = None
    for c in columns:
        d = F.col(f"{c}1") - F.col(f"{c}0")
        total = d * d if total is None else total + d * d
    return mean_over_pairs(lag_pairs(rows, lags, columns, keys, exclude), keys, "msd", total)


def drift(rows: DataFrame, lags: list[int], column: str, keys: list[str] | None = None, exclude: Column | None = None) -> DataFrame:
    """keys, lag, drift and pairs: mean change over lag frames."""
    keys = keys or ["track"]
    return mean_over_pairs(lag_pairs(rows, lags, [column], keys, exclude), keys, "drift", F.col(f"{column}1") - F.col(f"{column}0"))


def vector_autocorrelation(rows: DataFrame, lags: list[int], columns: list[str], keys: list[str] | None = None, exclude: Column | None = None) -> DataFrame:
    """keys, lag, dotacf and pairs: mean product with the vector lag frames later, neither centred nor scaled."""
    keys = keys or ["track"]
    total = None
    for c in columns:
        d = F.col(f"{c}1") * F.col(f"{c}0")
        total = d if total is None else total + d
    return mean_over_pairs(lag_pairs(rows, lags, columns, keys, exclude), keys, "dotacf", total)


def _centred(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    stats = rows.groupBy(*keys).agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.var_pop(c).alias(f"__v_{c}") for c in columns])
    joined = rows.join(stats, keys)
    return joined.withColumns({c: F.col(c) - F.col(f"__m_{c}") for c in columns})


def autocovariance(rows: DataFrame, lags: list[int], column: str, keys: list[str] | None = None, exclude: Column | None = None) -> DataFrame:
    """keys, lag, acv, var and pairs: mean product of deviations from the series' mean, and the series' variance."""
    keys = keys or ["track"]
    rows = _centred(rows, [column], keys).withColumn("__v", F.col(f"__v_{column}"))
    pairs = lag_pairs(rows, lags, [column, "__v"], keys, exclude)
    return pairs.groupBy(*keys, "lag").agg(F.avg(F.col(f"{column}0") * F.col(f"{column}1")).alias("acv"), F.first("__v0").alias("var"), F.count(F.col(f"{column}0") * F.col(f"{column}1")).alias("pairs"))


def autocorrelation(rows: DataFrame, lags: list[int], column: str, keys: list[str] | None = None, exclude: Column | None = None) -> DataFrame:
    """keys, lag, acf and pairs: autocovariance over the population variance; 1 at lag 0, no row where no pair is left."""
    keys = keys or ["track"]
    cov = autocovariance(rows, lags, column, keys, exclude)
    return cov.select(*keys, "lag", F.when(F.col("lag") == 0, 1.0).otherwise(F.col("acv") / F.nullif("var", F.lit(0.0))).alias("acf"), "pairs")


def cross_correlation(rows: DataFrame, most: int, a: str, b: str, keys: list[str] | None = None, exclude: Column | None = None) -> DataFrame:
    """keys, lag from -most to most - 1, ccf and pairs: a now with b lag frames later, over both deviations."""
    keys = keys or ["track"]
    rows = _centred(rows, [a, b], keys).withColumn("__s", F.sqrt(F.col(f"__v_{a}") * F.col(f"__v_{b}")))
    pairs = lag_pairs(rows, list(range(most + 1)), [a, b, "__s"], keys, exclude)
    forth = pairs.where(f"lag < {most}").select(*keys, "lag", (F.col(f"{a}0") * F.col(f"{b}1")).alias("p"), "__s0")
    back = pairs.where("lag > 0").select(*keys, (-F.col("lag")).alias("lag"), (F.col(f"{b}0") * F.col(f"{a}1")).alias("p"), "__s0")
    both = forth.unionByName(back)
    return both.groupBy(*keys, "lag").agg((F.avg("p") / F.nullif(F.first("__s0"), F.lit(0.0))).alias("ccf"), F.count("p").alias("pairs"))


def partial_autocorrelation(acf: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, lag and pacf by the Durbin-Levinson recursion over lags 0, 1, 2, … of an acf table.

    The recursion carries the coefficients of the last order along: a fold over
    the array of a track's correlations, which has one entry per lag.
    """
    keys = keys or ["track"]
    lists = acf.where("lag > 0").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda x: x["acf"]).alias("r"))
    state = "struct<phi:array<double>,out:array<double>>"

    def step(s: Column, rk: Column) -> Column:
        n = F.size(s["phi"])
        r = F.slice(F.col("r"), 1, n)
        num = rk - F.aggregate(F.zip_with(s["phi"], F.reverse(r), lambda p, q: p * q), F.lit(0.0), lambda t, x: t + x)
        den = 1 - F.aggregate(F.zip_with(s["phi"], r, lambda p, q: p * q), F.lit(0.0), lambda t, x: t + x)
        new = num / F.nullif(den, F.lit(0.0))
        phi = F.concat(F.zip_with(s["phi"], F.reverse(s["phi"]), lambda p, q: p - new * q), F.array(new))
        return F.struct(phi.alias("phi"), F.concat(s["out"], F.array(new)).alias("out")).cast(state)

    start = F.struct(F.array().cast("array<double>").alias("phi"), F.array().cast("array<double>").alias("out")).cast(state)
    folded = lists.select(*keys, F.aggregate("r", start, step)["out"].alias("o"))
    return folded.select(*keys, F.posexplode("o").alias("i", "pacf")).select(*keys, (F.col("i") + 1).cast("long").alias("lag"), "pacf")


def over_windows(per_window: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """keys, lag and the mean of value over windows, NULL ones left out."""
    keys = keys or ["track"]
    return per_window.groupBy(*keys, "lag").agg(F.avg(value).alias(value), F.count(value).alias("windows"))


def rounded_log_lags(lo: float, hi: float, n: int, rate: float) -> list[int]:
    """About n lags in frames, even in the logarithm of time; equal ones once."""
    return sorted({round(lo * (hi / lo) ** (i / (n - 1)) * rate) for i in range(n)})
