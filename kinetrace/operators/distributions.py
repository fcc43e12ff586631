"""Histograms, densities on grids, and divergences between distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A grid of evaluation points is a constant of the plan, up to this many.
MOST_POINTS = 20_000


def histogram(rows: DataFrame, column: str, lo: float, hi: float, bins: int, keys: list[str] | None = None) -> DataFrame:
    """keys, bin, n and density for values in [lo, hi]; the last bin holds its upper edge."""
    keys = keys or []
    width = (hi - lo) / bins
    at = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).cast("long")
    counts = rows.where(F.col(column).between(lo, hi)).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("__total"))
    joined = counts.join(totals, keys) if keys else counts.crossJoin(totals)
    return joined.select(*keys, "bin", "n", (F.col("n") / (F.col("__total") * width)).alias("density"))


def root_histogram(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """keys, bin, n: ceil(sqrt(valid values)) even bins between each group's least and largest value."""
    stats = rows.groupBy(*keys).agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"), F.ceil(F.sqrt(F.count(column))).alias("__bins"))
    joined = rows.where(F.col(column).isNotNull()).join(stats, keys)
    width = (F.col("__hi") - F.col("__lo")) / F.col("__bins")
    at = F.when(F.col("__hi") > F.col("__lo"), F.least(F.floor((F.col(column) - F.col("__lo")) / width), F.col("__bins") - 1)).otherwise(0).cast("long")
    return joined.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))


def medians(rows: DataFrame, keys: list[str], column: str, bins: int = 4096) -> DataFrame:
    """keys, median (exact) and n of large groups, by refinement.

    Counts in even bins show which bins hold the middle ranks; only the values in
    these, each once with its number, are put in order. So no group is held or sorted as a
    whole, as the built-in exact median would.
    """
    valid = rows.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("__x"))
    stats = valid.groupBy(*keys).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), F.count("*").alias("n"))
    at = F.least(F.floor((F.col("__x") - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    binned = valid.join(stats, keys).withColumn("__bin", F.coalesce(at, F.lit(0)).cast("int"))
    counts = binned.groupBy(*keys, "n", "__bin").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0))
    lower, upper = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1  # the middle ranks, from 1
    middle = counts.withColumn("__upto", upto).where((F.col("__upto") >= lower) & (F.col("__upto") - F.col("__c") < upper)).select(*keys, "__bin", (F.col("__upto") - F.col("__c")).alias("__before"))
    values = binned.join(middle, [*keys, "__bin"]).groupBy(*keys, "n", "__bin", "__before", "__x").agg(F.count("*").alias("__c"))
    rank = F.col("__before") + F.sum("__c").over(Window.partitionBy(*keys, "__bin").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = values.withColumn("__rank", rank)
    holds = lambda r: F.min(F.when((F.col("__rank") >= r) & (F.col("__rank") - F.col("__c") < r), F.col("__x")))
    return ranked.groupBy(*keys, "n").agg(((holds(lower) + holds(upper)) / 2).alias("median")).select(*keys, "median", "n")


def grid(lo: float, hi: float, n: int) -> list[float]:
    return [lo + (hi - lo) * i / (n - 1) for i in range(n)]


def kde(rows: DataFrame, column: str, points: list[float], keys: list[str], least: int = 2) -> DataFrame:
    """keys, point and density at each point: Gaussian kernels of width n**(-1/5) times the sample deviation.

    Equal values are counted first, so a value costs one kernel per point however
    often it occurs, and each row of counts meets a stated, small list of points:
    round continuous values to a fraction of the kernel's width first.
    """
    if len(points) > MOST_POINTS:
        raise ValueError("evaluate so many points by parts")
    stats = rows.groupBy(*keys).agg(F.count(column).alias("__n"), F.stddev_samp(column).alias("__sd")).where((F.col("__n") >= least) & (F.col("__sd") > 0))
    counts = rows.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("__c")).join(stats, keys)
    h = F.pow(F.col("__n").cast("double"), F.lit(-0.2)) * F.col("__sd")
    at = counts.withColumn("__h", h).withColumn("point", F.explode(F.lit([float(p) for p in points])))
    u = (F.col("point") - F.col(column)) / F.col("__h")
    kernel = F.exp(-u * u / 2) / (F.col("__h") * math.sqrt(2 * math.pi))
    return at.groupBy(*keys, "point").agg((F.sum(kernel * F.col("__c")) / F.first("__n")).alias("density"))


def kde_2d(rows: DataFrame, x: str, y: str, xs: list[float], ys: list[float], keys: list[str]) -> DataFrame:
    """keys, gx, gy and density on the grid xs by ys, a stated, small one: Gaussian kernels of the sample covariance times n**(-1/3). kde_2d_binned() is for fine grids."""
    if len(xs) * len(ys) > MOST_POINTS:
        raise ValueError("evaluate so many points by parts, or with kde_2d_binned()")
    stats = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.var_samp(x).alias("__xx"), F.var_samp(y).alias("__yy"), F.covar_samp(x, y).alias("__xy"))
    stats = stats.withColumn("__f", F.pow(F.col("__n").cast("double"), F.lit(-1 / 3)))
    stats = stats.withColumns({c: F.col(c) * F.col("__f") for c in ("__xx", "__yy", "__xy")}).withColumn("__det", F.col("__xx") * F.col("__yy") - F.col("__xy") * F.col("__xy")).where("__det > 0")
    counts = rows.groupBy(*keys, x, y).agg(F.count("*").alias("__c")).join(stats, keys)
    grid_of = lambda v: F.explode(F.lit([float(a) for a in v]))
    at = counts.withColumn("gx", grid_of(xs)).withColumn("gy", grid_of(ys))
    dx, dy = F.col("gx") - F.col(x), F.col("gy") - F.col(y)
    q = (F.col("__yy") * dx * dx - 2 * F.col("__xy") * dx * dy + F.col("__xx") * dy * dy) / F.col("__det")
    return at.groupBy(*keys, "gx", "gy").agg((F.sum(F.col("__c") * F.exp(-q / 2) / (2 * math.pi * F.sqrt("__det"))) / F.first("__n")).alias("density"))


#: Bins for each kernel width, how many widths a kernel reaches, and the polynomials (by rising powers of the place between
#: two bins) of the weights that a value gives to the four bins around it: a cubic through the kernel's values there.
PER_WIDTH, REACH = 40, 6.5
CUBIC = ((0.0, -1 / 3, 1 / 2, -1 / 6), (1.0, -1 / 2, -1.0, 1 / 2), (0.0, 1.0, 1 / 2, -1 / 2), (0.0, -1 / 6, 0.0, 1 / 6))


def binned_error(axes: int = 1) -> float:
    """The most by which a binned density differs from the sum of all kernels, as a share of a kernel's height: a cubic's error in each axis, and the kernel's tail."""
    return axes * 3 / 24 * 9 / 16 / PER_WIDTH**4 + math.exp(-(REACH**2) / 2)


def _spread(cells: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """keys, axes (bins) and __c: the four bins around a cell in each axis get their weights from the cell's moments __m (of two axes __m00, __m01, ...)."""
    places = [[i] for i in range(4)] if len(axes) == 1 else [[i, j] for i in range(4) for j in range(4)]

    def weight(at: list[int]) -> Column:
        total = F.lit(0.0)
        for powers in places:
            factor = math.prod(CUBIC[i][p] for i, p in zip(at, powers, strict=True))
            if factor:
                total = total + F.col("__m" + "".join(map(str, powers))) * factor
        return total

    each = [F.struct(*[(F.col(a) + i - 1).alias(a) for a, i in zip(axes, at, strict=True)], weight(at).alias("__c")) for at in places]
    rest = [c for c in cells.columns if c not in axes and not c.startswith("__m") and c not in keys]
    return cells.select(*keys, *rest, F.inline(F.array(*each))).groupBy(*keys, *axes, *rest).agg(F.sum("__c").alias("__c"))


def _near(at: Column, width: Column, first: float, step: float, n: int) -> Column:
    """Indexes of the grid points within a kernel's reach."""
    lo = F.greatest(F.ceil((at - REACH * width - first) / step), F.lit(0))
    hi = F.least(F.floor((at + REACH * width - first) / step), F.lit(n - 1))
    return F.explode(F.when(lo <= hi, F.sequence(lo, hi)))


def kde_binned(rows: DataFrame, column: str, first: float, step: float, n: int, keys: list[str], least: int = 2) -> DataFrame:
    """kde() on an even grid of n points, at a cost that depends on the data's range in kernel widths and not on the rows; exact to binned_error()."""
    stats = rows.groupBy(*keys).agg(F.count(column).alias("__n"), F.stddev_samp(column).alias("__sd")).where((F.col("__n") >= least) & (F.col("__sd") > 0))
    stats = stats.select(*keys, "__n", (F.pow(F.col("__n").cast("double"), F.lit(-0.2)) * F.col("__sd")).alias("__h"))
    at = rows.where(F.col(column).isNotNull()).join(stats, keys).withColumn("__at", F.col(column) / F.col("__h") * PER_WIDTH)
    f = F.col("__at") - F.floor("__at")
    cells = at.withColumns({"__x": F.floor("__at"), "__f": f}).groupBy(*keys, "__x", "__h", "__n").agg(*[F.sum(F.pow("__f", F.lit(p))).alias(f"__m{p}") for p in range(4)])
    bins = _spread(cells, keys, ["__x"]).withColumn("__v", F.col("__x") * F.col("__h") / PER_WIDTH)
    met = bins.select("*", _near(F.col("__v"), F.col("__h"), first, step, n).alias("__i")).withColumn("point", F.col("__i") * step + first)
    u = (F.col("point") - F.col("__v")) / F.col("__h")
    return met.groupBy(*keys, "point").agg((F.sum(F.col("__c") * F.exp(-u * u / 2)) / F.first("__n") / F.first("__h") / math.sqrt(2 * math.pi)).alias("density"))


def kde_2d_binned(rows: DataFrame, x: str, y: str, x_grid: tuple[float, float, int], y_grid: tuple[float, float, int], keys: list[str]) -> DataFrame:
    """kde_2d() on an even grid ((first, step, n) of either axis); exact to binned_error(2).

    In x and t = y - slope * x the kernel has no correlation, so it is taken first along x, for each
    grid column, and then along t. Rows are summed to moments of cells; grid points that no kernel reaches are left out.
    """
    stats = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.var_samp(x).alias("__xx"), F.var_samp(y).alias("__yy"), F.covar_samp(x, y).alias("__xy"))
    narrow = F.pow(F.col("__n").cast("double"), F.lit(-1 / 6))
    rest = F.col("__yy") - F.col("__xy") * F.col("__xy") / F.col("__xx")
    stats = stats.where("__xx > 0").select(*keys, "__n", (F.col("__xy") / F.col("__xx")).alias("__slope"), (F.sqrt("__xx") * narrow).alias("__hx"), (F.sqrt(rest) * narrow).alias("__ht")).where("__ht > 0")
    at = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(stats, keys)
    at = at.withColumns({"__ax": F.col(x) / F.col("__hx") * PER_WIDTH, "__at": (F.col(y) - F.col("__slope") * F.col(x)) / F.col("__ht") * PER_WIDTH})
    at = at.withColumns({"__x": F.floor("__ax"), "__t": F.floor("__at"), "__f": F.col("__ax") - F.floor("__ax"), "__g": F.col("__at") - F.floor("__at")})
    moments = [F.sum(F.pow("__f", F.lit(p)) * F.pow("__g", F.lit(q))).alias(f"__m{p}{q}") for p in range(4) for q in range(4)]
    cells = at.groupBy(*keys, "__x", "__t", "__n", "__slope", "__hx", "__ht").agg(*moments)
    bins = _spread(cells, keys, ["__x", "__t"]).withColumn("__v", F.col("__x") * F.col("__hx") / PER_WIDTH)
    held = [*keys, "__n", "__slope", "__hx", "__ht"]
    met = bins.select("*", _near(F.col("__v"), F.col("__hx"), *x_grid).alias("__i")).withColumn("gx", F.col("__i") * x_grid[1] + x_grid[0])
    u = (F.col("gx") - F.col("__v")) / F.col("__hx")
    columns = met.groupBy(*held, "gx", "__t").agg(F.sum(F.col("__c") * F.exp(-u * u / 2)).alias("__c"))
    back = columns.withColumn("__v", F.col("__t") * F.col("__ht") / PER_WIDTH + F.col("__slope") * F.col("gx"))  # t as a y in this column
    met = back.select("*", _near(F.col("__v"), F.col("__ht"), *y_grid).alias("__j")).withColumn("gy", F.col("__j") * y_grid[1] + y_grid[0])
    w = (F.col("gy") - F.col("__v")) / F.col("__ht")
    height = F.first("__n") * F.first("__hx") * F.first("__ht") * (2 * math.pi)
    return met.groupBy(*keys, "gx", "gy").agg((F.sum(F.col("__c") * F.exp(-w * w / 2)) / height).alias("density"))


def hexbin(rows: DataFrame, x: Column, y: Column, size: float, keys: list[str] | None = None) -> DataFrame:
    """keys, hx, hy, n and log_n of the hexagonal cells: the nearer of two shifted lattices of centres."""
    keys = keys or []
    u, v = x / size, y / (size * math.sqrt(3))
    marked = rows.withColumns({"__u": u, "__v": v})
    a = (F.floor(F.col("__u") + 0.5), F.floor(F.col("__v") + 0.5))
    b = (F.floor("__u") + 0.5, F.floor("__v") + 0.5)
    far = lambda c: (F.col("__u") - c[0]) ** 2 + 3 * (F.col("__v") - c[1]) ** 2
    first = far(a) < far(b)
    cell = [F.when(first, a[i]).otherwise(b[i]).cast("double") for i in (0, 1)]
    return marked.groupBy(*keys, cell[0].alias("hx"), cell[1].alias("hy")).agg(F.count("*").alias("n")).withColumn("log_n", F.log(F.col("n").cast("double")))


def _normalised(counts: DataFrame, keys: list[str], bin_: str, n: str, out: str) -> DataFrame:
    totals = counts.groupBy(*keys).agg(F.sum(n).alias("__t"))
    joined = counts.join(totals, keys) if keys else counts.crossJoin(totals)
    return joined.select(*keys, bin_, (F.col(n) / F.col("__t")).alias(out))


def divergences(p: DataFrame, q: DataFrame, bin_: str = "bin", n: str = "n", keys: list[str] | None = None) -> DataFrame:
    """One row, or one for each of the keys: kl (terms with p = 0 count 0), kl_strict (0 if any p is 0) and js in bits, of two tables of (keys, bin, n) with one row per bin.

    Bins that only one table has count 0 in the other; kl is NULL where q is 0 and p is not.
    """
    keys = keys or []
    a, b = _normalised(p, keys, bin_, n, "p"), _normalised(q, keys, bin_, n, "q")
    both = a.join(b, [*keys, bin_], "full").select(*keys, bin_, F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    term = lambda x, y: F.when(x > 0, x * F.log2(x / F.nullif(y, F.lit(0.0)))).otherwise(0.0)
    m = (F.col("p") + F.col("q")) / 2
    out = both.groupBy(*keys).agg(
        F.sum(term(F.col("p"), F.col("q"))).alias("kl"),
        F.count_if((F.col("p") > 0) & (F.col("q") == 0)).alias("lacking"),
        F.count_if(F.col("p") == 0).alias("zeros"),
        F.sum((term(F.col("p"), m) + term(F.col("q"), m)) / 2).alias("js"),
    )
    kl = F.when(F.col("lacking") == 0, F.col("kl"))
    return out.select(*keys, kl.alias("kl"), F.when(F.col("zeros") > 0, 0.0).otherwise(kl).alias("kl_strict"), "js")
