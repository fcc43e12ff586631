"""Near-duplicate vectors by collision-counting projections.

Two vectors link if their cosine is at least COSINE. Each of many tables sorts
the vectors on a one-dimensional random projection; a vector's window there is
centred on its own value, so a pair that links falls in one window unless its
difference is beyond WIDTH standard deviations. As a window on one line holds a
fixed share of all vectors, each table is cut into cells by the signs of further
projections, their number growing with the logarithm of the table. For a pair at exactly COSINE the chance p to
collide in a table is known in closed form (signs agree with 1 - angle / pi, the
difference of projections is normal) whatever the data. There are MEAN / p tables,
and a pair is verified if it collides in at least as many of them as leaves RECALL of such
pairs; closer pairs pass more surely. Nothing caps cells, windows or partners.

1. Equal vectors are one class: a grouped count by two hashes.
2. Balls. Where a cell of one of the first tables holds more than CROWD classes, the vectors
   linked with one of them give a mean, the hub. Vectors within half the linking angle of one hub are all
   linked with each other, by the triangle inequality: they form a ball, and need no
   comparison. A vector takes the hub with most followers. A large group of near copies thus is a few balls.
3. Collisions are counted per pair of balls (mostly single vectors): in a cell,
   members of a ball within an eighth of a window are one row, which is widened by that much.
4. Pairs of single vectors are verified by a join; pairs with a larger ball in
   blocks of about BLOCK vectors on either side, one product of matrices for each two
   blocks, which yields counts and at most one edge for two balls. No pairs are written there.
5. Components of the edges by smallest labels and pointer jumping.

Edge cases: vectors that are null or zero, or hold null or non-finite numbers, link
with nothing, nor do vectors of different lengths with each other. A null vec_id
is its component's id only if no member has one. Rows that repeat an id count as
vectors of their own. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, comb, erf, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinetrace.llm.jaccard import components
from kinetrace.llm.store import bounded_batches, fields, hot_keys, saved, spread_join
from kinetrace.llm.words import mix

COSINE, RECALL, SEED = 0.95, 0.999, 11
#: Half a window in standard deviations of a linked pair's difference; tables times p; classes of a cell of unrelated vectors.
WIDTH, MEAN, CELL = 2.5, 12.0, 2
#: Classes of a cell that makes a hub, tables looked at for such cells, and vectors on either side of a block.
CROWD, CROWD_TABLES, BLOCK = 64, 4, 256
#: Projections are whole numbers of so many parts of 1.
UNIT = 1 << 20
_U = np.uint64


def usable(vector: Column) -> Column:
    """Whether the vector has a direction."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


class Projections:
    """Tables of bits signs and one sorted projection, for a number of classes."""

    def __init__(self, classes: int, cosine: float, seed: int = SEED):
        self.seed, self.bits = seed, max(1, ceil(log2(max(classes, 1) / CELL)) if classes > CELL else 1)
        distance = sqrt(2 - 2 * cosine)
        self.half = ceil(WIDTH * distance * UNIT)
        self.chance = (1 - acos(cosine) / pi) ** self.bits * erf(WIDTH / sqrt(2))
        self.tables = ceil(MEAN / self.chance)
        self.least = max(c for c in range(1, self.tables + 1) if self.recall(c) >= RECALL)

    def recall(self, least: int) -> float:
        """Chance of a pair at exactly the threshold to collide in at least so many tables."""
        p = self.chance
        return 1 - sum(comb(self.tables, i) * p**i * (1 - p) ** (self.tables - i) for i in range(least))

    def lines(self, length: int) -> np.ndarray:
        return _lines(self.seed, length, self.tables, self.bits)

    def keys(self, units: np.ndarray, tables: int) -> tuple[np.ndarray, np.ndarray]:
        """Cell and projection of each vector in each of the first tables."""
        lines = self.lines(units.shape[1])[:, :tables]
        out = (units @ lines.reshape(len(lines), -1)).reshape(len(units), tables, -1)
        signs = (out[:, :, 1:] > 0).astype(_U) @ (_U(1) << np.arange(self.bits, dtype=_U))
        cells = mix(mix(np.arange(tables, dtype=_U) + _U(units.shape[1] << 20))[None] ^ signs)
        return cells.view(np.int64), np.floor(out[:, :, 0] * UNIT).astype(np.int64)


@lru_cache(4)
def _lines(seed: int, length: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([seed, length]).standard_normal((length, tables, bits + 1))


def _by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length."""
    offsets = column.offsets.to_numpy()
    values, size = column.values.to_numpy(), np.diff(offsets)
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        yield rows, values[offsets[rows][:, None] + np.arange(length)]


def _directed(rows: DataFrame, vector: str, name: str) -> DataFrame:
    """rows with their usable vectors replaced by name: doubles, divided by the length."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(vector))
            offsets = column.offsets.to_numpy()
            flat = column.values.to_numpy().astype(float)
            for rows, values in _by_length(pa.ListArray.from_arrays(column.offsets, pa.array(flat))):
                units = values / np.abs(values).max(axis=1, keepdims=True)
                units /= np.sqrt((units * units).sum(axis=1, keepdims=True))
                flat[offsets[rows][:, None] + np.arange(values.shape[1])] = units
            units = pa.ListArray.from_arrays(column.offsets, pa.array(flat))
            kept = [c for c in batch.schema.names if c != vector]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), units], names=[*kept, name])

    return bounded_batches(rows).mapInArrow(read, fields(rows.drop(vector), f"{name} array<double>"))


def _located(vectors: DataFrame, lines: Projections, tables: int) -> DataFrame:
    """cls, ball, t, cell and p of each vector in each of the first tables."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, ball = (batch.column(c).to_numpy() for c in ("cls", "ball"))
            for rows, units in _by_length(batch.column("u")):
                for lo in range(0, len(rows), 4096):
                    some = rows[lo : lo + 4096]
                    cells, p = lines.keys(units[lo : lo + 4096], tables)
                    columns = [np.repeat(cls[some], tables), np.repeat(ball[some], tables), np.tile(np.arange(tables, dtype=np.int32), len(some)), cells.ravel(), p.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["cls", "ball", "t", "cell", "p"])

    return bounded_batches(vectors.select("cls", "ball", "u")).mapInArrow(read, "cls long, ball long, t int, cell long, p long")


def _with_balls(vectors: DataFrame, lines: Projections, cosine: float) -> DataFrame:
    """vectors (cls, n, u) with ball: the least class of those that follow one hub, or the own class."""
    alone = vectors.withColumn("ball", F.col("cls"))
    keys = _located(alone, lines, min(CROWD_TABLES, lines.tables)).select("cls", "cell")
    keys = saved(keys, "keys")
    crowds = saved(keys.groupBy("cell").agg(F.count("*").alias("size"), F.min_by("cls", F.xxhash64("cls")).alias("cls")).where(F.col("size") > CROWD), "crowds")
    if not crowds.limit(1).count():
        return alone
    large = hot_keys(crowds, "cell", "size")
    leaders = crowds.join(vectors.select("cls", "u"), "cls").select("cell", F.col("u").alias("leader"))
    inside = saved(spread_join(keys, crowds.select("cell"), "cell", large).join(vectors.select("cls", "u"), "cls"), "inside")
    followers = spread_join(inside, leaders, "cell", large).where((F.size("u") == F.size("leader")) & (dot("u", "leader") >= cosine))
    sums = followers.select("cell", F.posexplode("u").alias("i", "x")).groupBy("cell", "i").agg(F.sum("x").alias("x"))
    hubs = sums.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("hub"))
    hubs = saved(_directed(hubs.where(usable(F.col("hub"))), "hub", "hub"), "hubs")
    # a little inside the half angle, so that rounding makes no link
    half = sqrt((1 + cosine) / 2) + 1e-9
    near = saved(spread_join(inside, hubs, "cell", large).where((F.size("u") == F.size("hub")) & (dot("u", "hub") >= half)).select("cls", "cell"), "near")
    weight = near.groupBy("cell").agg(F.count("*").alias("followers"))
    chosen = saved(spread_join(near, weight, "cell", large).groupBy("cls").agg(F.max(F.struct("followers", "cell"))["cell"].alias("cell")), "chosen")
    named = chosen.groupBy("cell").agg(F.min("cls").alias("ball"))
    balls = spread_join(chosen, named, "cell", hot_keys(chosen, "cell")).select("cls", "ball")
    return vectors.join(balls, "cls", "left").withColumn("ball", F.coalesce("ball", "cls"))


def _candidates(members: DataFrame, lines: Projections) -> DataFrame:
    """Pairs of balls (a, b), a < b, that collide in enough tables."""
    step = lines.half // 8
    rows = _located(members, lines, lines.tables).groupBy("t", "cell", "ball", F.floor(F.col("p") / step).alias("__step")).agg(F.min("p").alias("p"))
    window = Window.partitionBy("t", "cell").orderBy("p").rangeBetween(-(lines.half + step + 1), Window.currentRow)
    met = rows.select("t", "ball", F.array_distinct(F.collect_list("ball").over(window)).alias("others")).select("t", "ball", F.explode("others").alias("other")).where("other != ball")
    pairs = met.select(F.least("ball", "other").alias("a"), F.greatest("ball", "other").alias("b"), "t")
    return pairs.groupBy("a", "b").agg(F.size(F.collect_set("t")).alias("collisions")).where(F.col("collisions") >= lines.least).select("a", "b")


def _of_singles(pairs: DataFrame, members: DataFrame, cosine: float) -> DataFrame:
    """cls, other and n (of the other) of the links among pairs of single vectors; each pair once."""
    side = lambda x: members.select(F.col("ball").alias(x), F.col("u").alias(f"u{x}"), F.col("n").alias(f"n{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return met.where((F.size("ua") == F.size("ub")) & (dot("ua", "ub") >= cosine)).select("a", "b", "na", "nb")


def _of_blocks(pairs: DataFrame, members: DataFrame, cosine: float) -> DataFrame:
    """From pairs of host and guest balls: (a, b, null) for two that link, and (cls, null, count) for what a class gains.

    members: cls, ball, n, u and size of the ball. Hosts and their guests' members meet in blocks.
    """
    all_guests = pairs.join(members.select(F.col("ball").alias("guest"), "cls", "n", "u"), "guest")
    counted = saved(pairs.groupBy("host", "host_size").agg(F.ceil(F.sum("guest_size") / BLOCK).alias("ng")).withColumn("nh", F.ceil(F.col("host_size") / BLOCK)).drop("host_size"), "counted")
    place = lambda n: F.pmod(F.xxhash64(F.lit(5), "cls"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = [F.col(c).alias(c) for c in ("host", "ball", "cls", "n", "u")]  # own columns for either side
    own = members.withColumn("host", F.col("ball")).join(counted, "host")
    hosts = own.select(*columns, place("nh").alias("x"), each("ng").alias("y"))
    guests = all_guests.withColumnRenamed("guest", "ball").join(counted, "host").select(*columns, place("ng").alias("y"), each("nh").alias("x"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, add = [], [], []
        if left.num_rows and right.num_rows:
            own, other = left["u"].combine_chunks(), right["u"].combine_chunks()
            (cls, n, host), (gcls, gn, guest) = ([t[c].to_numpy() for c in ("cls", "n", "ball")] for t in (left, right))
            for rows, units in _by_length(own):
                for grows, gunits in _by_length(other):
                    if units.shape[1] != gunits.shape[1]:
                        continue
                    linked = units @ gunits.T >= cosine
                    for ids, gains in ((cls[rows], linked @ gn[grows]), (gcls[grows], n[rows] @ linked)):
                        some = gains > 0
                        a.append(ids[some])
                        b.append(np.full(some.sum(), -1))
                        add.append(gains[some])
                    met = np.unique(guest[grows][linked.any(axis=0)])
                    a.append(np.full(len(met), host[0]))
                    b.append(met)
                    add.append(np.full(len(met), 0))
        columns = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (a, b, add)]
        return pa.Table.from_arrays(columns, names=["a", "b", "n"])

    return hosts.groupBy("host", "x", "y").cogroup(guests.groupBy("host", "x", "y")).applyInArrow(compare, "a long, b long, n long")


def near_duplicates(rows: DataFrame, cosine: float = COSINE, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of (vec_id, embedding)."""
    vector = F.col("embedding")
    hashed = rows.select("vec_id", F.when(usable(vector), F.struct(F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))).alias("h"), "embedding")
    keyed = saved(hashed.drop("embedding"), "keyed")
    equal = hashed.where("h IS NOT NULL").groupBy("h").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.any_value("embedding").alias("embedding"))
    classes = saved(_directed(equal.withColumn("cls", F.monotonically_increasing_id()), "embedding", "u"), "classes")
    lines = Projections(classes.count(), cosine, seed)

    with_balls = saved(_with_balls(classes.select("cls", "n", "u"), lines, cosine), "balls")
    large = hot_keys(with_balls, "ball")
    balls = saved(with_balls.groupBy("ball").agg(F.count("*").alias("size"), F.sum("n").alias("weight")), "sizes")
    members = saved(spread_join(with_balls, balls, "ball", large), "members")
    pairs = _candidates(members, lines)
    for x in "ab":
        pairs = pairs.join(balls.where("size > 1").select(F.col("ball").alias(x), F.col("size").alias(f"size_{x}")), x, "left").withColumn(f"size_{x}", F.coalesce(f"size_{x}", F.lit(1)))
    pairs = saved(pairs, "pairs")
    singles = saved(_of_singles(pairs.where("size_a = 1 AND size_b = 1").select("a", "b"), members, cosine), "singles")
    first = F.struct("size_a", "a") > F.struct("size_b", "b")
    host, guest = (F.when(first if x == "a" else ~first, F.struct(F.col("a").alias("ball"), F.col("size_a").alias("size"))).otherwise(F.struct(F.col("b").alias("ball"), F.col("size_b").alias("size"))) for x in "ab")
    hosted = pairs.where("size_a > 1 OR size_b > 1").select(host.alias("h"), guest.alias("g")).select(F.col("h.ball").alias("host"), F.col("h.size").alias("host_size"), F.col("g.ball").alias("guest"), F.col("g.size").alias("guest_size"))
    blocks = saved(_of_blocks(hosted, members, cosine), "blocks")

    gained = blocks.where("b = -1").select(F.col("a").alias("cls"), "n").union(singles.select("a", "nb")).union(singles.select("b", "na")).groupBy("cls").agg(F.sum("n").alias("gained"))
    edges = singles.select("a", "b").union(blocks.where("b >= 0").select("a", "b")).distinct()
    groups = components(edges).withColumnRenamed("node", "ball")
    # a ball's members follow it: counts of links by class, ids by ball
    counts = members.select("cls", "ball", "weight").join(gained, "cls", "left").select("cls", "ball", (F.col("weight") - 1 + F.coalesce("gained", F.lit(0))).alias("n_links"))
    of_class = classes.select("h", "id", "cls").join(counts, "cls")
    first_id = saved(of_class.groupBy("ball").agg(F.min("id").alias("id")).join(groups, "ball", "left").withColumn("component", F.coalesce("component", "ball")), "first")
    least = first_id.groupBy("component").agg(F.min("id").alias("component_id"))
    of_ball = spread_join(first_id.select("ball", "component"), least, "component", hot_keys(first_id, "component")).select("ball", "component_id")
    told = spread_join(of_class.select("h", "ball", "n_links"), of_ball, "ball", large).select("h", "n_links", "component_id")
    found = spread_join(keyed.where("h IS NOT NULL"), told, "h", hot_keys(keyed.where("h IS NOT NULL"), "h")).select("vec_id", "n_links", "component_id")
    alone = keyed.where("h IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
