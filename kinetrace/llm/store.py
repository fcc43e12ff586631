"""Tables cut from their lineage, kept where every executor can read them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_own: dict[str, str | None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one for each application where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        app = spark.sparkContext.applicationId
        folder = _own.setdefault(app, None) or tempfile.mkdtemp(prefix="spark-")
        _own[app] = folder
    return folder.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fields(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of df with more columns behind."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches to Python workers held to BATCH_BYTES in its session: by rows alone a batch of long texts has no bound."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([bkmgtp]?)i?b?", conf.get(name).strip().lower()).groups()
    if int(number) << {"k": 10, "m": 20, "g": 30, "t": 40, "p": 50}.get(unit, 0) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


#: A key is hot if it has more rows than this, and than a share of 1 in MOST_HOT of all rows.
HOT_ROWS, MOST_HOT = 500, 5000


def hot_keys(df: DataFrame, key: str, weight: str | None = None) -> DataFrame | None:
    """(key, __parts) of the hot keys of a stored table: MOST_HOT rows at most. None if there are none.

    weight: a column that says for how many rows a row counts.
    """
    n = F.sum(weight) if weight else F.count("*")
    total = df.agg(n).first()[0] or 0
    limit = max(HOT_ROWS, total // MOST_HOT)
    found = df.groupBy(key).agg(n.alias("__n")).where(F.col("__n") > limit).select(key, F.ceil(F.col("__n") / limit).cast("int").alias("__parts")).collect()
    kind = T.StructType([df.schema[key], T.StructField("__parts", T.IntegerType())])
    return df.sparkSession.createDataFrame(found, kind) if found else None


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """left joined to right on key, where right has few rows for each key: a hot key's rows on the left go to several tasks, its rows on the right to each of them."""
    if hot is None:
        return left.join(right, key, how)
    rest = [c for c in left.columns if c != key]
    parts = F.coalesce("__parts", F.lit(1))
    spread = left.join(F.broadcast(hot), key, "left").withColumn("__spread_part", F.pmod(F.xxhash64(*rest), parts).cast("int")).drop("__parts")
    copied = right.join(F.broadcast(hot), key, "left").withColumn("__spread_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return spread.join(copied, [key, "__spread_part"], how).drop("__spread_part")


def maybe_in(rows: DataFrame, found: DataFrame, key: str, bits_each: int = 16, most_bits: int = 1 << 26) -> DataFrame:
    """Those of rows whose key, a 64-bit hash, may be one of the stored table found: a bitmap of most_bits at the most (8 MB), broadcast.

    All rows of found's keys stay, and by chance some others: the more, the fuller the bitmap is.
    """
    bits = 1 << 15
    wanted = bits_each * found.count()
    while bits < min(wanted, most_bits):
        bits *= 2
    slot = F.pmod(F.col(key), F.lit(bits))
    table = found.groupBy(F.bitmap_bucket_number(slot).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("__bits"))
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = rows.withColumn("__bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(table), "__bucket")
    known = F.expr("shiftright(__byte, cast(__place % 8 AS INT)) & 1") == 1
    return joined.withColumns({"__byte": byte, "__place": place}).where(known).drop("__bucket", "__bits", "__byte", "__place")
