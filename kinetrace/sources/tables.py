"""Track tables, from stored observations and from the sample tables.

A track table has a key column `track`, an integer `frame` that counts from 0
within it, positions `x`, `y` and validity flags. Missing values are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FRAME_RATE = 11.5


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of a task, where tracks are dealt out by their number.
TASK_ROWS = 100_000


def in_even_tasks(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by key to so many tasks that each gets about TASK_ROWS, however few bytes they are before windows and lags widen them; left to Spark where its cores are as many."""
    tasks = -(-rows.count() // TASK_ROWS)
    return rows if tasks <= rows.sparkSession.sparkContext.defaultParallelism else rows.repartition(tasks, key)


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, strain, frame, x and y (whole numbers: hundredths of value, k of props), kind, bad, oriented, excluded; one track per user of events."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return in_even_tasks(read(spark, sf_dir, "events"), "user_id").select(
        F.col("user_id").alias("track"),
        (F.col("user_id") % 4).cast("int").alias("strain"),
        (F.row_number().over(order) - 1).cast("long").alias("frame"),
        F.round(F.col("value") * 100).cast("long").alias("x"),
        F.get_json_object("props", "$.k").cast("long").alias("y"),
        F.col("event_type").alias("kind"),
        (F.col("event_type") == "error").alias("bad"),
        (F.col("event_type") != "signup").alias("oriented"),
        (F.col("event_type") == "purchase").alias("excluded"),
    )


def irregular_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As track, with t, the whole microseconds of ts."""
    return track_rows(read(spark, sf_dir, "events"))


def track_rows(events: DataFrame) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("track"),
        (F.row_number().over(order) - 1).cast("long").alias("frame"),
        F.unix_micros(F.to_timestamp("ts")).alias("t"),
        F.round(F.col("value") * 100).cast("long").alias("x"),
        F.col("event_type").alias("kind"),
    )


def posture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, strain and posture (angles as doubles) of embeddings."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").alias("strain"), F.col("embedding").cast("array<double>").alias("posture"))


def size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, frame, length and width of lineitem, one track per supplier."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("track"), F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("part"), F.col("l_extendedprice").alias("length"), F.col("l_quantity").alias("width"))


def arena(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per strain: the food circle and the crop box, from the nations' keys."""
    n = F.col("n_nationkey").cast("long")
    return read(spark, sf_dir, "nation").where("n_nationkey < 4").select(
        F.col("n_nationkey").cast("int").alias("strain"), (n * 1000 + 5000).alias("food_x"), (n * 5 + 40).alias("food_y"), (n * 500 + 3000).alias("food_r"),
        (n * 100).alias("box_x"), n.alias("box_y"), F.lit(20000).cast("long").alias("box_w"), F.lit(90).cast("long").alias("box_h"),
    )


def missing(value: Column, *also: float) -> Column:
    """NULL for NaN and for the given stand-ins of a missing value (0 or -1 in stored recordings)."""
    out = F.when(~F.isnan(value.cast("double")), value)
    for x in also:
        out = F.when(out != x, out)
    return out
