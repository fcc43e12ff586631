"""Observation stores in Parquet, and their configuration in YAML."""

from __future__ import annotations

import os
import tempfile
import uuid

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrace.sources.tables import missing

OBSERVATION = """video string, strain string, animal string, frame long, time double, x double, y double, mid_x double, mid_y double, length double, width double,
    body_angle double, box struct<x:int,y:int,w:int,h:int>, skeleton array<struct<r:double,c:double>>, posture array<double>, bad_skeleton boolean, crossed boolean"""
REGION = "video string, strain string, animal string, crop struct<x:int,y:int,w:int,h:int>, food struct<x:double,y:double,r:double>"
VIDEO = "video string, file string, store string, frame_rate double, pixels_per_micron double, threshold double, expected_length double, expected_width double, posture_points int"
MEMBER = "grp string, ensemble string, place int, store string, strain string, animal string"
KEYS = ("video", "strain", "animal")
# The keys of the configuration files' format.
VIDEO_KEYS = ("videoFile", "storeFile", "frameRate", "pixelSize", "threshold", "expectedWormLength", "expectedWormWidth", "numberOfPosturePoints")
REGION_KEYS = ("strainName", "wormName", "cropRegion", "foodCircle")
TRACK_KEYS = ("storeFile", "strain", "wormID")


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not folder and app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-")
    return (folder or _own[app]).rstrip("/")


def dealt(rows: DataFrame) -> DataFrame:
    """rows whose next join deals out both sides. Small files of narrow rows would be broadcast, in each round of a loop anew, and all that is broadcast passes the driver."""
    return rows.hint("merge")


def kept(rows: DataFrame, name: str) -> DataFrame:
    """rows written to the shared folder and read back: their lineage ends there. Joins deal them out; a small table that meets them is broadcast where that is asked for."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return dealt(rows.sparkSession.read.schema(rows.schema).parquet(path))


def write_observations(observations: DataFrame, path: str) -> None:
    """Store by recording and strain, so that a read of one of them opens only its files."""
    observations.write.partitionBy("video", "strain").mode("overwrite").parquet(path)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Stored observations, with every stand-in for a missing value as NULL."""
    rows = spark.read.schema(OBSERVATION).parquet(path)
    clean = {c: missing(F.col(c)) for c in ("x", "y", "mid_x", "mid_y", "body_angle")}
    clean |= {c: missing(F.col(c), 0.0) for c in ("length", "width")}
    clean["skeleton"] = F.when(F.exists("skeleton", lambda p: (p["r"] > 0) | (p["c"] > 0)), F.col("skeleton"))
    return rows.withColumns(clean)


def tracks(observations: DataFrame) -> DataFrame:
    """The keys of all tracks."""
    return observations.select(*KEYS).distinct()


def in_micrometres(observations: DataFrame, videos: DataFrame) -> DataFrame:
    """x and y divided by the pixels per micrometre of their video."""
    scale = videos.select("video", "pixels_per_micron")
    rows = observations.join(scale, "video")
    return rows.withColumns({c: F.col(c) / F.col("pixels_per_micron") for c in ("x", "y")}).drop("pixels_per_micron")


class _Loader(yaml.SafeLoader):
    """Safe YAML that reads Python's tuple and text tags as lists and strings."""


_Loader.add_constructor("tag:yaml.org,2002:python/tuple", lambda loader, node: loader.construct_sequence(node))
_Loader.add_constructor("tag:yaml.org,2002:python/unicode", lambda loader, node: loader.construct_scalar(node))


def load_yaml(text: str) -> dict:
    return yaml.load(text, _Loader)  # noqa: S506  a safe loader with two more tags


def read_video_config(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(videos, regions) of a recording configuration."""
    config = load_yaml(text)
    videos, regions = [], []
    for v in config.get("videos", []):
        settings = [v.get("videoSettings", {}).get(k) for k in VIDEO_KEYS]
        name = settings[0] or ""
        videos.append((name, name, *settings[1:]))
        for r in v.get("regions", []):
            strain, animal, crop, food = (r.get(k) for k in REGION_KEYS)
            regions.append((name, strain, animal, tuple(map(int, crop)) if crop else None, tuple(map(float, food)) if food else None))
    double = {3, 4, 5, 6, 7}
    videos = [tuple(float(x) if i in double and x is not None else x for i, x in enumerate(row)) for row in videos]
    return spark.createDataFrame(videos, VIDEO), spark.createDataFrame(regions, REGION)


def read_members(spark: SparkSession, text: str) -> DataFrame:
    """One row per track of each ensemble of a group, an ensemble, or a single track; environment variables in paths are filled in."""
    config = load_yaml(text)
    ensembles = config.get("ensembles") or [config if "trajectories" in config else {"trajectories": [config]}]
    rows = [
        (config.get("name"), e.get("name"), i, *(os.path.expandvars(str(t[k])) for k in TRACK_KEYS))
        for e in ensembles
        for i, t in enumerate(e["trajectories"])
    ]
    return spark.createDataFrame(rows, MEMBER)


def members_as_yaml(members: DataFrame) -> str:
    """The inverse of read_members for a group; members is a small table of names."""
    rows = members.orderBy("ensemble", "place").collect()
    ensembles: dict[str, list[dict]] = {}
    for r in rows:
        ensembles.setdefault(r.ensemble, []).append(dict(zip(TRACK_KEYS, (r.store, r.strain, r.animal), strict=True)))
    return yaml.safe_dump({"name": rows[0].grp if rows else None, "ensembles": [{"name": k, "trajectories": v} for k, v in ensembles.items()]}, sort_keys=False)


def members_of(observations: DataFrame, members: DataFrame) -> DataFrame:
    """Observations of the member tracks, once for each ensemble that has them."""
    return observations.join(members, ["strain", "animal"])


DERIVED = """video string, strain string, animal string, frame long, t double, x double, y double, vx double, vy double, s double, phi double, psi double, dpsi double, head_x double, head_y double,
    tail_x double, tail_y double, bad boolean, oriented boolean, posture array<double>"""
SEGMENT = "video string, strain string, animal string, begin long, end long, method int, flip boolean"


def conformed(rows: DataFrame, schema: str) -> DataFrame:
    """rows with the columns of a schema, in its order and types; those that rows lack are NULL."""
    kinds = T.StructType.fromDDL(schema)
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])


def write_derived(frames: DataFrame, segments: DataFrame, path: str) -> None:
    """Store what post-processing gives: one row per frame, one per segment; masked values stay NULL."""
    conformed(frames, DERIVED).write.partitionBy("video", "strain").mode("overwrite").parquet(f"{path}/frames")
    conformed(segments, SEGMENT).write.partitionBy("video", "strain").mode("overwrite").parquet(f"{path}/segments")


def read_derived(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(DERIVED).parquet(f"{path}/frames"), spark.read.schema(SEGMENT).parquet(f"{path}/segments")


def write_setup(videos: DataFrame, regions: DataFrame, path: str) -> None:
    """Store the two small tables of a recording's configuration."""
    conformed(videos, VIDEO).coalesce(1).write.mode("overwrite").parquet(f"{path}/videos")
    conformed(regions, REGION).coalesce(1).write.mode("overwrite").parquet(f"{path}/regions")


def read_setup(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(VIDEO).parquet(f"{path}/videos"), spark.read.schema(REGION).parquet(f"{path}/regions")


def video_config_as_yaml(videos: DataFrame, regions: DataFrame) -> str:
    """The inverse of read_video_config; a configuration is a small table of names and numbers."""
    held: dict[str, list[dict]] = {}
    for r in regions.orderBy("video", "strain", "animal").collect():
        values = (r.strain, r.animal, list(r.crop) if r.crop else None, list(r.food) if r.food else None)
        held.setdefault(r.video, []).append({k: v for k, v in zip(REGION_KEYS, values, strict=True) if v is not None})
    listed = []
    for v in videos.orderBy("video").collect():
        settings = {k: x for k, x in zip(VIDEO_KEYS, v[1:], strict=True) if x is not None}
        listed.append({"regions": held.get(v.video, []), "videoSettings": settings})
    return yaml.safe_dump({"videos": listed}, sort_keys=False)


def write_curves(curves: DataFrame, path: str) -> None:
    """Store curves as one long table: a row per track, metric and lag; a folder for each metric."""
    curves.select("track", "metric", "lag", "tau", "value", "windows").write.partitionBy("metric").mode("overwrite").parquet(path)


def write_parameters(parameters: DataFrame, path: str) -> None:
    """Store fitted parameters; tracks of which nothing could be fitted are left out."""
    names = [c for c in parameters.columns if c != "track"]
    parameters.where(F.coalesce(*[F.col(c).cast("double") for c in names]).isNotNull()).write.mode("overwrite").parquet(path)


def write_simulation(replicates: DataFrame, path: str) -> None:
    """Store simulated rows, a folder for each replicate's number modulo 64."""
    replicates.withColumn("part", (F.col("replicate") % 64).cast("int")).write.partitionBy("part").mode("overwrite").parquet(path)
