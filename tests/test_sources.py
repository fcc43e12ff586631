"""Configuration, stored observations and streams."""

import datetime as dt

from pyspark.sql import functions as F

from kinetrace.sources import store
from kinetrace.streaming import tracks as streams

CONFIG = """
systemSettings: {hdf5Path: x}
videos:
- videoSettings: {videoFile: a.avi, storeFile: s.parquet, frameRate: 11.5, pixelSize: 0.05, threshold: 0.9, numberOfPosturePoints: 30}
  regions:
  - cropRegion: !!python/tuple [1, 2, 30, 40]
    foodCircle: !!python/tuple [5.0, 6.0, 7.5]
    strainName: N2
    wormName: '1'
  - {cropRegion: null, foodCircle: null, strainName: !!python/unicode 'N2', wormName: '2'}
"""
GROUP = """
name: g
ensembles:
- {name: a, color: k, trajectories: [{storeFile: $STORE_FOLDER/s, strain: N2, wormID: '10'}, {storeFile: t, strain: N2, wormID: '9'}]}
- {name: b, trajectories: [{storeFile: t, strain: X, wormID: 3}]}
"""


def test_config(spark):
    videos, regions = store.read_video_config(spark, CONFIG)
    assert videos.first().frame_rate == 11.5 and videos.first().posture_points == 30
    got = regions.orderBy("animal").collect()
    assert got[0].crop.w == 30 and got[0].food.r == 7.5 and got[1].crop is None and got[1].strain == "N2"


def test_members_round_trip(spark, monkeypatch):
    monkeypatch.setenv("STORE_FOLDER", "/data")
    members = store.read_members(spark, GROUP)
    assert members.count() == 3 and members.where("store = '/data/s'").count() == 1
    again = store.read_members(spark, store.members_as_yaml(members))
    assert again.exceptAll(members).isEmpty()


def test_observations_round_trip(spark, tmp_path):
    rows = [("v", "N2", "1", i, i / 11.5, float("nan") if i == 2 else 1.0 * i, 0.5, None, None, 0.0 if i == 3 else 9.0, 1.0, 0.1, None, [(0.0, 0.0)] if i == 4 else [(1.0, 2.0)], [0.1], False, False) for i in range(6)]
    path = str(tmp_path / "obs")
    store.write_observations(spark.createDataFrame(rows, store.OBSERVATION), path)
    got = store.read_observations(spark, path)
    by = {r.frame: r for r in got.collect()}
    assert by[2].x is None and by[3].length is None and by[4].skeleton is None and by[1].x == 1.0
    assert store.tracks(got).count() == 1
    videos, _ = store.read_video_config(spark, CONFIG.replace("a.avi", "v"))
    assert store.in_micrometres(got, videos).where("frame = 1").first().x == 20.0
    plan = got.where("strain = 'N2'").select("x")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(strain" in plan


def run(spark, stream, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    values = [0, 1, 2, 50, 51, 52, 0, 1]
    rows = [(1, t0 + dt.timedelta(minutes=i), float(v), 1.0) for i, v in enumerate(values)] + [(2, t0 + dt.timedelta(hours=5), 1.0, 1.0)]
    path = str(tmp_path / "events")
    spark.createDataFrame(rows, "track long, ts timestamp, x double, y double").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("track long, ts timestamp, x double, y double").parquet(path)
    found = run(spark, streams.running_segments(stream, 20.0), "append", "segs").where("track = 1").orderBy("segment").collect()
    assert [(r.segment, r.n) for r in found][:2] == [(0, 3), (1, 3)]
    windows = run(spark, streams.windowed_activity(stream), "append", "acts")
    assert windows.where("track = 1").agg(F.sum("n")).first()[0] == 2 * len(values)
    assert run(spark, streams.visits(stream), "append", "visits").where("track = 1").first().n == len(values)


def test_video_config_round_trip(spark):
    videos, regions = store.read_video_config(spark, CONFIG)
    again = store.read_video_config(spark, store.video_config_as_yaml(videos, regions))
    assert again[0].collect() == videos.collect() and sorted(map(repr, again[1].collect())) == sorted(map(repr, regions.collect()))


def test_sinks(spark, tmp_path):
    videos, regions = store.read_video_config(spark, CONFIG)
    store.write_setup(videos, regions, f"{tmp_path}/setup")
    read = store.read_setup(spark, f"{tmp_path}/setup")
    assert read[0].collect() == videos.collect() and read[1].count() == 2
    fits = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, None, 2.0)], "track long, a double, b double")
    store.write_parameters(fits, f"{tmp_path}/fits")
    assert {r.track for r in spark.read.parquet(f"{tmp_path}/fits").collect()} == {1, 3}
    curves = spark.createDataFrame([(1, "msd", 0, 0.0, 0.0, 3), (1, "vacf", 1, 0.1, None, 0)], "track long, metric string, lag long, tau double, value double, windows long")
    store.write_curves(curves, f"{tmp_path}/curves")
    assert spark.read.parquet(f"{tmp_path}/curves").where("metric = 'vacf'").first().value is None
    frames = spark.createDataFrame([("v", "N2", "1", 0, 1.5, None)], "video string, strain string, animal string, frame long, x double, y double")
    segments = spark.createDataFrame([("v", "N2", "1", 0, 9, 1, True)], store.SEGMENT)
    store.write_derived(frames, segments, f"{tmp_path}/derived")
    got = store.read_derived(spark, f"{tmp_path}/derived")
    assert (got[0].first().x, got[0].first().y, got[0].first().posture) == (1.5, None, None) and got[1].first().flip
    store.write_simulation(spark.range(130).withColumnRenamed("id", "replicate"), f"{tmp_path}/runs")
    assert spark.read.parquet(f"{tmp_path}/runs").where("part = 1").count() == 3
