"""Pinned cases of single operators."""

import math

import pytest
from pyspark.sql import functions as F

from trackloom.functions import geo
from trackloom.operators import scoring, tracks
from trackloom.sources.tracks import read_tracks
from trackloom.streaming.sessions import session_segments


def test_window_scaling(spark):
    got = {r["dt_h"]: tuple(r)[1:] for r in tracks.window_scaling(spark.createDataFrame([(1.0,), (0.25,), (24.0,)], "dt_h double")).collect()}
    assert got[1.0] == (24, 12, 3.0) and got[0.25] == (96, 48, 4.0) and got[24.0] == (2, 1, 3.0)


def test_utm_and_bits(spark):
    x = spark.createDataFrame([(-96.0, 40.0), (-96.0, -33.0), (12.0, 41.0)], "lon double, lat double")
    assert [r[0] for r in x.select(geo.utm_epsg(F.col("lon"), F.col("lat"))).collect()] == [32615, 32715, 32633]
    with pytest.raises(ValueError):
        geo.bits(F.lit(1), 3, 2)


def test_season_edges(spark):
    days = ["2025-04-01", "2025-06-30", "2025-07-01", "2025-12-01", "2025-03-15", "2025-03-16", "2025-11-30"]
    x = spark.createDataFrame([(d,) for d in days], "d string").select(geo.season(F.to_date("d")))
    assert [r[0] for r in x.collect()] == ["spring", "spring", "summer_autumn", "winter", "winter", "summer_autumn", "summer_autumn"]


def test_segments_with_one_gap(spark):
    rows = [(k, "s", "a", 3600 * k if k < 26 else 3600 * (k + 13), 40.0, -97.0) for k in range(40)]
    x = spark.createDataFrame(rows, "event_id long, study_id string, individual_id string, t long, lat double, lon double").withColumn("timestamp", F.timestamp_seconds("t"))
    got = tracks.segments(x, 3 * 3600).groupBy("seg").count().collect()
    assert sorted(r["count"] for r in got) == [14, 26]


def test_spatial_median_of_symmetric_points(spark):
    x = spark.sql("SELECT array(named_struct('x', 1d, 'y', 0d), named_struct('x', -1d, 'y', 0d), named_struct('x', 0d, 'y', 1d), named_struct('x', 0d, 'y', -1d)) AS p")
    r = x.select(scoring.spatial_median("p").alias("z"), scoring.energy_score("p", "0d", "0d").alias("es")).first()
    assert abs(r["z"]["x"]) < 1e-9 and abs(r["z"]["y"]) < 1e-9 and math.isfinite(r["es"])


def test_read_tracks(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("time,animal_id,study,latitude,longitude\n2025-01-01 00:00:00,x,s,40.5,-97\n2025-01-01 01:00:00,x,s,bad,-97\n")
    got = read_tracks(spark, str(p)).collect()
    assert len(got) == 1 and got[0]["lat"] == 40.5 and got[0]["species"] == ""
    p.write_text("time,latitude\n1,2\n")
    with pytest.raises(ValueError, match="individual_id"):
        read_tracks(spark, str(p))


def test_streaming_sessions(spark, tmp_path):
    rows = [("s", "a", h, 40.0, -97.0) for h in (0, 1, 2, 30, 31, 200)]
    spark.createDataFrame(rows, "study_id string, individual_id string, h long, lat double, lon double").withColumn("timestamp", F.timestamp_seconds(F.col("h") * 3600)).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    q = session_segments(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "5 hours", "1 hour").writeStream.format("memory").queryName("sess").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n_fixes"] for r in spark.table("sess").collect()) == [2, 3]
