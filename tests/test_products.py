"""Pinned cases of products, trials, histories and track files."""

import math

import pytest
from pyspark.sql import functions as F

from trackloom.operators import pixels, products, studies, tracks, trials
from trackloom.sources import files, store
from trackloom.sources.tracks import read_dataset


def test_fix_table(spark, tmp_path):
    fixes = spark.createDataFrame([("a", "2025-01-01 00:00:00"), ("b", "2025-01-01 01:00:00"), ("c", "2025-01-01 02:00:00")], "fix_id string, t string").select("fix_id", F.to_timestamp("t").alias("timestamp"))
    fixmap = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "fix_id string, key_index long")
    sampled = spark.createDataFrame([(0, 1.5, 2.5)], "key_index long, value double, value_buf30 double")
    out = products.fix_table(fixes, fixmap, sampled, ["other", "value"], "deer", F.lit(0.0))
    assert out.columns == ["fix_id", "dataset", "timestamp", "value", "value_buf30", "value_missing", "_age_hours"]
    assert {r["fix_id"]: (r["value"], r["value_buf30"], r["value_missing"]) for r in out.collect()} == {"a": (1.5, 2.5, False), "b": (1.5, 2.5, False), "c": (None, None, True)}
    assert products.unmatched(fixmap, sampled).first()[0] == 1
    with pytest.raises(ValueError):
        products.value_columns(["x"], ["y"])
    root = f"file://{tmp_path}"
    products.write_source(out, root, "deer", "ndvi")
    assert {k: v.count() for k, v in products.read_sources(spark, root, "deer").items()} == {"ndvi": 3}


def test_completed_chunks(spark):
    log = spark.createDataFrame([("a", "pending", 0), ("b", "complete", 1), ("a", "complete", 2), ("c", "failed", 3), ("x", "complete", 4)], "chunk_id string, status string, seq long")
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "chunk_id string")
    assert [tuple(r) for r in products.completed(log, expected).orderBy("place").collect()] == [("a", 0), ("b", 1)]
    with pytest.raises(ValueError):
        products.completed(log.where("status = 'failed'"), expected)


def test_reduction_guard(spark):
    x = spark.createDataFrame([(10, 10, 6, 1.0, 0.6)], "fixes long, keys long, pixels long, key_ratio double, pixel_ratio double")
    with pytest.raises(ValueError):
        products.check_reduction(x, 1000.0)
    with pytest.warns(UserWarning):
        products.check_reduction(x, 10.0)


def test_selector():
    known = {"b": 1, "a": 1, "c": 2}
    assert products.select_names(known, "") == ["a", "b", "c"] and products.select_names(known, "c, tier1,c") == ["c", "a", "b"]
    for bad, kind in (("z", KeyError), ("tier9", ValueError)):
        with pytest.raises(kind):
            products.select_names(known, bad)


def test_sampling_with_a_buffer(spark):
    raster = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 1, 3.0), (5, 5, 1, 9.0)], "px_row long, px_col long, t0 long, v double")
    points = spark.createDataFrame([(0, 0, 1), (1, 1, 1), (0, 0, 2)], "px_row long, px_col long, t0 long")
    got = sorted((r["px_row"], r["t0"], r["v"], r["v_buf30"]) for r in products.sample_pixels(points, raster, ["v"], buffer=1).collect() if r["t0"] == 1)
    assert got == [(0, 1, 1.0, 2.0), (1, 1, None, 2.0)]


def test_keys_are_numbered_over_blocks(spark):
    rows = [(r, c, t) for r in (3, 1, 2) for c in (500, 5, 64, 63) for t in (2, 1)]
    keys = spark.createDataFrame(rows, "px_row long, px_col long, t0 long")
    for block in (1, 64, 10_000):
        got = {tuple(r)[:3]: r["key_index"] for r in pixels.number_keys(keys, block).collect()}
        assert got == {k: i for i, k in enumerate(sorted(rows))}


def test_windows_of_any_stride(spark):
    x = spark.createDataFrame([("s", "a", 0, k, float(k), 0.0) for k in range(23)], "study_id string, individual_id string, seg long, k long, lat double, lon double").withColumn("timestamp", F.timestamp_seconds("k"))
    for stride in (1, 2, 3, 5, 7, 9):
        got = {r["start"]: [p["lat"] for p in r["window"]] for r in tracks.sliding_windows(x, 4, 2, stride).collect()}
        assert got == {s: [float(s + i) for i in range(6)] for s in range(0, 18, stride)}


def test_fixes_once_and_histories(spark):
    x = spark.createDataFrame([("s", "a", t, e) for e, t in enumerate([5, 1, 5, 3, 3])], "study_id string, individual_id string, t long, event_id long").withColumn("timestamp", F.timestamp_seconds("t"))
    got = tracks.histories(x).orderBy("k").collect()
    assert [(r["t"], r["event_id"], r["k"]) for r in got] == [(1, 1, 0), (3, 3, 1), (5, 0, 2)]
    assert sorted(r["event_id"] for r in tracks.dedup_fixes(x).collect()) == [0, 1, 3]


def test_rotation_keeps_lengths(spark):
    x = spark.createDataFrame([(w, float(k), 2.0) for w in range(200) for k in range(3)], "w long, dx double, dy double")
    got = tracks.rotated(x, ["w"]).collect()
    assert sorted(round(math.hypot(r["dx"], r["dy"]), 9) for r in got) == sorted(round(math.hypot(k, 2), 9) for k in (0, 1, 2) for _ in range(200))
    turn = {r["w"]: 0.0 for r in got}
    for r in tracks.rotated(x.where("dx = 0"), ["w"], mirror=False).collect():
        turn[r["w"]] = math.atan2(r["dy"], r["dx"])
    assert len({round(v, 6) for v in turn.values()}) == 200  # an angle for each window
    assert sum(math.cos(v) for v in turn.values()) ** 2 + sum(math.sin(v) for v in turn.values()) ** 2 < (4 * math.sqrt(200)) ** 2


def test_overrides_and_costs(spark):
    x = trials.window_overrides(tracks.window_scaling(spark.createDataFrame([(0.05,), (1.0,)], "dt_h double")))
    assert {r["dt_h"]: (r["stride"], r["eval_stride"], r["max_speed_mps"]) for r in x.collect()} == {0.05: (5, 48, 25.0), 1.0: (1, 12, None)}
    t = spark.createDataFrame([("wolf", "tcn", 200, 48), ("wolf", "lstm", None, 48), ("fox", "tcn", 5, 24)], "dataset string, arm string, params long, input_len long")
    k = spark.createDataFrame([("wolf", 100.0, 100, 300.0, 24)], "dataset string, ref_wall double, ref_params long, ref_vram double, ref_len long")
    got = {(r["dataset"], r["arm"]): (r["wall_s"], r["vram_mb"]) for r in trials.costs(t, k, ["dataset"]).collect()}
    assert got == {("wolf", "tcn"): (200.0, 1200.0), ("wolf", "lstm"): (100.0, 300.0), ("fox", "tcn"): (1000.0, 0.0)}


def test_units_sort_naturally(spark):
    x = spark.createDataFrame([("fold10",), ("fold2",), ("all",)], "u string")
    assert [r["u"] for r in x.orderBy(trials.unit_key(F.col("u"))).collect()] == ["all", "fold2", "fold10"]


def test_configs_hash_in_any_order(spark):
    x = spark.createDataFrame([(1, "a", None)], "lr long, arm string, note string")
    assert x.select(trials.config_hash(["lr", "arm", "note"])).first() == x.select(trials.config_hash(["note", "arm", "lr"])).first()
    assert x.select(F.sha2(F.lit('{"arm":"a","lr":1,"note":null}'), 256)).first() == x.select(trials.config_hash(["lr", "arm", "note"])).first()


def test_bootstrap_brackets_the_mean(spark, monkeypatch):
    x = spark.createDataFrame([(k % 40, float(k % 7)) for k in range(2000)], "c long, v double")
    r = studies.bootstrap(x, "c", "v", 500).first()
    assert r["lo"] < 3.0 < r["hi"] and r["draws"] == 500
    monkeypatch.setattr(studies, "BROADCAST_CLUSTERS", 5)
    assert studies.bootstrap(x, "c", "v", 500).first() == r


def test_median_interval_is_exact(spark):
    hours = [1, 1, 2, 5, 7, 100]
    t = [0, *(sum(hours[: k + 1]) * 3600 for k in range(6))]
    x = spark.createDataFrame([("s", "a", k, 0.0, 0.0) for k in t], "study_id string, individual_id string, t long, lat double, lon double").withColumn("timestamp", F.timestamp_seconds("t"))
    assert tuple(tracks.sampling_profile(x).first()) == (3.5, 0.0, 6)
    assert tracks.sampling_profile(x.where("t < 0")).count() == 0


def test_track_files_with_headers_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,individual_id,study_id,lat,lon\n2025-01-01T00:00:00Z,x,s,1.0,2.0\n2025-01-01T01:00:00Z,x,s,bad,2.0\n")
    (tmp_path / "b.csv").write_text("longitude,latitude,animal_id,study,time\n4.0,3.0,y,s,2025-01-01T00:00:00Z\n")
    (tmp_path / "a_ndvi.csv").write_text("study_id,individual_id,timestamp,ndvi\ns,x,2025-01-01T00:00:00Z,0.5\n")
    (tmp_path / "b_ndvi.csv").write_text("study_id,individual_id,timestamp,ndvi\n")
    got = read_dataset(spark, f"file://{tmp_path}/[ab].csv").collect()
    assert sorted((r["source_file"], r["individual_id"], r["lat"], r["lon"]) for r in got) == [("a.csv", "x", 1.0, 2.0), ("b.csv", "y", 3.0, 4.0)]
    got = read_dataset(spark, f"file://{tmp_path}/*.csv", "ndvi").collect()
    assert sorted((r["individual_id"], r["ndvi"], r["matched"]) for r in got) == [("x", "0.5", True), ("y", None, False)]
    (tmp_path / "b_ndvi.csv").write_text("study_id,individual_id,timestamp,evi\n")
    with pytest.raises(ValueError, match="covariates"):
        read_dataset(spark, f"file://{tmp_path}/*.csv", "ndvi")
    (tmp_path / "c.csv").write_text("timestamp,individual_id,study_id,lat,lon\n2025-01-01T00:00:00Z,x,s,bad,2.0\n")
    with pytest.raises(ValueError, match="no valid fix"):
        read_dataset(spark, f"file://{tmp_path}/c.csv")
    with pytest.raises(FileNotFoundError):
        read_dataset(spark, f"file://{tmp_path}/none*.csv")


def test_small_files_in_a_store(spark, tmp_path):
    at = f"file://{tmp_path}/x.txt"
    store.write_text(spark, at, "﻿ab é\nc")
    assert store.exists(spark, at) and not store.exists(spark, at + "y") and store.first_line(spark, at) == "ab é" and store.read_text(spark, at).endswith("c")
    x = spark.createDataFrame([(1234567.0, 1), (0.000012345678, 2), (None, 3)], "v double, k long")
    assert not files.write_wide(x, f"file://{tmp_path}/wide", ["k"])
    assert [r["v"] for r in spark.read.csv(f"file://{tmp_path}/wide", header=True, schema="v double, k long").orderBy("k").collect()] == [1234570.0, 1.23457e-05, None]
