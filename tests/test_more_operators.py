"""Pinned cases and brute force for folds, chunks, rasters, projections, band text and files."""

import json
import math

import pytest
from pyspark.sql import functions as F

from trackloom.functions import bands, projection
from trackloom.operators import covariates, folds, rasters, studies
from trackloom.sources import files

COLUMNS = {"timestamp": "t", "individual_id": "id", "study_id": "s", "lon": "x", "lat": "y"}


def test_utm_known_places_and_round_trip(spark):
    x = spark.createDataFrame([(3.0, 45.0), (-99.0, 0.0), (174.7, -36.8), (-100.2, 38.1)], "lon double, lat double")
    e, n = projection.utm(F.col("lon"), F.col("lat"))
    x = x.withColumn("e", e).withColumn("n", n).withColumn("zone", projection.utm_zone(F.col("lon")))
    lon, lat = projection.from_utm(F.col("zone"), F.col("lat") < 0, F.col("e"), F.col("n"))
    rows = x.withColumn("lon2", lon).withColumn("lat2", lat).collect()
    assert abs(rows[0]["e"] - 500000) < 1e-3 and abs(rows[0]["n"] - 4982950.400) < 2e-3 and abs(rows[1]["n"]) < 1e-6
    assert all(abs(r["lon"] - r["lon2"]) < 1e-9 and abs(r["lat"] - r["lat2"]) < 1e-9 for r in rows)


def test_band_text(spark):
    x = spark.createDataFrame([(3.0, 1.0), (1.0, -1.0)], "B8 double, B4 double")
    assert [r[0] for r in x.select(bands.band_expression("(b('B8') - b('B4')) / (b('B8') + b('B4'))")).collect()] == [0.5, None]
    for bad in ("__import__('os')", "B8", "b('B8').x", "b('B8') if 1 else 2", "True"):
        with pytest.raises(ValueError):
            bands.band_expression(bad)


@pytest.mark.parametrize(("sizes", "target", "cap", "want"), [([250], 100, 9, [100, 100, 50]), ([10] * 20, 100, 8, [80, 80, 40]), ([5, 300, 5], 100, 8, [5, 100, 100, 100, 5])])
def test_chunk_packing(spark, sizes, target, cap, want):
    rows = [(1, f"b{i}", i) for i, n in enumerate(sizes) for _ in range(n)]
    got = folds.pack_chunks(spark.createDataFrame(rows, "zone long, bucket string, t0 long"), target, cap).orderBy("chunk").collect()
    assert [r["n_keys"] for r in got] == want


def test_folds_are_balanced(spark):
    sizes = [56, 199, 236, 398, 418, 616, 637, 642, 725, 1285, 2339, 2970, 3284, 3844, 5640, 6097, 6488, 6588]
    x = spark.createDataFrame([("s", f"a{i}", n) for i, n in enumerate(sizes)], "study_id string, individual_id string, n long")
    totals = [r[1] for r in folds.balanced_folds(x, 5).groupBy("fold").agg(F.sum("n")).collect()]
    assert len(totals) == 5 and max(totals) / min(totals) < 1.05


@pytest.mark.parametrize(("n", "most"), [(1, 5), (5, 1), (7, 7), (10, 4), (101, 13), (3, 9)])
def test_even_subsample(spark, n, most):
    x = spark.range(n).select(F.col("id").alias("k"), F.lit(n).alias("n"))
    m = min(n, most)
    want = {i * (n - 1) // max(m - 1, 1) for i in range(m)}
    assert {r["k"] for r in folds.even_subsample(x, most).collect()} == want


def test_composers_keep_requested_keys(spark):
    x = spark.createDataFrame([(1, 1, 5.0, 1), (1, 1, None, 3), (1, 1, 7.0, 2), (1, 2, None, 1)], "px_row long, px_col long, v double, t long")
    asked = spark.createDataFrame([(1, 1), (1, 2), (9, 9)], "px_row long, px_col long")
    got = {(r["px_row"], r["px_col"]): tuple(r)[2:] for r in rasters.padded(asked, rasters.composite(x, rasters.PIXEL, "v", "t"), rasters.PIXEL).collect()}
    assert got == {(1, 1): (6.0, 7.0, 5.0, 2), (1, 2): (None, None, None, 0), (9, 9): (None, None, None, None)}


def test_terrain_of_a_plane(spark):
    x = spark.createDataFrame([(r, c, 2.0 * c) for r in range(5) for c in range(5)], "px_row long, px_col long, v double")
    got = rasters.terrain(x, "v", 1.0).collect()
    assert len(got) == 9 and all(abs(r["gx"] - 2) < 1e-12 and abs(r["gy"]) < 1e-12 and abs(r["slope"] - math.degrees(math.atan(2))) < 1e-9 for r in got)


def test_distance_over_filled_water(spark):
    rows = [(r, c, 1.0 if 4 <= r <= 9 and 3 <= c <= 8 else None) for r in range(14) for c in range(14)]
    got = rasters.distance_to(spark.createDataFrame(rows, "px_row long, px_col long, v double"), "v", 1.0, 4).collect()
    water = [(r, c) for r, c, v in rows if v]
    for g in got:
        want = min(math.hypot(g["px_row"] - a, g["px_col"] - b) for a, b in water)
        assert g["distance"] == (pytest.approx(want) if want <= 4 else None)


def test_early_stopping(spark):
    x = spark.createDataFrame([("a", i, v) for i, v in enumerate([5.0, 4.0, 4.00001, 3.99995, 4.1, 1.0])] + [("b", i, 3.0 - i) for i in range(3)], "run string, epoch long, loss double")
    got = {r["run"]: tuple(r)[1:] for r in studies.early_stopping(x, "run", "epoch", "loss", 3).collect()}
    assert got == {"a": (1, 4.0, 4), "b": (2, 1.0, None)}


def test_columns(spark):
    assert covariates.select_columns(["s2_ndvi", "s2_B4", "era_t"], ["^s2"], ["B4"]) == ["s2_ndvi"]
    x = spark.createDataFrame([("1", "x", None), ("b", "y", None)], "a string, b string, c string")
    assert covariates.numeric_columns(x, ["a", "b", "c"]).columns == ["a", "c"]
    d = [covariates.key_digest(spark.createDataFrame(r, "k long"), ["k"]).first()["digest"] for r in ([(1,), (2,)], [(2,), (1,)], [(1,), (3,)])]
    assert d[0] == d[1] != d[2]


def test_strict_fixes(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("﻿t,id,s,x,y,id\n2025-01-01 00:00:00,a,s,1,2,a\n2025-01-01 01:00:00,a,s,1,2,a\n", encoding="utf-8")
    with pytest.raises(ValueError, match="repeats"):
        files.read_strict(spark, str(p), COLUMNS)
    got = files.read_strict(spark, str(p), COLUMNS, ("id",)).collect()
    assert len({r["fix_id"] for r in got}) == 2 and len(got[0]["fix_id"]) == 40
    p.write_text("t,id,s,x,y,id\n2025-01-01 00:00:00,a,s,1,2,b\n")
    with pytest.raises(ValueError, match="disagree"):
        files.read_strict(spark, str(p), COLUMNS, ("id",))
    p.write_text("t,id,s,x,y\n2025-01-01 00:00:00,a,s,1,2\n2025-01-01 00:00:00,a,s,3,4\n")
    with pytest.raises(ValueError, match="repeated fixes"):
        files.read_strict(spark, str(p), COLUMNS)


def test_ledger_and_chunks(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "chunk_id string, status string")
    files.append_ledger(rows(("a", "pending"), ("b", "pending")), str(tmp_path / "log"), 1)
    files.append_ledger(rows(("a", "complete")), str(tmp_path / "log"), 2)
    with pytest.raises(ValueError, match="status"):
        files.append_ledger(rows(("a", "lost")), str(tmp_path / "log"), 3)
    assert {r["chunk_id"]: r["status"] for r in files.read_ledger(spark, str(tmp_path / "log")).collect()} == {"a": "complete", "b": "pending"}
    (tmp_path / "c1.csv").write_text("key_index,v\n1,2\n")
    (tmp_path / "c2.csv").write_text("key_index,v\n2,3\n")
    paths = [str(tmp_path / "c1.csv"), str(tmp_path / "c2.csv")]
    assert {(r["key_index"], r["chunk_id"]) for r in files.read_chunks(spark, paths).collect()} == {(1, "c1"), (2, "c2")}
    with pytest.raises(ValueError, match="twice"):
        files.read_chunks(spark, [*paths, paths[0]])


def test_split_scaler_and_runs(spark, tmp_path):
    split = spark.createDataFrame([("a", "train"), ("b", "val"), ("c", "test")], "individual_id string, split string")
    files.write_split(split, str(tmp_path / "s.json"))
    assert sorted(files.read_split(spark, str(tmp_path / "s.json"), split).collect()) == sorted(split.collect())
    with pytest.raises(ValueError, match="not in the data"):
        files.read_split(spark, str(tmp_path / "s.json"), split.where("split <> 'val'"))
    x = covariates.scaler(spark.createDataFrame([(1.0,), (3.0,)], "v double"), ["v"])
    files.write_scaler(x, ["v"], str(tmp_path / "z.json"), 5.0)
    assert tuple(files.read_scaler(spark, ["v"], str(tmp_path / "z.json")).first()) == (2.0, 1.0)
    with pytest.raises(ValueError):
        files.read_scaler(spark, ["w"], str(tmp_path / "z.json"))
    for run, ade in (("2001", 1.0), ("2002", 2.0)):
        at = tmp_path / "unit_1" / "arm" / run
        at.mkdir(parents=True)
        (at / "metrics.json").write_text(json.dumps({"ade": ade, "n_windows": 4}, indent=1))
    got = files.read_runs(spark, [str(tmp_path / "unit_1/arm/*/metrics.json")]).collect()
    assert [(r["unit"], r["arm"], r["run"], r["es"]) for r in got] == [("unit_1", "arm", "2002", 2.0)]


def test_animal_bootstrap_takes_the_draws_of_the_reference(spark):
    from trackloom.plans import registry

    got = registry.QUERIES["animal_bootstrap"](spark, "/root/testdata/sf0.001").first()
    assert got["draws"] == 4000 and got["lo"] < got["hi"]
