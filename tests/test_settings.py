"""Settings, registries, folders of runs, splits, model inputs and the ledger's stream."""

import copy
import json
import math
from dataclasses import dataclass, field

import pytest
import yaml
from pyspark.sql import functions as F

from trackloom.operators import batches, covariates, folds, pixels, tracks
from trackloom.plans.registry import assembly
from trackloom.sources import settings, store
from trackloom.streaming import sessions

REGISTRY = assembly.REGISTRY


def test_settings_merge_and_override(spark, tmp_path):
    base, arm = f"file://{tmp_path}/base.yaml", f"file://{tmp_path}/arm.yaml"
    store.write_text(spark, base, yaml.safe_dump({"data": {"csv": "x", "inner": {"a": 1, "b": 2}}, "model": {"channels": [1], "kernel": 3}, "trainer": {"lr": 0.1, "amp": True}}))
    store.write_text(spark, arm, yaml.safe_dump({"data": {"inner": {"b": 5}}, "model": {"hidden": 8}}))
    got = settings.load(spark, base, arm, ["trainer.lr=1e-3", "trainer.amp=False", "data.inner.a=[1, 2]", "data.csv=deer"])
    assert got == {"data": {"csv": "deer", "inner": {"a": [1, 2], "b": 5}}, "model": {"hidden": 8}, "trainer": {"lr": 0.001, "amp": False}}
    for bad, kind in ((["lr"], ValueError), (["trainer.none=1"], KeyError), (["none.lr=1"], KeyError), (["data.csv.x=1"], KeyError)):
        with pytest.raises(kind):
            settings.load(spark, base, arm, bad)
    with pytest.raises(FileNotFoundError):
        settings.load(spark, base, f"file://{tmp_path}/none.yaml")
    assert settings.filled_in({"a": ["${HERE}", "x${HERE}"]}, {"HERE": "there"}) == {"a": ["there", "x${HERE}"]}
    with pytest.raises(RuntimeError):
        settings.filled_in("${GONE}", {})


def test_typed():
    @dataclass(frozen=True)
    class Windows:
        length: int = 6
        horizon: int = 3

    @dataclass(frozen=True)
    class All:
        csv: str
        windows: Windows = field(default_factory=Windows)
        names: tuple = ()

    assert settings.typed(All, {"csv": "x", "windows": {"length": 9}, "names": ["a"]}) == All("x", Windows(9), ("a",))
    for bad in ({}, {"csv": "x", "other": 1}, {"csv": "x", "windows": {"wide": 1}}):
        with pytest.raises(ValueError):
            settings.typed(All, bad)


def test_registry(spark):
    r = settings.registry({**REGISTRY, "datasets": {"deer": {"csv": "deer.csv", "fixes": 5}}}, barred=["elk"])
    assert r.dataset("deer").fixes == 5 and r.source("relief").scale_m == 30 and r.select("tier3,all") == ["relief", "greenness"]
    assert r.table(spark).count() == 2
    for name, kind in (("elk", ValueError), ("fox", KeyError)):
        with pytest.raises(kind):
            r.dataset(name)
    with pytest.raises(KeyError):
        r.source("none")
    wrong = [
        ("cadence", "weekly"), ("chunk_bucket", "week"), ("kind", "table"), ("reducers", ["mean"]), ("reducers", ["first", "max"]), ("composite_days", 0), ("cadence", "annual"), ("cadence", "daily"),
        ("grid", {"mode": "hex", "res": [1, 1]}), ("grid", {"mode": "fixed", "res": [1, 1]}), ("class_fractions", [{"name": "x"}]), ("temporal_rates", [{"name": "r", "band": "none"}]),
        ("temporal_rates", [{"name": "r", "band": "ndvi", "lag_windows": 0}]), ("colour", "red"),
    ]
    for key, value in wrong:
        said = copy.deepcopy(REGISTRY)
        said["sources"]["greenness"][key] = value
        with pytest.raises(ValueError, match="greenness"):
            settings.registry(said)
    for said in ({"export": {}, "datasets": {}}, {**REGISTRY, "export": {"destination": "tape"}}):
        with pytest.raises(ValueError):
            settings.registry(said)


def test_folder_of_a_run(spark, tmp_path):
    at = f"file://{tmp_path}"
    settings.write_run(spark, at, {"a": {"b": [1, 2]}}, {"seed": 7})
    assert yaml.safe_load(store.read_text(spark, f"{at}/config.yaml")) == {"a": {"b": [1, 2]}} and json.loads(store.read_text(spark, f"{at}/manifest.json")) == {"seed": 7}
    report = spark.createDataFrame([(1.5, None)], "ade double, es double")
    steps, windows = spark.createDataFrame([(2, None), (1, 0.5)], "step long, ade double"), spark.createDataFrame([("a", 1.0), ("b", 2.0)], "individual_id string, es double")
    settings.write_evaluation(at, report, steps, windows, "tcn", "test")
    said = json.loads(store.read_text(spark, f"{at}/metrics.json"))
    assert said["ade"] == 1.5 and said["es"] is None and said["model"] == "tcn" and said["per_window_file"] == "per_window.csv"
    assert store.read_text(spark, f"{at}/per_horizon.csv") == "step,ade\n1,0.5\n2,\n"
    assert spark.read.csv(f"{at}/per_window.csv", header=True).count() == 2
    assert settings.markdown(steps.orderBy("step")) == "| step | ade |\n| --- | --- |\n| 1 | 0.5000 |\n| 2 |  |\n"
    with pytest.raises(ValueError):
        settings.markdown(steps, most=1)
    assert len(settings.chunk_outputs(spark, at, "metrics")) == 1
    with pytest.raises(FileNotFoundError):
        settings.chunk_outputs(spark, at, "c0ffee")


def test_splits_and_folds(spark):
    seg = spark.createDataFrame([("s", a, i, f"2025-01-0{d}") for a in "abcd" for i in (0, 1) for d in (1, 2)], "study_id string, individual_id string, seg long, t string").withColumn("timestamp", F.to_timestamp("t"))
    by_animal, by_segment = tracks.split_animals(seg, 0.25, 0.25), tracks.split_segments(seg, 0.25, 0.25)
    assert sorted(r[0] for r in by_animal.select("split").collect()) == ["test", "train", "train", "val"]
    assert by_segment.groupBy("split").count().orderBy("split").collect() == [("test", 2), ("train", 4), ("val", 2)]
    assert tracks.follow(seg, by_animal).count() == 16
    tracks.check_disjoint(by_animal)
    shared = spark.createDataFrame([("s", "a", "train"), ("s", "a", "val"), ("s", "b", "test")], "study_id string, individual_id string, split string")
    tracks.check_disjoint(shared, tail=True)
    with pytest.raises(ValueError, match="train_val"):
        tracks.check_disjoint(shared)
    with pytest.raises(ValueError, match="train_test"):
        tracks.check_disjoint(shared.replace("val", "test"), tail=True)
    assert tracks.overlaps(shared.limit(0)).first() == (0, 0, 0)
    dealt = spark.createDataFrame([("s", "a", 0), ("s", "b", 1), ("s", "c", 2)], "study_id string, individual_id string, fold int")
    roles = folds.all_roles(dealt, 3)
    assert roles.where("role = 'test'").select("individual_id").distinct().count() == 3 and roles.groupBy("role").count().where("count = 3").count() == 3
    cuts = spark.createDataFrame([("s", a, "2025-01-02") for a in "abc"], "study_id string, individual_id string, t string").withColumn("val_cut", F.to_timestamp("t"))
    got = folds.tail_roles(seg, dealt, cuts, 1).groupBy("individual_id", "role").count().orderBy("individual_id", "role").collect()
    assert got == [("a", "train", 2), ("a", "val", 2), ("b", "test", 4), ("c", "train", 2), ("c", "val", 2)]


def window(spark, rows):
    return spark.createDataFrame([("s", "a", 0, w, p, p - 1, f"2025-01-01 0{p}:00:00", float(dx), float(dy), 3.0 * dx, 4.0 * dx, 0.0, 0.0) for w, p, dx, dy in rows], "study_id string, individual_id string, seg long, start long, pos int, step int, t string, dx double, dy double, x double, y double, px double, py double").withColumn("timestamp", F.to_timestamp("t"))


def test_model_inputs(spark):
    x = window(spark, [(w, p, w + p, -p) for w in (0, 1, 2) for p in (2, 0, 1)])
    r = batches.assembled(x, 2, ["dx", "dy"]).where("start = 1").first()
    assert (r["x"], r["y"], r["dt"]) == ([[1, 0], [2, -1]], [[3, -2]], [0, 3600])
    assert {t["start"] for t in batches.evenly(x, 2).collect()} == {0, 2} and batches.evenly(x, 9).count() == 9
    assert batches.target_scale(x.where("start = 0"), 2).first()[0] == 2.0
    for none in (x.limit(0), x.withColumn("dx", F.lit(0.0)).withColumn("dy", F.lit(0.0))):
        assert batches.target_scale(none, 2).first()[0] == 1.0
    spec = batches.width_spec(x, x.where("start = 0"), 2, ["a"], 4, (2, 3)).first()
    assert (spec["n_covariates"], spec["n_time_features"], spec["n_memory_step"], spec["val_windows"], spec["small_validation"]) == (1, 4, 2, 1, True)
    e = spark.range(1).select(batches.time_encoding(F.lit(2.0), 4).alias("e")).first()[0]
    assert e == pytest.approx([math.sin(2), math.cos(2), math.sin(0.02), math.cos(0.02)])
    assert batches.gate_mean(spark.createDataFrame([(0.0,), (None,)], "z double"), "z").first()[0] == 0.5


def test_scores_of_windows(spark):
    x = window(spark, [(0, 1, 1, 0), (0, 2, 2, 0)])
    r = batches.window_scores(x).first()
    assert (r["es"], r["ade"], r["fde"], r["ade_cp"]) == (7.5, 7.5, 10.0, 7.5)
    one = x.withColumn("samples", F.expr("array(struct(px as x, py as y))"))
    assert batches.window_scores(one, "samples").first()["es"] == pytest.approx(7.5, abs=1e-6)


def test_change_scales(spark):
    x = spark.createDataFrame([(1.0, False, 0.0, True), (3.0, False, 0.0, True), (9.0, True, 5.0, True)], "anomaly double, anomaly_missing boolean, step_change double, step_missing boolean")
    assert covariates.change_scales(x).first() == (1.0, 1.0)
    v = spark.createDataFrame([(1.0, 5.0), (3.0, None)], "a double, b double")
    s = covariates.scaler(v, ["a", "b"])
    z = spark.createDataFrame([(-1.0, 0.0), (1.0, None)], "a double, b double")
    assert covariates.unscaled(z, s, ["a", "b"]).collect() == v.collect()


def test_ledger_follows_states(spark, tmp_path):
    at, incoming = f"file://{tmp_path}/ledger", tmp_path / "states"
    ledger = spark.createDataFrame([("a", "submitted", "t1", 0), ("b", "running", "t2", 0), ("c", "complete", "t3", 0), ("d", "pending", None, 0)], "chunk_id string, status string, task_id string, seq long")
    ledger.select("*", F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast("string").alias("failure_reason")).write.parquet(at)
    schema = "task_id string, state string, error_message string, at long"
    for rows in ([("t1", "RUNNING", None, 1), ("t2", "RUNNING", None, 1), ("t3", "FAILED", "late", 1)], [("t1", "FAILED", "x" * 300, 2), ("t2", "COMPLETED", None, 2), ("t2", "RUNNING", None, 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"file://{incoming}")
        sessions.follow_states(spark.readStream.schema(schema).json(f"file://{incoming}"), at, f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    now = {r["chunk_id"]: r for r in pixels.last_wins(spark.read.parquet(at), "chunk_id", "seq").collect()}
    assert {k: r["status"] for k, r in now.items()} == {"a": "failed", "b": "complete", "c": "complete", "d": "pending"}
    assert len(now["a"]["failure_reason"]) == 200 and now["a"]["finished_at"] and now["b"]["failure_reason"] is None
    assert spark.read.parquet(at).count() == 7
    assert pixels.status_counts(spark.createDataFrame([("failed",)], "status string"), ("failed", "pending")).orderBy("status").collect() == [("failed", 1), ("pending", 0)]
