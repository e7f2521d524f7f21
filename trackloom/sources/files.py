"""Files of a study: strict fix tables, chunk exports, ledgers, splits, scalers, run scores, wide tables."""

from __future__ import annotations

import csv
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.sources import store

#: States that a ledger row may have.
STATUSES = ("pending", "submitted", "running", "complete", "failed")


def read_strict(spark: SparkSession, path: str, columns: dict[str, str], repeated: tuple[str, ...] = ()) -> DataFrame:
    """Fixes of a CSV file with fix_id; anything odd raises: a repeated header unless named and equal in every row, a bad number, a repeated fix.

    columns: file's name of timestamp, individual_id, study_id, lon and lat.
    """
    header = next(csv.reader([store.first_line(spark, path)]), [])
    names, seen = [], {}
    for h in header:
        seen[h] = seen.get(h, -1) + 1
        names.append(f"{h}.{seen[h]}" if seen[h] else h)
    if odd := {h for h, k in seen.items() if k and h not in repeated}:
        raise ValueError(f"{path} repeats columns {sorted(odd)}")
    raw = spark.read.csv(path, header=True, schema=", ".join(f"`{n}` string" for n in names), enforceSchema=True)
    pairs = [(h, f"{h}.{i}") for h, k in seen.items() for i in range(1, k + 1)]
    odd = [F.count_if(~F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))) for a, b in pairs]
    for (h, _), n in zip(pairs, raw.agg(*odd).first() if odd else (), strict=True):
        if n:
            raise ValueError(f"{path}: columns {h} disagree in {n} rows")
    if missing := [c for c in columns.values() if c not in seen]:
        raise ValueError(f"{path} lacks columns {missing}")
    at = {k: F.col(f"`{v}`") for k, v in columns.items()}
    out = raw.select(F.to_timestamp(at["timestamp"]).alias("timestamp"), at["individual_id"].alias("individual_id"), at["study_id"].alias("study_id"), at["lon"].cast("double").alias("lon"), at["lat"].cast("double").alias("lat"))
    out = out.withColumn("fix_id", F.sha1(F.concat_ws("|", "study_id", "individual_id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))))
    if again := out.groupBy("fix_id").count().where("count > 1").limit(3).collect():
        raise ValueError(f"{path}: repeated fixes, such as {[r['fix_id'] for r in again]}")
    return out


def read_chunks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Exported chunks with their chunk_id (the file's stem); a key in two rows raises."""
    x = spark.read.csv(paths, header=True, inferSchema=True)
    if "key_index" not in x.columns:
        raise ValueError("chunks have no column key_index")
    x = x.withColumn("chunk_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.csv)?$", 1))
    if again := x.groupBy("key_index").count().where("count > 1").limit(3).collect():
        raise ValueError(f"keys exported twice: {[r['key_index'] for r in again]}")
    return x


def append_ledger(rows: DataFrame, path: str, seq: int) -> None:
    """Appends transitions (chunk_id, status, ...) with a rising number; an unknown status raises before anything is written."""
    if bad := rows.where(~F.col("status").isin(*STATUSES) | F.col("status").isNull()).limit(1).collect():
        raise ValueError(f"no such status: {bad[0]['status']}")
    rows.withColumn("seq", F.lit(seq)).write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The last transition of each chunk."""
    w = Window.partitionBy("chunk_id").orderBy(F.desc("seq"))
    return spark.read.parquet(path).where("chunk_id <> ''").withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def write_split(split: DataFrame, path: str, cuts: DataFrame | None = None) -> None:
    """A JSON file of the sorted ids of train, val and test, and of cut times by id. Ids of animals are few."""
    ids = {r["split"]: r["ids"] for r in split.groupBy("split").agg(F.sort_array(F.collect_set("individual_id")).alias("ids")).collect()}
    out = {s: ids.get(s, []) for s in ("train", "val", "test")}
    if cuts is not None:
        out["val_cut"] = {r[0]: r[1] for r in cuts.select("individual_id", F.date_format("val_cut", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).collect()}
    store.write_text(split.sparkSession, path, json.dumps(out, indent=1))


def read_split(spark: SparkSession, path: str, known: DataFrame, tail: bool | None = None) -> DataFrame:
    """individual_id, split. An id in two splits, or one that the data lacks, raises; with tail, so do cut times that stand where validation isn't by tail, or lack where it is."""
    said = json.loads(store.read_text(spark, path))
    if tail is not None and tail != bool(said.get("val_cut")):
        raise ValueError(f"{path} {'lacks' if tail else 'has'} cut times of a validation by tail")
    rows = [(i, s) for s in ("train", "val", "test") for i in said.get(s, [])]
    out = spark.createDataFrame(rows, "individual_id string, split string")
    if twice := out.groupBy("individual_id").count().where("count > 1").limit(3).collect():
        raise ValueError(f"in several splits: {[r[0] for r in twice]}")
    if absent := out.join(known.select("individual_id").distinct(), "individual_id", "left_anti").limit(3).collect():
        raise ValueError(f"not in the data: {[r[0] for r in absent]}")
    return out


def write_scaler(scales: DataFrame, columns: list[str], path: str, limit: float | None = None) -> None:
    row = scales.first()
    store.write_text(scales.sparkSession, path, json.dumps({"columns": columns, "mean": [row[f"{c}_mean"] for c in columns], "std": [row[f"{c}_std"] for c in columns], "clip": limit}))


def read_scaler(spark: SparkSession, columns: list[str], path: str) -> DataFrame:
    """The one row that scaler() gave; other columns or another order raise."""
    said = json.loads(store.read_text(spark, path))
    if said["columns"] != columns:
        raise ValueError(f"the scaler is for {said['columns']}, not {columns}")
    pairs = [(f"{c}_{k}", float(v)) for k in ("mean", "std") for c, v in zip(columns, said[k], strict=True)]
    return spark.createDataFrame([tuple(v for _, v in pairs)], ", ".join(f"`{n}` double" for n, _ in pairs))


def read_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row for each .../unit/arm/run/metrics.json: the energy score falls back to ade; a unit and arm's last run stands."""
    schema = "ade double, fde double, es double, ade_cp double, n_windows long, probabilistic boolean, calibration map<string,double>"
    x = spark.read.json(paths, schema=schema, multiLine=True).withColumn("at", F.col("_metadata.file_path"))
    part = lambda i: F.regexp_extract("at", r"([^/]+)/([^/]+)/([^/]+)/[^/]+$", i)
    x = x.withColumn("unit", part(1)).withColumn("arm", part(2)).withColumn("run", part(3)).drop("at").withColumn("es", F.coalesce("es", "ade"))
    return x.withColumn("__k", F.row_number().over(Window.partitionBy("unit", "arm").orderBy(F.desc("run")))).where("__k = 1").drop("__k")


def six_digits(c: str) -> Column:
    """A float to six significant digits."""
    return F.format_string("%.5e", F.col(c).cast("double")).try_cast("double")


def write_wide(wide: DataFrame, path: str, order: list[str], most: int = 200) -> bool:
    """A wide table as CSV files in a total order (part files in sequence), floats to six digits; tells whether it is wider than `most`."""
    floats = {c: F.when(F.col(c).isNotNull(), six_digits(c)) for c, t in wide.dtypes if t in ("float", "double")}
    wide.orderBy(*order).withColumns(floats).write.mode("overwrite").csv(path, header=True)
    return len(wide.columns) > most


def load_or_build(spark: SparkSession, path: str, build, rebuild: bool = False) -> DataFrame:
    """The table at a path, built and written first where it is absent or to be rebuilt."""
    if rebuild or not store.exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
