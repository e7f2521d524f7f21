"""Track sources: CSV files with varying headers, and the events table read as fixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.covariates import attach
from trackloom.operators.products import covariate_path
from trackloom.sources import store

# The header names that each slot may have, in order of preference.
ALIASES = {
    "timestamp": ("timestamp", "time", "datetime", "acquisition_time"),
    "individual_id": ("individual_id", "individual", "animal_id", "deployment_id"),
    "study_id": ("study_id", "study", "dataset_id"),
    "lat": ("lat", "latitude", "location_lat"),
    "lon": ("lon", "longitude", "location_long"),
    "species": ("species",),
}


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Fixes of a CSV file: first alias of each slot, bad coordinates dropped, species '' where absent.

    A missing slot raises and names them all; a time that can't be read raises when it is reached.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False)
    pick = {slot: next((c for c in names if c in raw.columns), None) for slot, names in ALIASES.items()}
    if missing := [s for s, c in pick.items() if c is None and s != "species"]:
        raise ValueError(f"{path} lacks columns for {', '.join(missing)}")
    num = lambda c: F.col(c).try_cast("double")
    out = raw.select(
        F.to_timestamp(pick["timestamp"]).alias("timestamp"),
        F.col(pick["individual_id"]).alias("individual_id"),
        F.col(pick["study_id"]).alias("study_id"),
        (F.col(pick["species"]) if pick["species"] else F.lit("")).alias("species"),
        num(pick["lat"]).alias("lat"),
        num(pick["lon"]).alias("lon"),
    )
    return out.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")


def read_dataset(spark: SparkSession, pattern: str, covariates: str | None = None, keys: tuple[str, ...] = ("study_id", "individual_id", "timestamp")) -> DataFrame:
    """Fixes of all files that match, each by its own header, in lexical order of the files; `source_file` names a row's file.

    With covariates, the name of a source, each file's fixes get those of <stem>_<source>.csv beside it
    before files are put together, with `matched`; all files must have the same columns in one order.
    No file, or one without a valid fix, raises.
    """
    beside = [] if covariates is None else store.matching(spark, covariate_path(pattern, covariates))
    files = [f for f in store.matching(spark, pattern) if f not in beside]
    if not files:
        raise FileNotFoundError(f"no track files match {pattern}")
    parts, columns = [], None
    for path in files:
        x = read_tracks(spark, path)
        if x.isEmpty():
            raise ValueError(f"{path} has no valid fix")
        if covariates is not None:
            extra = spark.read.csv(covariate_path(path, covariates), header=True, inferSchema=False)
            own = [c for c in extra.columns if c not in keys]
            if columns is not None and own != columns:
                raise ValueError(f"{path}: covariates {own}, not {columns}")
            columns = own
            extra = extra.withColumn("timestamp", F.to_timestamp("timestamp")).withColumn("__at", F.monotonically_increasing_id())
            x = attach(x, extra, list(keys), "__at")
        parts.append(x.withColumn("source_file", F.lit(path.rpartition("/")[2])))
    return reduce(DataFrame.unionByName, parts)


def fixes_of_events(events: DataFrame) -> DataFrame:
    """The events table as fixes: a user is an animal, value and props.k give the place."""
    return events.select(
        "event_id",
        F.concat(F.lit("study_"), F.col("user_id") % 3).alias("study_id"),
        F.concat(F.lit("u"), F.col("user_id")).alias("individual_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        (38.0 + F.col("value") / 10000.0).alias("lat"),
        (-100.0 + F.get_json_object("props", "$.k").cast("double") / 1000.0).alias("lon"),
    )
