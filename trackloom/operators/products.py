"""Per-source products: sampled pixels back to fixes, their files, guards, raster sampling, and what a registry says of sources."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUFFER = "_buf30"


# ---- sampled keys to fixes -------------------------------------------------


def value_columns(bands: list[str], present: list[str]) -> tuple[list[str], list[str]]:
    """Declared bands that an export has, and their buffer twins, in declared order; none at all raises."""
    own = [b for b in bands if b in present]
    if not own:
        raise ValueError(f"none of {bands} among the exported columns {present}")
    return own, [b + BUFFER for b in own if b + BUFFER in present]


def fix_table(fixes: DataFrame, fixmap: DataFrame, sampled: DataFrame, bands: list[str], dataset: str, age: Column, extra: tuple[str, ...] = ("n_scenes",)) -> DataFrame:
    """A row for each mapped fix: fix_id, dataset, timestamp, bands and twins as numbers, <band>_missing, n_scenes if there, _age_hours.

    fixmap: fix_id, key_index; sampled: key_index and values, once for each key. A key without values
    gives nulls that are marked as missing: unmatched() counts them. age is a column of timestamp.
    """
    own, twins = value_columns(bands, sampled.columns)
    more = [c for c in extra if c in sampled.columns]
    x = fixmap.select("fix_id", "key_index").join(sampled, "key_index", "left").join(fixes.select("fix_id", "timestamp"), "fix_id", "left")
    num = {c: F.col(c).cast("string").try_cast("double") for c in (*own, *twins, *more)}
    gone = {c: num[c].isNull() | F.isnan(num[c]) for c in own}
    return x.select(
        "fix_id", F.lit(dataset).alias("dataset"), "timestamp", *(num[c].alias(c) for c in (*own, *twins)), *(gone[c].alias(f"{c}_missing") for c in own), *(num[c].alias(c) for c in more), age.alias("_age_hours")
    )


def unmatched(fixmap: DataFrame, sampled: DataFrame) -> DataFrame:
    """One row: fixes whose key has no exported value."""
    return fixmap.join(sampled.select("key_index"), "key_index", "left_anti").agg(F.count("*").alias("unmatched"))


def completed(ledger: DataFrame, expected: DataFrame, key: str = "chunk_id", ordinal: str = "seq") -> DataFrame:
    """Expected chunks that the ledger's last word shows as complete, with the ledger's order; none raises."""
    last = ledger.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by("status", ordinal).alias("status"), F.min(ordinal).alias("place"))
    out = last.where("status = 'complete'").join(expected, key, "left_semi").select(key, "place")
    if out.isEmpty():
        raise ValueError("no chunk is recorded complete: submit and poll first")
    return out


def write_source(rows: DataFrame, root: str, dataset: str, source: str) -> None:
    """The Parquet table of a (dataset, source)."""
    rows.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{dataset}/{source}")


def read_sources(spark: SparkSession, root: str, dataset: str) -> dict[str, DataFrame]:
    """All tables of a dataset by source, from any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{dataset}")
    names = [s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    return {n.removesuffix(".parquet"): spark.read.parquet(f"{root.rstrip('/')}/{dataset}/{n}") for n in sorted(names) if n[0] not in "._"}


def covariate_path(stem: str, source: str) -> str:
    """The file that holds a source's covariates of a track file."""
    return f"{stem.removesuffix('.csv')}_{source}.csv"


# ---- guards ----------------------------------------------------------------


def reduction_verdict(reduction: DataFrame, scale_m, coarse_m: float = 30.0, most_pixels: float = 0.5, warn_keys: float = 0.9) -> DataFrame:
    """verdict of reduction() rows: 'fail' if a coarse source keeps too many pixels, 'warn' if keys hardly collapse, else 'ok'."""
    fails = (F.lit(scale_m) > coarse_m) & (F.col("pixel_ratio") > most_pixels)
    return reduction.withColumn("verdict", F.when(fails, "fail").when(F.col("key_ratio") > warn_keys, "warn").otherwise("ok"))


def check_reduction(reduction: DataFrame, scale_m: float, **limits) -> None:
    """Raises or warns as reduction_verdict() says."""
    row = reduction_verdict(reduction, scale_m, **limits).first()
    if row["verdict"] == "fail":
        raise ValueError(f"{row['pixels']} pixels of {row['fixes']} fixes at {scale_m} m: the grid doesn't fit the source")
    if row["verdict"] == "warn":
        warnings.warn(f"{row['keys']} keys of {row['fixes']} fixes: the time key does little", stacklevel=2)


def check_version(rows: DataFrame, now: str, legacy: str, column: str = "representation") -> DataFrame:
    """Artefacts with the version they count as, and whether it is today's; those without a marker are of the legacy one."""
    said = F.coalesce(F.col(column), F.lit(legacy))
    return rows.withColumn(column, said).withColumn("usable", said == now)


# ---- rasters ---------------------------------------------------------------


def sample_pixels(points: DataFrame, raster: DataFrame, bands: list[str], key: tuple[str, ...] = ("px_row", "px_col", "t0"), buffer: int = 0) -> DataFrame:
    """points with the bands of their pixel and time, null where there is none; with a buffer also <band>_buf30, the mean of what pixels up to `buffer` rows and columns away have."""
    out = points.join(raster.select(*key, *bands), list(key), "left")
    if buffer:
        # Neighbours come from the pixels' side, cut to pixels that are asked for.
        row, col, *rest = key
        near = points.select(*key).distinct()
        steps = F.sequence(F.lit(-buffer), F.lit(buffer))
        near = near.withColumn("__r", F.explode(steps)).withColumn("__c", F.explode(steps))
        cells = raster.select(F.col(row).alias("__row"), F.col(col).alias("__col"), *(F.col(c).alias(f"__{c}") for c in rest), *bands)
        same = reduce(lambda a, b: a & b, [F.col(row) + F.col("__r") == F.col("__row"), F.col(col) + F.col("__c") == F.col("__col"), *(F.col(c) == F.col(f"__{c}") for c in rest)])
        means = near.join(cells, same).groupBy(*key).agg(*(F.avg(b).alias(b + BUFFER) for b in bands))
        out = out.join(means, list(key), "left")
    return out


def pair_scenes(scenes: DataFrame, companions: DataFrame, key: str, ordinal: str, wanted: Column | None = None) -> DataFrame:
    """Scenes that pass the metadata filter, each with the first companion of its key; scenes without one go."""
    first = companions.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(ordinal))).where("__k = 1").drop("__k", ordinal)
    return (scenes.where(wanted) if wanted is not None else scenes).join(first, key)


def scale_bands(rows: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Native values to units."""
    return rows.withColumns({b: F.col(b) * f for b, f in factors.items()})


# ---- registry --------------------------------------------------------------


def select_names(known: dict[str, int | None], spec: str | None, what: str = "source") -> list[str]:
    """Names for a comma list of names, 'all' and 'tierN', in order and once each. known: name -> tier. Unknown tokens raise."""
    out: dict[str, None] = {}
    for token in [t for t in map(str.strip, (spec or "").split(",")) if t] or ["all"]:
        tier = int(token[4:]) if token.startswith("tier") and token[4:].isdigit() else None
        if token == "all" or tier is not None:
            found = sorted(n for n, t in known.items() if tier is None or t == tier)
            if tier is not None and not found:
                raise ValueError(f"no {what} in {token}")
        elif token in known:
            found = [token]
        else:
            raise KeyError(f"unknown {what} {token}; known: {sorted(known)}")
        out |= dict.fromkeys(found)
    return list(out)


def buffer_reducers(bands: DataFrame, most_m: float = 30.0) -> DataFrame:
    """reducer of each band (source, band, scale_m, reducers, categorical) in a buffer: mode for classes, mean else; null where none is asked for or pixels are too large."""
    asked = F.arrays_overlap("reducers", F.array(F.lit("mean"), F.lit("mode"))) & (F.col("scale_m") <= most_m)
    return bands.withColumn("reducer", F.when(asked, F.when(F.col("categorical"), "mode").otherwise("mean")))
