"""Covariates of fixes: joins, scalers, clips, spectral indices and quality masks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def attach(fixes: DataFrame, covariates: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Left join to the first covariate row of each key; `matched` tells which fixes have one."""
    if clash := (set(fixes.columns) & set(covariates.columns)) - {*keys, ordinal}:
        raise ValueError(f"both tables have {sorted(clash)}")
    first = covariates.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal))).where("__k = 1").drop("__k", ordinal)
    return fixes.join(first.withColumn("matched", F.lit(True)), keys, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def scaler(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation of each column over what is there; 0 and 1 where nothing is, 1 where all is equal."""
    out = []
    for c in columns:
        v = F.when(~F.isnan(c), F.col(c))
        out += [F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{c}_mean"), F.when(F.coalesce(F.stddev_pop(v), F.lit(0.0)) <= 1e-8, 1.0).otherwise(F.stddev_pop(v)).alias(f"{c}_std")]
    return rows.agg(*out)


def clip(c, lo: float, hi: float):
    """Null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def ratio_index(a, b):
    return F.try_divide(a - b, a + b)


def evi(nir, red, blue):
    return F.try_divide(2.5 * (nir - red), nir + 6 * red - 7.5 * blue + 1)


def age_days(ts, observed):
    """Signed age of an observation in days."""
    return (F.unix_micros(ts) - F.unix_micros(observed)) / 86400e6


def combine(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Inner join of one-to-one tables on a key: their columns prefixed by name, tables in alphabetical order."""
    out = None
    for name in sorted(tables):
        t = tables[name].select(key, *(F.col(c).alias(f"{name}_{c.removeprefix('_')}") for c in tables[name].columns if c != key))
        out = t if out is None else out.join(t, key)
    return out


def universe_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys that only one of two tables has, and keys that stand more than once in each."""
    side = lambda d, n: d.groupBy(key).agg(F.count("*").alias(n))
    x = side(a, "a").join(side(b, "b"), key, "full")
    total = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    return x.agg(total(F.col("b").isNull(), "only_a"), total(F.col("a").isNull(), "only_b"), total(F.coalesce(F.col("a") > 1, F.lit(False)), "repeated_a"), total(F.coalesce(F.col("b") > 1, F.lit(False)), "repeated_b"))


def missing_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: median and largest share of nulls over the columns."""
    gone = F.array_sort(F.array(*(F.avg((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double")) for c in columns)))
    n = len(columns)
    return rows.agg(gone.alias("g")).select(((F.get("g", F.lit((n - 1) // 2)) + F.get("g", F.lit(n // 2))) / 2).alias("median_missing"), F.array_max("g").alias("max_missing"))


def changes(rows: DataFrame, window: list[str], pos: str, value: str) -> DataFrame:
    """Of each value in a window: anomaly against the mean of what is observed, and step change where both are; 0 and a flag where undefined."""
    v = F.col(value)
    w = Window.partitionBy(*window)
    anomaly, step = v - F.avg(v).over(w), v - F.lag(v).over(w.orderBy(pos))
    x = rows.withColumn("anomaly", anomaly).withColumn("step_change", step)
    x = x.withColumn("anomaly_missing", F.col("anomaly").isNull()).withColumn("step_missing", F.col("step_change").isNull())
    return x.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("anomaly", "step_change")})


def standardise(rows: DataFrame, scales: DataFrame, columns: list[str], limit: float) -> DataFrame:
    """Columns to clipped z scores by the one row of scaler(); what is missing becomes 0 with a flag."""
    x = rows.crossJoin(F.broadcast(scales))  # one row
    for c in columns:
        z = (F.nanvl(F.col(c).cast("double"), F.lit(None)) - F.col(f"{c}_mean")) / F.col(f"{c}_std")
        x = x.withColumn(f"{c}_missing", z.isNull()).withColumn(c, F.coalesce(clip(z, -limit, limit), F.lit(0.0)))
    return x.drop(*scales.columns)


def unscaled(rows: DataFrame, scales: DataFrame, columns: list[str]) -> DataFrame:
    """Z scores back to values by the one row of scaler()."""
    x = rows.crossJoin(F.broadcast(scales))  # one row
    return x.withColumns({c: F.col(c) * F.col(f"{c}_std") + F.col(f"{c}_mean") for c in columns}).drop(*scales.columns)


def change_scales(changed: DataFrame) -> DataFrame:
    """One row: population deviations of what changes() observed; 1 where there is none or next to none."""
    def std(c, gone):
        s = F.coalesce(F.stddev_pop(F.when(~F.col(gone), F.col(c))), F.lit(0.0))
        return F.when(s > 1e-8, s).otherwise(1.0).alias(f"{c}_std")

    return changed.agg(std("anomaly", "anomaly_missing"), std("step_change", "step_missing"))


def select_columns(names: list[str], include: list[str], exclude: list[str]) -> list[str]:
    """Names that some include pattern and no exclude pattern is found in."""
    return [n for n in names if any(re.search(p, n) for p in include) and not any(re.search(p, n) for p in exclude)]


def numeric_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as floats; one that has values but no numbers goes, one that is all null stays."""
    num = {c: F.col(c).try_cast("double") for c in columns}
    seen = rows.agg(*(F.struct(F.count(c).alias("n"), F.count(num[c]).alias("k")).alias(c) for c in columns)).first() if columns else {}
    gone = [c for c in columns if seen[c]["n"] and not seen[c]["k"]]
    return rows.withColumns({c: num[c].cast("float") for c in columns if c not in gone}).drop(*gone)


def key_digest(keys: DataFrame, columns: list[str]) -> DataFrame:
    """One row: number of keys and a digest that doesn't depend on their order, from sums of both halves of their hashes."""
    h = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)))
    part = lambda a: F.sum(F.conv(F.substring(h, a, 12), 16, 10).cast("decimal(38,0)"))
    x = keys.agg(F.count("*").alias("n"), part(1).alias("a"), part(13).alias("b"))
    return x.select("n", F.substring(F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256), 1, 16).alias("digest"))
