"""Pixel and time keys of fixes, their dedup, and the joins back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("px_row", "px_col", "t0")


def snap(fixes: DataFrame, size: float, x0: float = -180.0, y0: float = 90.0) -> DataFrame:
    """px_row, px_col of a lon/lat lattice, rows downwards, and the pixel's centre."""
    out = fixes.withColumn("px_col", F.floor((F.col("lon") - x0) / size)).withColumn("px_row", F.floor((y0 - F.col("lat")) / size))
    return out.withColumn("px_lon", x0 + (F.col("px_col") + 0.5) * size).withColumn("px_lat", y0 - (F.col("px_row") + 0.5) * size)


def time_key(ts, cadence: str, k: int = 8, last_year: int = 9999):
    """Integer key of a time for a source's cadence."""
    y, m, d, h = F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts)
    keys = {
        "static": F.lit(0), "annual": F.least(y, F.lit(last_year)), "monthly": y * 100 + m, "daily": y * 10000 + m * 100 + d,
        "hourly": (y * 10000 + m * 100 + d).cast("long") * 100 + h, "composite": F.floor(F.unix_date(ts.cast("date")) / (2 * k)),
    }
    return keys[cadence].cast("long")


def nominal_time(ts, cadence: str, k: int = 8):
    """The time that a source's observation stands for."""
    noon = lambda d: F.to_timestamp(d) + F.expr("interval 12 hours")
    day = ts.cast("date")
    return {
        "hourly": lambda: F.date_trunc("hour", ts), "daily": lambda: noon(day), "monthly": lambda: noon(F.date_add(F.trunc(day, "month"), 14)),
        "annual": lambda: noon(F.add_months(F.trunc(day, "year"), 6)), "composite": lambda: noon(F.date_from_unix_date((F.floor(F.unix_date(day) / (2 * k)) * 2 * k + k).cast("int"))),
    }[cadence]()


def keys_of(snapped: DataFrame) -> DataFrame:
    """One row for each pixel and time key, with the number of fixes and the earliest time."""
    return snapped.groupBy(*KEY).agg(F.min("px_lon").alias("px_lon"), F.min("px_lat").alias("px_lat"), F.count("*").alias("n_fixes"), F.min("timestamp").alias("t_ref"))


def number_keys(keys: DataFrame, columns: int = 64) -> DataFrame:
    """key_index: 0-based place among the sorted keys: keys in the rows above, in the blocks of columns before, and in the block."""
    block = F.floor(F.col("px_col") / columns)
    x = keys.withColumn("block", block)
    sums = x.groupBy("px_row", "block").agg(F.count("*").alias("n"))
    rows = sums.groupBy("px_row").agg(F.sum("n").alias("n"))  # one for each row of pixels of the whole lattice, at most
    above = rows.select("px_row", (F.sum("n").over(Window.orderBy("px_row")) - F.col("n")).alias("above"))
    before = sums.select("px_row", "block", (F.sum("n").over(Window.partitionBy("px_row").orderBy("block")) - F.col("n")).alias("before")).join(above, "px_row")
    w = Window.partitionBy("px_row", "block").orderBy(*KEY)
    return x.join(before, ["px_row", "block"]).withColumn("key_index", F.col("above") + F.col("before") + F.row_number().over(w) - 1).drop("block", "above", "before")


def reduction(snapped: DataFrame) -> DataFrame:
    """Fixes, keys, pixels and their ratios."""
    per = snapped.groupBy("px_row", "px_col").agg(F.countDistinct("t0").alias("k"), F.count("*").alias("n"))
    out = per.agg(F.sum("n").alias("fixes"), F.sum("k").alias("keys"), F.count("*").alias("pixels"))
    return out.select("*", F.try_divide("keys", "fixes").alias("key_ratio"), F.try_divide("pixels", "fixes").alias("pixel_ratio"))


def last_wins(log: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The last row of each key of an append-only log."""
    return log.where(F.col(key).isNotNull()).withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ordinal)))).where("__k = 1").drop("__k")


def open_chunks(chunks: DataFrame, log: DataFrame, key: str, settled: tuple[str, ...]) -> DataFrame:
    """Chunks that the log doesn't show as settled."""
    return chunks.join(log.where(F.col("status").isin(*settled)).select(key), key, "left_anti")


def status_counts(log: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Rows of each status, 0 for those of `statuses` that the log lacks."""
    zero = log.sparkSession.createDataFrame([(s, 0) for s in statuses], "status string, n long")
    return log.groupBy("status").agg(F.count("*").alias("n")).unionByName(zero).groupBy("status").agg(F.sum("n").alias("n"))


def plan_summary(snapped: DataFrame, buckets: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: reduction() with the number of time buckets, of chunks, and the mean keys of a chunk."""
    b = buckets.agg(F.count_distinct("bucket").alias("buckets"))
    c = chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.avg("n_keys"), F.lit(0.0)).alias("mean_features"))
    return reduction(snapped).crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each
