"""Trials of a study: settings by sampling interval, draws from a search space, costs, ledgers of runs, paired windows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Substrings of messages of failures that are worth another try.
TRANSIENT = (
    "rate limit", "quota", "too many requests", "429", "500", "502", "503", "504", "deadline exceeded", "timeout", "timed out", "backend error", "internal error", "unavailable", "connection reset",
    "temporarily", "try again",
)
# States of remote tasks and the ledger's words for them.
STATES = {"READY": "submitted", "RUNNING": "running", "COMPLETED": "complete", "FAILED": "failed", "CANCELLED": "failed", "CANCEL_REQUESTED": "running"}


def unit_draw(*parts) -> Column:
    """A number in [0, 1) from a digest of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("double") / float(1 << 48)


def window_overrides(scaled: DataFrame, least_dt: float = 0.25, cap: float = 25.0) -> DataFrame:
    """window_scaling() rows with stride, eval_stride and max_speed_mps (null unless fixes come faster than least_dt)."""
    stride = F.greatest(F.lit(1), F.least(F.col("input_len"), F.rint(least_dt / F.greatest(F.col("dt_h"), F.lit(1e-9))).cast("long")))
    return scaled.withColumn("stride", stride).withColumn("eval_stride", F.col("horizon")).withColumn("max_speed_mps", F.when(F.col("stride") > 1, F.lit(cap)))


def forcing_ratio(epoch: Column, mode: Column, most: Column | float, total: Column | int) -> Column:
    """Share of true inputs at an epoch: constant, linear to 0 at `total`, or a sigmoid that is at half there; within 0 and 1."""
    most, total = (F.lit(v) if not isinstance(v, Column) else v for v in (most, total))
    linear = most * (1 - F.least(F.lit(1.0), epoch / total))
    sigmoid = most / (1 + F.exp((epoch - total).cast("double")))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(mode == "constant", most.cast("double")).when(mode == "linear", linear).otherwise(sigmoid)))


def log_uniform(u: Column, lo: float, hi: float) -> Column:
    """A draw whose logarithm is uniform between those of lo and hi."""
    return F.pow(F.lit(10.0), math.log10(lo) + u * (math.log10(hi) - math.log10(lo)))


def choice(u: Column, options: list) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.floor(u * len(options)) + 1).cast("int"))


def costs(trials: DataFrame, known: DataFrame, by: list[str], default_wall: float = 200.0, windowed: str = "tcn") -> DataFrame:
    """wall_s and vram_mb of trials, in proportion to parameters; the memory of arm `windowed` also to the window.

    known: by, ref_wall, ref_params, ref_vram, ref_len, few rows; without a row 200 s, no memory. Trials
    without a parameter count have the reference's.
    """
    x = trials.join(known, by, "left")
    ref = F.coalesce("ref_params", F.lit(1))
    scale = F.coalesce(F.col("params"), ref) / ref
    window = F.when(F.col("arm") == windowed, F.col("input_len") / F.coalesce("ref_len", F.lit(24))).otherwise(1.0)
    x = x.withColumn("wall_s", F.coalesce("ref_wall", F.lit(default_wall)) * scale).withColumn("vram_mb", F.coalesce("ref_vram", F.lit(0.0)) * scale * window)
    return x.drop("ref_wall", "ref_params", "ref_vram", "ref_len")


def is_transient(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in TRANSIENT])


def task_status(state: Column) -> Column:
    """The ledger's word for a remote state; null for an unknown one."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv)), state)


def unit_key(label: Column) -> Column:
    """Sorts labels by what stands before their trailing digits, and by all their digits as a number."""
    return F.struct(F.regexp_replace(label, r"[0-9]+$", "").alias("prefix"), F.coalesce(F.regexp_replace(label, r"[^0-9]", "").try_cast("long"), F.lit(0)).alias("number"))


def config_hash(columns: list[str]) -> Column:
    """SHA-256 of the canonical JSON of columns: keys sorted, no spaces."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def open_trials(planned: DataFrame, done: DataFrame, settings: list[str]) -> DataFrame:
    """Planned trials with their config_hash, without those that a complete row has."""
    key = planned.withColumn("config_hash", config_hash(settings))
    return key.join(done.where("status = 'complete'").select("config_hash"), "config_hash", "left_anti")


def merged(logs: list[DataFrame], key: str, ordinal: str) -> DataFrame:
    """The last row of each trial over several logs, later logs and larger ordinals last."""
    every = reduce(DataFrame.unionByName, [x.withColumn("__log", F.lit(k)) for k, x in enumerate(logs)])
    w = Window.partitionBy(key).orderBy(F.desc("__log"), F.desc(ordinal))
    return every.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__log")


def updated(trials: DataFrame, results: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """trials with the results recorded; a failed trial whose artefacts prove that it ended (`ended`) becomes complete."""
    r = results.select(key, "ended", *(F.col(c).alias(f"__{c}") for c in columns))
    x = trials.join(r, key, "left")
    status = F.when((F.col("status") == "failed") & F.coalesce("ended", F.lit(False)), "complete").otherwise(F.col("status"))
    return x.withColumns({"status": status, **{c: F.coalesce(f"__{c}", c) for c in columns}}).drop("ended", *(f"__{c}" for c in columns))


def filled(rows: DataFrame, unit: str, ordinal: str, columns: list[str]) -> DataFrame:
    """Each column as the unit's first value that isn't null."""
    w = Window.partitionBy(unit).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumns({c: F.first(c, ignorenulls=True).over(w) for c in columns})


def latest_runs(rows: DataFrame, by: list[str], run: str) -> DataFrame:
    """Rows of each group's last run."""
    last = rows.groupBy(*by).agg(F.max(run).alias(run))
    return rows.join(last, [*by, run], "left_semi")


def pair_windows(rows: DataFrame, fold: str, arm: str, key: list[str], ordinal: str, arms: list[str], values: list[str]) -> DataFrame:
    """Windows with a column <arm>_<value> for each arm, of folds that have every arm; windows that an arm lacks go.

    Windows pair by their key and, where keys repeat, by their place in the order of `ordinal`.
    """
    whole = rows.where(F.col(arm).isin(arms)).groupBy(fold).agg(F.count_distinct(arm).alias("n")).where(F.col("n") == len(arms)).select(fold)
    x = rows.join(whole, fold, "left_semi").withColumn("place", F.row_number().over(Window.partitionBy(fold, arm, *key).orderBy(ordinal)))
    one = [F.max(F.when(F.col(arm) == a, F.col(v))).alias(f"{a}_{v}") for a in arms for v in values]
    has = [F.count_if(F.col(arm) == a).alias(f"__{a}") for a in arms]
    x = x.groupBy(fold, *key, "place").agg(*one, *has)
    return x.where(reduce(lambda p, q: p & q, [F.col(f"__{a}") > 0 for a in arms])).drop(*(f"__{a}" for a in arms))


def metrics_report(errors: DataFrame, horizon: int) -> DataFrame:
    """One row over all windows and steps of (x, y): ade, fde, rmse and mae over both axes, and the number of windows."""
    d, sq, ab = F.hypot("x", "y"), (F.col("x") * F.col("x") + F.col("y") * F.col("y")) / 2, (F.abs("x") + F.abs("y")) / 2
    last = F.col("step") == horizon
    return errors.agg(F.avg(d).alias("ade"), F.avg(F.when(last, d)).alias("fde"), F.sqrt(F.avg(sq)).alias("rmse"), F.avg(ab).alias("mae"), F.count_if(last).alias("n_windows"))


def horizon_table(errors: DataFrame) -> DataFrame:
    """The same by step."""
    sq, ab = (F.col("x") * F.col("x") + F.col("y") * F.col("y")) / 2, (F.abs("x") + F.abs("y")) / 2
    return errors.groupBy("step").agg(F.avg(F.hypot("x", "y")).alias("ade"), F.sqrt(F.avg(sq)).alias("rmse"), F.avg(ab).alias("mae"))


def weighted_means(batches: DataFrame, weight: str, columns: list[str]) -> DataFrame:
    """One row: means of batch metrics weighted by batch size; null metrics don't count."""
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col(weight)), F.sum(F.when(F.col(c).isNotNull(), F.col(weight)))).alias(c)
    return batches.agg(*(mean(c) for c in columns), F.sum(weight).alias("n"))
