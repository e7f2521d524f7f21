"""Structured Streaming forms of the track operators and of the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.pixels import last_wins
from trackloom.operators.trials import task_status


def session_segments(fixes: DataFrame, gap: str, late: str) -> DataFrame:
    """Gap sessions of a stream of fixes: animal, first, last, number; rows later than `late` are left out."""
    stream = fixes.withWatermark("timestamp", late)
    out = stream.groupBy("study_id", "individual_id", F.session_window("timestamp", gap)).agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count("*").alias("n_fixes"))
    return out.drop("session_window")


def dedup_stream(fixes: DataFrame, late: str) -> DataFrame:
    """One fix for each animal and time within the watermark."""
    return fixes.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["study_id", "individual_id", "timestamp"])


def moves(ledger: DataFrame, states: DataFrame, now) -> DataFrame:
    """Ledger rows that follow from the states of remote tasks: those in flight whose status has changed, with the old row's fields.

    `ledger` holds the last row of each chunk, `states` task_id, state and error_message; states without a word are left out.
    """
    old = ledger.where(F.col("status").isin("submitted", "running") & F.col("task_id").isNotNull())
    x = old.join(states.withColumnRenamed("task_id", "__task"), F.col("task_id") == F.col("__task")).withColumn("__new", task_status(F.col("state"))).where("__new <> status")
    over, failed = F.col("__new").isin("complete", "failed"), F.col("__new") == "failed"
    x = x.withColumn("finished_at", F.when(over, now)).withColumn("failure_reason", F.when(failed, F.substring(F.coalesce("error_message", "state"), 1, 200)))
    return x.withColumn("status", F.col("__new")).select(*ledger.columns, *(c for c in ("finished_at", "failure_reason") if c not in ledger.columns))


def follow_states(states: DataFrame, path: str, checkpoint: str):
    """A stream of task states that appends what moves() finds to the Parquet ledger at `path` (with finished_at, failure_reason and seq), batch by batch.

    seq is the batch's number plus one, so a batch that runs again adds rows that last-wins reading takes as one.
    """

    def step(batch: DataFrame, n: int) -> None:
        before = last_wins(batch.sparkSession.read.parquet(path).where(F.col("seq") <= n), "chunk_id", "seq")
        new = moves(before, last_wins(batch, "task_id", "at"), F.current_timestamp())
        new.withColumn("seq", F.lit(n + 1).cast("long")).select(*before.columns).write.mode("append").parquet(path)

    return states.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def backoff(k, first: float, most: float, factor: float):
    """Seconds to wait before poll k (from 0)."""
    return F.least(first * F.pow(F.lit(factor), k), F.lit(most))
