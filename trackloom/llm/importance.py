"""Quality by importance resampling: a target and a raw model of hashed n-grams, and Gumbel top-k.

Both models are bags of hashed words and word pairs in BUCKETS buckets. The raw one counts all
documents, the target one all documents labelled as good. A document's weight is the log ratio of
its likelihoods; adding Gumbel noise and keeping the k largest draws k documents without replacement
in proportion to the ratio.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import checked, materialize, mix, text_chunks, word_hashes, words_of

BUCKETS = 1 << 14


def gram_buckets(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and documents of all words and word pairs, lower-cased."""
    s, e, d = words_of(raw, offs)
    h = word_hashes(raw, s, e)
    pair = d[1:] == d[:-1]
    two = mix(h[:-1] * np.uint64(3) + h[1:])[pair] if len(h) else h
    return (np.concatenate([mix(h), two]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([d, d[1:][pair] if len(d) else d])


def bucket_counts(docs: DataFrame) -> DataFrame:
    """bucket, raw, target: counts over all documents (doc_id, text, good); a task sends a row for each bucket."""

    def run(batches):
        all_, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            flag = np.asarray(batch.column(2).fill_null(False))
            for i, j, raw, offs in text_chunks(batch.column(1)):
                b, d = gram_buckets(raw, offs)
                all_ += np.bincount(b, minlength=BUCKETS)
                good += np.bincount(b[flag[i:j][d]], minlength=BUCKETS)
        on = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(all_[on]), pa.array(good[on])], names=["bucket", "raw", "target"])

    return docs.select("doc_id", "text", "good").mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def kth_largest(keys: DataFrame, k: int) -> int:
    """The k-th largest of column `o` (long), by counting 16 bits at a time: 65,536 counts at most reach the driver."""
    prefix, left = None, k
    for shift in (48, 32, 16, 0):
        part = keys if prefix is None else keys.where(F.shiftright("o", shift + 16) == prefix)
        got = sorted(((r["b"], r["n"]) for r in part.groupBy(F.shiftright("o", shift).alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for b, n in got:
            if n >= left:
                prefix = b
                break
            left -= n
    return prefix


def among_largest(keys: DataFrame, k: int, *order: str) -> Column:
    """Is a row among the k largest by the long columns `order`, the later ones for ties? No rows are gathered."""
    if k <= 0 or not order:
        return F.lit(k > 0)
    first = F.col(order[0])
    edge = kth_largest(keys.select(first.alias("o")), k)
    above, at = keys.where(first >= edge).agg(F.count_if(first > edge), F.count_if(first == edge)).first()
    if above + at == k:
        return first >= edge
    return (first > edge) | ((first == edge) & among_largest(keys.where(first == edge), k - above, *order[1:]))


def resample(docs: DataFrame, good: DataFrame, share: float | None = None, seed: int = 1) -> DataFrame:
    """One row per input row: doc_id, log_weight, noisy (weight and noise), kept.

    docs: doc_id, text. good: doc_id, good (boolean; rows that repeat a doc_id count as good if any
    is). share of rows are kept, by default the share of good rows among the labelled. Null and empty
    texts weigh 0. Noise comes from a hash of doc_id, of doc_id and text where doc_id is null, so
    reruns agree. Of equal keys those with the largest hash of doc_id and text are kept; rows equal in
    both are interchangeable. Texts don't move, unless there are over BROADCAST_ROWS good doc_ids.
    """
    spark = docs.sparkSession
    marks = materialize(good.where("good is not null and doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good")), "marks")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ids = marks.where("good").select("doc_id", F.lit(True).alias("good"))
    raw, target = np.full(BUCKETS, 1.0), np.full(BUCKETS, 1.0)
    for r in bucket_counts(rows.join(checked(ids), "doc_id", "left")).collect():  # BUCKETS rows at most
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    if share is None:
        share = marks.agg(F.avg(F.col("good").cast("double"))).first()[0]
        share = 1.0 if share is None else share

    def run(batches):
        for batch in batches:
            for i, j, raw_, offs in text_chunks(batch.column(1)):
                b, d = gram_buckets(raw_, offs)
                w = np.bincount(d, ratio[b], j - i) if len(d) else np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(w)], names=["doc_id", "tie", "log_weight"])

    weighed = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("tie")).mapInArrow(run, "doc_id long, tie long, log_weight double")
    unit = (F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", "tie"), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    weighed = weighed.withColumn("noisy", F.col("log_weight") - F.log(-F.log(unit))).withColumn("row", F.monotonically_increasing_id())
    # Longs in the order of the keys: millionths, beyond any noise that matters.
    weighed = materialize(weighed.withColumn("o", F.round(F.least(F.greatest(F.col("noisy"), F.lit(-8e12)), F.lit(8e12)) * 1_000_000).cast("long")), "weights")
    n = weighed.count()
    k = min(n, max(0, round(share * n)))
    return weighed.select("doc_id", "log_weight", "noisy", among_largest(weighed, k, "o", "tie", "row").alias("kept"))


def op1_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.select("doc_id", (F.col("quality") == 1).alias("good")))
