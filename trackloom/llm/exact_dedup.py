"""Exact dedup: a persistent digest index, bucketed and sorted by digest (DataFrame operations only)."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import checked, delete, materialize, scratch

#: A digest is hot if it holds over 1 / HOT_SHARE of the rows of a batch; so there are fewer than HOT_SHARE hot digests.
HOT_SHARE = 4096
#: Digests of the first batch for each bucket of a new index, and buckets at least and at most.
BUCKET_ROWS, BUCKETS = 500_000, (8, 8192)
#: Buckets of an index that doesn't say.
OLD_BUCKETS = 64
SCHEMA = "digest STRING, keep_id BIGINT, keep_row BIGINT, group_size BIGINT, batch STRING"


class DigestIndex:
    """Digests of all texts seen so far, in a Parquet table bucketed and sorted by digest.

    The table is external: open it again at the same path in any session. A join on the digest reads
    it without a shuffle, and without a sort as long as a bucket is one file: see compacted(). A batch
    adds a row for each of its digests: the holder where the digest is new (keep_row is set), else a
    count alone. Files of a batch show up when its write is committed as a whole, so a batch that
    fails leaves the index as it was, and can be given again.
    """

    def __init__(self, spark: SparkSession, path: str, rows: int = 0):
        """rows: digests expected in the first batch; an index that is there keeps its number of buckets."""
        self.spark, self.path = spark, path
        self.table = "digest_batches_" + hashlib.sha256(path.encode()).hexdigest()[:16]
        self.buckets = self._buckets(rows)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'")

    def _buckets(self, rows: int) -> int:
        spark, note = self.spark, self.path.rstrip("/") + ".buckets"
        there = lambda p: (at := spark._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        if there(note):
            return spark.read.schema("buckets INT").parquet(note).first()[0]
        n = OLD_BUCKETS if there(self.path) else min(max(-(-rows // BUCKET_ROWS), BUCKETS[0]), BUCKETS[1])
        spark.createDataFrame([(n,)], "buckets INT").coalesce(1).write.mode("overwrite").parquet(note)
        return n

    def frame(self) -> DataFrame:
        """The rows as they were added."""
        return self.spark.table(self.table)

    def digests(self) -> DataFrame:
        """digest, keep_id, keep_row, batch (of the holder) and group_size (rows of all batches), once for each digest."""
        holder = F.max(F.when(F.col("keep_row").isNotNull(), F.struct("keep_id", "keep_row", "batch"))).alias("h")
        return self.frame().groupBy("digest").agg(holder, F.sum("group_size").alias("group_size")).select("digest", "h.keep_id", "h.keep_row", "h.batch", "group_size")

    def append(self, digests: DataFrame) -> str:
        """Adds a batch: the digests that the index lacks, and counts of the others. Gives the name of the batch.

        digests: digest, doc_id, row (a number that tells the batch's rows apart). Of equal texts in
        the batch the largest doc_id stays.
        """
        batch = uuid.uuid4().hex
        best = F.max(F.struct(F.col("doc_id"), F.col("row"))).alias("best")
        groups = digests.groupBy("digest").agg(best, F.count("*").alias("group_size"))
        held = self.frame().where("keep_row is not null").select("digest").hint("merge")
        added = groups.join(held, "digest", "left_anti").select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")
        if not self.frame().isEmpty():
            none = F.lit(None).cast("long")
            added = added.unionByName(groups.join(held, "digest", "left_semi").select("digest", none.alias("keep_id"), none.alias("keep_row"), "group_size"))
        self._write(added.withColumn("batch", F.lit(batch)), self.table, self.path)
        return batch

    def _write(self, rows: DataFrame, table: str, path: str) -> None:
        rows = rows.repartition(self.buckets, "digest").sortWithinPartitions("digest")
        rows.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option("path", path).saveAsTable(table)

    def compacted(self, path: str) -> DigestIndex:
        """A copy at a new path with a row for each digest and a file for each bucket."""
        out = DigestIndex(self.spark, path, BUCKET_ROWS * self.buckets)
        out._write(self.digests().select("digest", "keep_id", "keep_row", "group_size", "batch"), out.table, path)
        return out

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        delete(self.spark, self.path)
        delete(self.spark, self.path.rstrip("/") + ".buckets")


def digests_of(docs: DataFrame) -> DataFrame:
    """doc_id, row, digest of every row: SHA-256 of the whole text in UTF-8, null as empty."""
    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("digest"))


def exact_dedup(docs: DataFrame, index_path: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical. Of equal texts the row with the largest doc_id stays; of rows
    with that doc_id, one. A null text equals an empty one; a null doc_id is the smallest.
    Rows equal to a text that the index held before are dropped, and keep_id names the holder;
    group_size counts the rows of this batch and of all before.
    Extra columns are ignored. An empty table gives no rows.
    """
    return _marked(docs, index_path or scratch(docs.sparkSession, "digest-index"))[0]


def _marked(docs: DataFrame, index_path: str) -> tuple[DataFrame, DigestIndex]:
    rows = materialize(digests_of(docs), "digests")
    n = rows.count()
    index = DigestIndex(docs.sparkSession, index_path, n)
    batch = index.append(rows)
    held = index.digests()
    # By the batch's own counts: fewer than HOT_SHARE digests can be hot, so their side of the joins may be broadcast.
    hot = materialize(rows.groupBy("digest").agg(F.count("*").alias("c")).where(F.col("c") > n // HOT_SHARE + 1).select("digest"), "hot")
    spread = rows.join(F.broadcast(held.join(F.broadcast(hot), "digest", "left_semi")), "digest")
    merged = rows.join(F.broadcast(hot), "digest", "left_anti").join(held.hint("merge"), "digest")
    # Row numbers start anew in each batch, and files of an older index name no batch.
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row")) & F.col("batch").eqNullSafe(F.lit(batch))
    return spread.unionByName(merged).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256")), index


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each text, the one exact_dedup() keeps; all columns stay, other than text_sha256 and __stays.

    Texts don't move, unless over BROADCAST_ROWS rows are dropped.
    """
    marks, index = _marked(docs, scratch(docs.sparkSession, "digest-index"))
    key = ["__id", "__digest"]
    marks = marks.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest"), "kept")
    # Rows that share both doc_id and text are interchangeable: one of them stays, or none.
    odd = materialize(marks.groupBy(*key).agg(F.max("kept").alias("__stays"), F.count("*").alias("n")).where("not __stays or n > 1").drop("n"), "dropped")
    index.drop()
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (digest == F.col("__digest"))
    out = docs.join(checked(odd), same, "left_anti")
    twice = odd.where("__stays")
    if not twice.isEmpty():
        out = out.unionByName(docs.join(checked(twice), same).dropDuplicates(key).select(*docs.columns))
    return out


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP7_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g USING (h)
"""
