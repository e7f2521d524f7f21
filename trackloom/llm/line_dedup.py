"""Line dedup: a suffix array over line ids by distributed prefix doubling, and its common-prefix intervals (DataFrame operations only).

1. A line's id is its 128-bit digest. Round one ranks the places of lines by id; each further round
   ranks runs twice as long by the ranks of their halves. A rank is the number of places with a
   smaller run, so places in order of rank are the suffix array as far as it has been refined, and
   the places with one rank, [rank, rank + places), are an interval of it with a common prefix of
   that many lines. Places alone in theirs are in order and go no further; doubling ends when all are.
2. In each interval the first place (by doc_id, row and line) is the source, all others are later
   copies. A place's longest interval with an earlier place says how far it is a copy, up to the
   doubling; the copies of a document that touch or overlap make its maximal repeated runs.
3. The lines of those runs are deleted.

Ranks come from the distinct runs, range-partitioned, with the sums of partitions before; hot runs
are one row there, and places get their rank by a join that Spark can split.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.llm.common import checked, discard, materialize, numbered

#: A repeated run is deleted from so many lines on, or so many bytes (without newlines): a long paragraph, too, is a passage.
MIN_RUN, MIN_BYTES = 3, 300


def ranked(places: DataFrame, *key: str) -> DataFrame:
    """places whose key occurs more than once, with rank (places with a smaller key) and source (the first place with the key)."""
    groups = places.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "pos")).alias("source")).where("n > 1")
    groups = materialize(groups.repartitionByRange(*key).withColumn("part", F.spark_partition_id()), "runs")
    sums = {r["part"]: r["n"] for r in groups.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row for each partition
    before = [0, *accumulate(sums.get(k, 0) for k in range(max(sums, default=0) + 1))]
    inside = F.sum("n").over(Window.partitionBy("part").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    rank = inside + F.element_at(F.array(*[F.lit(b) for b in before]).cast("array<bigint>"), F.col("part") + 1)
    # Written, so that both sides of the join are plain exchanges and Spark can split a hot key.
    table = materialize(groups.select(*key, rank.alias("rank"), "source"), "ranks")
    discard(groups)
    return places.join(table, [*key])


def intervals(lines: DataFrame, min_run: int) -> list[DataFrame]:
    """Places in common-prefix intervals: row, doc_id, pos, bytes, rank, source and size, the lines that the interval shares.

    lines: row, doc_id, pos, id, bytes. A table for each round: sizes double, by way of min_run.
    """
    columns = ["row", "doc_id", "pos", "bytes", "rank", "source", "size"]
    now, size, out = materialize(ranked(lines, "id").withColumn("size", F.lit(1)).select(*columns), "intervals"), 1, []
    while not now.isEmpty():
        out.append(now)
        step = min(size, min_run - size) if size < min_run else size  # halves overlap on the way to min_run
        at = Window.partitionBy("row").orderBy("pos").rangeBetween(step, step)
        last = Window.partitionBy("row").orderBy("pos").rangeBetween(step + size - 1, step + size - 1)  # the added lines end there
        pairs = now.withColumn("next", F.first("rank").over(at))
        if size == 1 and min_run > 1:  # bytes of runs of two lines
            pairs = pairs.withColumn("bytes", F.col("bytes") + F.first("bytes").over(last))
        pairs = pairs.where("next is not null").select("row", "doc_id", "pos", "bytes", F.col("rank").alias("head"), "next")
        size += step
        now = materialize(ranked(pairs, "head", "next").withColumn("size", F.lit(size)).select(*columns), "intervals")
    return out


def copies(levels: list[DataFrame], min_run: int, min_bytes: int | None) -> DataFrame:
    """row, pos, size, source: places that an earlier place shares min_run lines or min_bytes bytes with; size: the longest interval's."""
    later = ~F.struct("doc_id", "row", "pos").eqNullSafe(F.col("source"))
    enough = F.col("size") >= min_run
    if min_bytes is not None:
        enough = enough | (F.col("bytes") >= min_bytes)
    every = reduce(DataFrame.unionByName, [x.where(later & enough).select("row", "pos", "size", "source") for x in levels])
    return every.groupBy("row", "pos").agg(F.max(F.struct("size", "source")).alias("x")).select("row", "pos", "x.size", "x.source")


def repeated_runs(lines: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """Maximal later copies: row, first_pos, n_lines, source_row, source_pos. lines: row, doc_id, pos, id, bytes."""
    found = [x for x in intervals(lines, min_run) if x.first()["size"] == min_run]
    if not found:
        return lines.sparkSession.createDataFrame([], "row long, first_pos int, n_lines long, source_row long, source_pos int")
    chain = copies(found, min_run, None).withColumn("d", F.col("pos") - F.col("source.pos")).withColumn("src", F.col("source.row"))
    order = Window.partitionBy("row", "src", "d").orderBy("pos")
    island = chain.withColumn("i", F.col("pos") - F.row_number().over(order))
    return island.groupBy("row", "src", "d", "i").agg(F.min("pos").alias("first_pos"), (F.count("*") + min_run - 1).alias("n_lines")).select("row", "first_pos", "n_lines", F.col("src").alias("source_row"), (F.col("first_pos") - F.col("d")).alias("source_pos"))


def spans(found: DataFrame) -> DataFrame:
    """row, spans (a, b): the union of [pos, pos + size) of each row, as maximal runs."""
    order = Window.partitionBy("row").orderBy("pos")
    end = F.max(F.col("pos") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = found.withColumn("new", (end.isNull() | (F.col("pos") > end)).cast("int")).withColumn("i", F.sum("new").over(order))
    runs = island.groupBy("row", "i").agg(F.min("pos").alias("a"), F.max(F.col("pos") + F.col("size")).alias("b"))
    return runs.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def line_dedup(docs: DataFrame, min_run: int = MIN_RUN, min_bytes: int | None = MIN_BYTES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_lines, n_removed, kept.

    Lines are what newlines separate; an empty or null text has one empty line. Each line in a run of
    min_run lines or more, or of one or two lines with min_bytes bytes, that occurs at an earlier
    place (smaller doc_id, null first, then row as read, then line) is deleted; kept is the rest,
    joined by newlines. doc_id may be null or repeat; extra columns are ignored; an empty table
    gives no rows. Texts don't move, unless over BROADCAST_ROWS rows or runs are to be cut.
    """
    rows = numbered(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    parts = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    lines = rows.select("row", "doc_id", F.posexplode(parts).alias("pos", "line"))
    lines = materialize(lines.select("row", "doc_id", "pos", F.unhex(F.md5("line")).alias("id"), F.octet_length("line").alias("bytes")), "lines")
    levels = intervals(lines, min_run)
    discard(lines)
    full = rows.withColumn("lines", parts)
    if levels:
        gone = materialize(spans(copies(levels, min_run, min_bytes)), "spans")
        discard(*levels)
        held = gone.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
        full = full.join(checked(gone) if held <= 2 * gone.count() + 1_000_000 else gone.hint("merge"), "row", "left")
    else:
        full = full.withColumn("spans", F.expr("cast(null as array<struct<a:int,b:int>>)"))
    cut = F.col("spans").isNotNull()
    left = F.when(cut, F.expr("filter(lines, (x, i) -> not exists(spans, s -> s.a <= i and i < s.b))")).otherwise(F.col("lines"))
    removed = F.when(cut, F.expr("aggregate(spans, 0L, (n, s) -> n + s.b - s.a)")).otherwise(F.lit(0))
    return full.select("doc_id", F.size("lines").cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), F.when(cut, F.array_join(left, "\n")).otherwise(F.coalesce("text", F.lit(""))).alias("kept"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS pos FROM s),
w AS (SELECT *, lead(line, 1) OVER d AS b, lead(line, 2) OVER d AS c FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
f AS (
  SELECT doc_id, pos, 1 AS size, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS k FROM w WHERE strlen(line) >= 300
  UNION ALL
  SELECT doc_id, pos, 2, row_number() OVER (PARTITION BY line, b ORDER BY doc_id, pos) FROM w WHERE b IS NOT NULL AND strlen(line) + strlen(b) >= 300
  UNION ALL
  SELECT doc_id, pos, 3, row_number() OVER (PARTITION BY line, b, c ORDER BY doc_id, pos) FROM w WHERE c IS NOT NULL
),
g AS (SELECT DISTINCT doc_id, pos + i AS pos FROM f, (SELECT unnest(range(3)) AS i) WHERE k > 1 AND i < size),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS kept FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos WHERE g.pos IS NULL GROUP BY l.doc_id)
SELECT s.doc_id, CAST(len(s.a) AS BIGINT) AS n_lines, (SELECT count(*) FROM g WHERE g.doc_id = s.doc_id) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM s LEFT JOIN k ON s.doc_id = k.doc_id
"""
