"""Approximate nearest neighbours by an inverted multi-index.

The halves of all vectors are quantised apart, with K centroids each; a vector's cell is its pair of
centroids. A query goes through the pairs in order of summed squared distance, with a heap, until
their cells hold `reach` vectors, and all of these are ranked by their exact distance. reach is a
share of all vectors, measured on the sample that the centroids are fitted on: where TARGET of true
neighbours are met. In a sample neighbours are farther away than among all, so that is on the safe
side. Cells are gathered in blocks, as many as tasks or as hold BLOCK_ROWS vectors; a query goes to a
block once, with the list of its cells there.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.llm.common import materialize, mix

#: Vectors that the centroids are fitted on, at most: those with the smallest hashed vec_id.
SAMPLE = 20_000
#: Vectors that a query is compared with, at the least (all, if fewer), and the share of neighbours sought.
REACH, TARGET = 1_000, 0.95
#: Queries of the sample that reach is measured with.
PROBES = 100
#: Vectors of a cell on average, as long as there are at most 256 x 256 cells.
CELL_ROWS = 5
#: Vectors of a block of cells, at least and at most, and queries that one task compares with a block.
BLOCK_ROWS, QUERY_BLOCK = (1024, 32_768), 2048


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding: neither null nor zero, with finite components; of the commonest length."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding")).where(
        "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)"
    )
    width = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return v.where(F.size("embedding") == (width[0]["d"] if width else 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 9) -> np.ndarray:
    rng = np.random.default_rng(seed)
    uniq = np.unique(x, axis=0)
    c = uniq[rng.permutation(len(uniq))[:k]]
    for _ in range(rounds):
        near = nearest_centroid(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None, :]


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _squares(x, c).argmin(1)


def traverse(a: np.ndarray, b: np.ndarray, counts: np.ndarray, reach: int) -> list[int]:
    """Non-empty cells by summed distance of their halves until they hold `reach` vectors."""
    ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    k, heap, got, out = len(b), [(a[ia[0]] + b[ib[0]], 0, 0)], 0, []
    while heap and got < reach:
        _, i, j = heapq.heappop(heap)
        cell = int(ia[i]) * k + int(ib[j])
        if counts[cell]:
            out.append(cell)
            got += int(counts[cell])
        # Each pair is reached once: along the second half, and at its start along the first.
        if j + 1 < k:
            heapq.heappush(heap, (a[ia[i]] + b[ib[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[ia[i + 1]] + b[ib[0]], i + 1, 0))
    return out


def blocks(counts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: neighbouring cells share blocks of up to `rows` vectors, a larger cell has some of its own."""
    first, parts, block, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for c in np.flatnonzero(counts):
        n = int(counts[c])
        if held and held + n > rows:
            block, held = block + 1, 0
        first[c], parts[c], held = block, max(1, -(-n // rows)), held + n
        if n > rows:
            block, held = block + int(parts[c]), 0
    return first, parts


def measured_share(x: np.ndarray, ca: np.ndarray, cb: np.ndarray, k: int) -> float:
    """The share of all vectors of the sample that a query must go through to meet TARGET of its k nearest."""
    half = ca.shape[1]
    a, b = _squares(x[:, :half], ca), _squares(_second(x, half), cb)
    cell = a.argmin(1) * len(cb) + b.argmin(1)
    counts = np.bincount(cell, minlength=len(ca) * len(cb))
    met = []
    for q in range(min(PROBES, len(x))):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        order = np.argsort((a[q][:, None] + b[q][None, :]).ravel(), kind="stable")
        upto = np.empty(len(order))
        upto[order] = np.cumsum(counts[order])
        met.append(upto[cell[near]] / len(x))
    return float(np.quantile(np.concatenate(met), TARGET)) if met and len(x) > 1 else 1.0


def _second(x: np.ndarray, half: int) -> np.ndarray:
    return x[:, half:] if x.shape[1] > half else np.zeros((len(x), 1))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, reach: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score for rows with vec_id divisible by `every` against all others.

    Vectors null, zero, of another length than most, or with null or non-finite components, and
    rows with null vec_id, take no part. A query's own row, and rows that repeat its vec_id, aren't
    its neighbours. A repeated vec_id is one entry: the distance of two ids is the least between
    their vectors, and each id is found once.
    """
    spark = vectors.sparkSession
    v = materialize(usable(vectors).distinct(), "vectors")
    total = v.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = _matrix(v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()["embedding"])
    half = max(1, drawn.shape[1] // 2)
    m = int(np.clip(round((total / CELL_ROWS) ** 0.5), 4, 256))
    second = lambda x: _second(x, half)
    ca, cb = kmeans(drawn[:, :half], m), kmeans(second(drawn), m)
    if reach is None:
        reach = max(REACH, int(np.ceil(measured_share(drawn, ca, cb, k) * total)))
    width = len(cb)
    kind = dict(v.dtypes)["embedding"]

    def assign(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            cell = nearest_centroid(x[:, :half], ca).astype(np.int64) * width + nearest_centroid(second(x), cb) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["vec_id", "embedding", "cell"])

    placed = materialize(v.mapInArrow(assign, f"vec_id long, embedding {kind}, cell long"), "cells")
    counts = np.zeros(len(ca) * width, np.int64)
    for r in placed.groupBy("cell").count().collect():  # at most 65,536 cells
        counts[r["cell"]] = r["count"]
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    first, parts = blocks(counts, int(np.clip(-(-total // tasks), *BLOCK_ROWS)))

    def deal(batches):
        for batch in batches:
            cell, salt = np.asarray(batch.column(2)), mix(np.asarray(batch.column(0)).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(first[cell] + (salt % parts[cell].astype(np.uint64)).astype(np.int64)), *batch.columns], names=["block", "vec_id", "embedding", "cell"])

    def visits(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            a, b = _squares(x[:, :half], ca), _squares(second(x), cb)
            for i in range(len(x)):
                cells = np.array(traverse(a[i], b[i], counts, reach), np.int64)
                n = parts[cells]
                at = np.repeat(first[cells], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                own = np.repeat(cells, n)
                order = np.lexsort((own, at))
                at, own = at[order], own[order]
                edge = np.flatnonzero(np.diff(at, prepend=-1))
                lists = pa.ListArray.from_arrays(pa.array(np.append(edge, len(at)).astype(np.int32)), pa.array(own))
                same = pa.array(np.full(len(edge), i))
                yield pa.RecordBatch.from_arrays([pa.array(at[edge]), batch.column(0).take(same), batch.column(1).take(same), lists], names=["block", "query_id", "q", "cells"])

    asked = placed.where(F.col("vec_id") % every == 0).select("vec_id", "embedding").mapInArrow(visits, f"block long, query_id long, q {kind}, cells array<long>")
    asked = materialize(asked, "visits")
    load = asked.groupBy("block").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("shares"))
    entries = placed.mapInArrow(deal, f"block long, vec_id long, embedding {kind}, cell long")
    left = entries.join(load, "block").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    right = asked.join(load, "block").withColumn("share", F.pmod(F.xxhash64("query_id"), F.col("shares")).cast("int"))

    def rank(entries, queries):
        out = [[], [], []]
        if entries.num_rows and queries.num_rows:
            ids, x = np.asarray(entries["vec_id"]), _matrix(entries["embedding"])
            cells, cell = np.unique(np.asarray(entries["cell"]), return_inverse=True)
            for qid, q, own in zip(np.asarray(queries["query_id"]), _matrix(queries["q"]), queries["cells"], strict=True):
                at = np.searchsorted(cells, np.asarray(own.values))
                on = np.zeros(len(cells) + 1, bool)
                on[at[cells[np.minimum(at, len(cells) - 1)] == np.asarray(own.values)]] = True
                near = np.flatnonzero(on[cell] & (ids != qid))
                d = np.sqrt(((x[near] - q) ** 2).sum(1))
                i = ids[near]
                order = np.lexsort((i, d))
                order = order[np.sort(np.unique(i[order], return_index=True)[1])[:k]]  # a repeated vec_id at its nearest
                for o, c in zip(out, (np.full(len(order), qid), i[order], d[order]), strict=True):
                    o.append(c)
        cat = lambda c, t: pa.array(np.concatenate(c) if c else np.zeros(0), t)
        return pa.table({"query_id": cat(out[0], pa.int64()), "vec_id": cat(out[1], pa.int64()), "score": cat(out[2], pa.float64())})

    keys = ["block", "share"]
    near = left.select(*keys, "vec_id", "embedding", "cell").groupBy(*keys).cogroup(right.select(*keys, "query_id", "q", "cells").groupBy(*keys)).applyInArrow(rank, "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
