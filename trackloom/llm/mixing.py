"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Each source's documents are put in a hashed order and cut into blocks of about equal words.
2. The target of a source becomes an exact quota of block draws: whole passes over all of its blocks,
   and of one more pass as many blocks as fit.
3. A binary tree over the output shards splits the quotas of all sources at once, at each node by a
   multivariate hypergeometric draw for its left half; so shards get equal numbers of draws and, by
   chance only, different shares.
4. A source's blocks are permuted anew for each pass, and each shard draws its quota from there: the
   next blocks, which no other shard gets in that pass. What a target lacks to the next block is
   filled with documents that fit.
5. A shard is a partition, and shuffled on its own.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.llm.common import checked, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a source that one task orders at most, on average.
BUCKET_ROWS = 20_000
#: Words of a block, as long as that makes MAX_BLOCKS in all: blocks and their draws are planned at the driver.
BLOCK_WORDS, MAX_BLOCKS = 4096, 1 << 18
#: Words of an output shard, as long as that makes MAX_SHARDS.
SHARD_WORDS, MAX_SHARDS = 2_000_000, 1 << 14
#: A target that lacks over FILL_SHARE of itself is filled from FILL_ROWS documents of its next FILL_BLOCKS blocks.
FILL_SHARE, FILL_BLOCKS, FILL_ROWS = 0.001, 8, 256


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> dict[str | None, float]:
    """Target words of each source: sources by code point, null last, take the weights in turn.

    Together they get all words; a target above cap times its source's size stops there, and the
    excess is shared again by weight until none is above (or all are at their cap).
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    left = {s: (weights[k % len(weights)], n) for k, (s, n) in enumerate(order)}
    rest, out = float(sum(n for _, n in sizes)), {}
    while left:
        total = sum(w for w, _ in left.values())
        over = [s for s, (w, n) in left.items() if rest * w / total > cap * n]
        if not over:
            return out | {s: rest * w / total for s, (w, _) in left.items()}
        for s in over:
            out[s] = cap * left.pop(s)[1]
        rest = max(0.0, float(sum(n for _, n in sizes)) - sum(out.values()))
    return out


def split_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """(sources, shards) draws: each row sums to its quota, columns differ by at most one draw."""
    out = np.zeros((len(quotas), shards), np.int64)

    def deal(q: np.ndarray, a: int, b: int) -> None:
        if b - a == 1:
            out[:, a] = q
            return
        m = (a + b) // 2
        rng = np.random.default_rng([seed, a, b])
        base, extra = divmod(int(q.sum()), b - a)
        n = base * (m - a) + min(extra, m - a)
        left, rest, total = np.zeros_like(q), n, int(q.sum())
        for k in range(len(q)):  # one source after the other: hypergeometric in what is left
            total -= int(q[k])
            left[k] = _hypergeometric(rng, int(q[k]), total, rest)
            rest -= left[k]
        deal(left, a, m)
        deal(q - left, m, b)

    if len(quotas):
        deal(np.array(quotas, np.int64), 0, shards)
    return out


def _hypergeometric(rng, good: int, bad: int, n: int) -> int:
    if not n or not good:
        return 0
    if not bad:
        return n
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    p = good / (good + bad)  # beyond numpy's range the normal limit is exact to well under a draw in its spread
    sd = math.sqrt(n * p * (1 - p) * (good + bad - n) / max(1, good + bad - 1))
    return int(min(good, n, max(0, n - bad, round(rng.normal(n * p, sd)))))


def _key(source: str = "source"):
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def _hash(seed: int):
    return F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.col("source"), F.col("text"), F.lit(seed)), 1)


def block_draws(words: list[np.ndarray], goals: list[float], shards: int, seed: int) -> tuple[list[list[list[int]]], list[tuple[float, list[int]]]]:
    """The shards of each source's blocks, one for each draw, and what each target still lacks with the blocks next in turn.

    words: of each source its blocks' words. Passes are permutations of the blocks; a source's quota is
    its number of draws, and the splitting tree says how many of them each shard makes.
    """
    quotas, orders, lacks = [], [], []
    for k, (w, goal) in enumerate(zip(words, goals, strict=True)):
        total = int(w.sum())
        passes = min(int(goal // total), 1 << 20) if total else 0
        last = np.random.default_rng([seed, k, passes]).permutation(len(w))
        upto = np.cumsum(w[last])
        rest = goal - passes * total if total else 0.0
        some = int(np.searchsorted(upto, rest, "right")) if rest > 0 else 0
        quotas.append(passes * len(w) + some)
        orders.append(np.concatenate([*(np.random.default_rng([seed, k, e]).permutation(len(w)) for e in range(passes)), last[:some]]).astype(np.int64))
        lacks.append((float(rest - (upto[some - 1] if some else 0)), last[some : some + FILL_BLOCKS].tolist()))
    dealt, out = split_tree(quotas, shards, seed), []
    for w, order, row in zip(words, orders, dealt, strict=True):
        own: list[list[int]] = [[] for _ in range(len(w))]
        for block, shard in zip(order.tolist(), np.repeat(np.arange(shards), row).tolist(), strict=True):
            own[block].append(shard)
        out.append(own)
    return out, lacks


def fitting(sizes: list[int], room: float) -> list[int]:
    """Places of the sizes taken, the largest that still fit first."""
    out = []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        if 0 < sizes[k] <= room:
            out.append(k)
            room -= sizes[k]
    return out


def plan_draws(docs: DataFrame, shards: int | None = None, seed: int = 17, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """One row per input row: doc_id, key (its hashed place), source, block, size, source_size, target, draws, taken, shards.

    draws is how often the mix takes the document whole, at most `cap`; shards lists the shard of
    each draw. Null text has size 0, null source is a source of its own; a row of size 0 goes with
    its block, and a source without words isn't drawn. doc_id may be null or repeat; rows that are
    equal in doc_id, source and text are interchangeable; extra columns are ignored. An empty table
    gives no rows. Reruns agree. Texts don't move.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", _hash(seed).alias("key"), "source", _key().alias("src"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "sizes")
    per = [(r["source"], r["src"], r["size"], r["n"]) for r in rows.groupBy("source", "src").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()]  # a row for each source
    goal = targets([(s, size) for s, _, size, _ in per], weights, cap)
    per.sort(key=lambda x: (x[0] is None, x[0] or ""))
    total = sum(size for _, _, size, _ in per)
    cut = [max(1, min(-(-size // BLOCK_WORDS), MAX_BLOCKS * size // max(1, total))) for _, _, size, _ in per]
    table = spark.createDataFrame([(src, size, goal[s], n) for (s, src, size, _), n in zip(per, cut, strict=True)], "src string, source_size long, target double, blocks long")
    bits = max(4, math.ceil(math.log2(max(1, sum(n for *_, n in per) / BUCKET_ROWS))))
    rows = rows.withColumn("bucket", F.shiftright("key", 63 - bits))
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    before = sums.select("src", "bucket", (F.sum("words").over(Window.partitionBy("src").orderBy("bucket")) - F.col("words")).alias("before"))
    placed = rows.join(before, ["src", "bucket"]).join(checked(table), "src")
    inside = F.sum("size").over(Window.partitionBy("src", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    middle = F.col("before") + inside - F.col("size") / 2
    block = F.least(F.col("blocks") - 1, F.floor(middle * F.col("blocks") / F.greatest(F.col("source_size"), F.lit(1))))
    placed = placed.withColumn("block", F.greatest(block, F.lit(0)).cast("long")).select("row", "doc_id", "key", "source", "src", "size", "source_size", "target", "block")
    placed = materialize(placed, "blocks")

    index = {src: k for k, (_, src, _, _) in enumerate(per)}
    words = [np.zeros(n, np.int64) for n in cut]
    for r in placed.groupBy("src", "block").agg(F.sum("size").alias("words")).collect():  # MAX_BLOCKS and a row for each source, at most
        words[index[r["src"]]][r["block"]] = r["words"]
    if shards is None:
        shards = int(min(MAX_SHARDS, max(1, round(total / SHARD_WORDS))))
    drawn, lacks = block_draws(words, [goal[s] for s, *_ in per], shards, seed)
    draws = [(src, b, own) for (_, src, _, _), blocks in zip(per, drawn, strict=True) for b, own in enumerate(blocks) if own]
    draws = spark.createDataFrame(draws, "src string, block long, shards array<int>")
    # What targets lack: of the documents in the blocks next in turn, those that fit.
    open_ = [(src, b, room) for (s, src, _, _), (room, turn) in zip(per, lacks, strict=True) if room > FILL_SHARE * goal[s] for b in turn]
    open_ = spark.createDataFrame(open_, "src string, block long, room double")
    near = placed.join(checked(open_), ["src", "block"]).where("size > 0 and size <= room")
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("size"), "key", "row"))).where(F.col("place") <= FILL_ROWS)
    more: dict[str, list] = {}
    for r in near.orderBy("src", "place").select("src", "row", "key", "size", "room").collect():  # FILL_ROWS for each source
        more.setdefault(r["src"], []).append(r)
    extra = [(x[k]["row"], x[k]["key"] % shards) for x in more.values() for k in fitting([r["size"] for r in x], x[0]["room"])]
    extra = spark.createDataFrame(extra, "row long, extra int")
    full = placed.join(checked(draws), ["src", "block"], "left").join(checked(extra), "row", "left")
    none = F.expr("cast(array() as array<int>)")
    full = full.withColumn("shards", F.concat(F.coalesce("shards", none), F.when(F.col("extra").isNotNull(), F.array("extra")).otherwise(none)))
    return full.withColumn("draws", F.size("shards")).select("doc_id", "key", "source", "block", "size", "source_size", "target", "draws", (F.col("size") * F.col("draws")).alias("taken"), "shards")


def mix_documents(docs: DataFrame, shards: int | None = None, seed: int = 17) -> DataFrame:
    """The mix itself: the columns of docs, a row for each draw, a shard to a partition, shuffled within it.

    Nulls, repeats and empty tables as in plan_draws(). Texts move once, to their shards, unless over
    BROADCAST_ROWS documents are drawn.
    """
    plan = materialize(plan_draws(docs, shards, seed).where("draws > 0").select(F.col("doc_id").alias("__id"), F.col("key").alias("__at"), F.col("shards").alias("__shards")), "draws")
    rows = docs.withColumn("__key", _hash(seed))
    if not plan.groupBy("__id", "__at").count().where("count > 1").isEmpty():  # equal rows share their draws
        plan = materialize(plan.groupBy("__id", "__at").agg(F.flatten(F.collect_list("__shards")).alias("__shards")), "draws")
        rows = rows.dropDuplicates(["doc_id", "source", "text"])
    shards = shards or (plan.agg(F.max(F.array_max("__shards"))).first()[0] or 0) + 1
    out = rows.join(checked(plan), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__at")))
    out = out.select(*docs.columns, F.posexplode("__shards").alias("__e", "__shard"), "__key")
    order = F.xxhash64("__key", "__e", F.lit(seed + 1))
    return out.repartitionById(shards, F.col("__shard")).sortWithinPartitions(order).select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan_draws(docs).select("doc_id", "size", "source_size", "target", "taken", "draws")
