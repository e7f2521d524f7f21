"""N-gram Jaccard join: grouped prefix join over 5-word shingles, at a similarity of 0.8 or more.

1. Equal shingle sets are collapsed to one document.
2. A prefix filter in the order of shingle hashes: documents that are similar share at least L
   shingles in prefixes that are L - 1 longer than plain ones, so a document with fewer shingles of
   its prefix elsewhere has no partner. This leaves few documents.
3. The documents left are gathered into candidate classes, the components of "shares a shingle of
   the plain prefix"; pairs in different classes can't be similar. Each set moves once.
4. In a class, shingles are ordered anew by how many sets hold them. Documents with one prefix and
   one size form a group; an inverted index over the groups' prefixes gives group pairs, which size
   and position filters thin out; members of what is left are verified on whole sets. A pair that
   earlier links already join isn't verified again. Large classes, which passages of many documents
   hold together, are first gathered anew by prefixes in the order of how many sets hold a shingle.
   What is still large is cut into blocks by size, and pairs of blocks are joined on their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.llm.common import checked, discard, materialize, mix, numbered, release, shingles_of, text_chunks, word_hashes, words_of
from trackloom.llm.components import components

#: Linked if 100 * intersection >= PERCENT * union.
PERCENT, WIDTH = 80, 5
#: Shingles of a class that one task joins; a larger class is gathered anew, then cut into blocks of half of this.
BLOCK_SHINGLES = 1_000_000


def shingle_sets(docs: DataFrame, row: str = "row") -> DataFrame:
    """row, n, set_hash (two 64-bit halves) and the ascending shingle hashes of every whole text."""

    def run(batches):
        release()
        for batch in batches:
            ids = batch.column(0)
            for i, j, raw, offs in text_chunks(batch.column(1)):
                s, e, d = words_of(raw, offs)
                sh, so = shingles_of(word_hashes(raw, s, e), d, j - i, WIDTH)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *_sizes(sh, so), pa.ListArray.from_arrays(pa.array(so.astype(np.int32)), pa.array(sh.view(np.int64)))], names=[row, "n", "h1", "h2", "shingles"])

    return docs.select(row, "text").mapInArrow(run, f"{row} long, n long, h1 long, h2 long, shingles array<long>")


def _sizes(sh: np.ndarray, so: np.ndarray):
    """Sizes and two independent sums of mixed hashes, by document."""
    out = [pa.array(np.diff(so))]
    for salt in (1, 2):
        acc = np.zeros(len(sh) + 1, np.uint64)
        np.cumsum(mix(sh + np.uint64(salt * 0x5851F42D4C957F2D % 2**64)), out=acc[1:])
        out.append(pa.array((acc[so[1:]] - acc[so[:-1]]).view(np.int64)))
    return out


def need(n: int) -> int:
    """Least overlap that a set of n shares with any similar one."""
    return -(-PERCENT * n // 100)


def plain_prefix(n: int) -> int:
    return n - need(n) + 1


def extra(n: int) -> int:
    """Shingles that extended prefixes of similar sets must share, at the least."""
    return max(1, n // 10)


def prefix_postings(docs: DataFrame) -> DataFrame:
    """Extended prefixes by shingle: sizes of all documents (shingle null) and (row, shingle).

    In a batch, a shingle held by several sets is sent for one of them; the others count it as
    shared at once (`shared`), so no task gets more than one row for each batch and shingle.
    """

    def run(batches):
        release()
        for batch in batches:
            for i, j, raw, offs in text_chunks(batch.column(1)):
                s, e, d = words_of(raw, offs)
                sh, so = shingles_of(word_hashes(raw, s, e), d, j - i, WIDTH)
                n = np.diff(so)
                want = np.where(n > 0, np.minimum(n, n - -(-PERCENT * n // 100) + np.maximum(1, n // 10)), 0)
                doc = np.repeat(np.arange(j - i), n)
                keep = (np.arange(len(sh)) - so[doc]) < want[doc]
                sh_, doc = sh[keep], doc[keep]
                order = np.lexsort((doc, sh_))
                sh_, doc = sh_[order], doc[order]
                first = np.ones(len(sh_), bool)
                first[1:] = sh_[1:] != sh_[:-1]
                shared = np.bincount(doc[~first], minlength=j - i)
                ids = np.asarray(batch.column(0).slice(i, j - i))
                n_, h1, h2 = _sizes(sh, so)
                m, f = j - i, int(first.sum())
                none = lambda k, kind=pa.int64(): pa.nulls(k, kind)
                cat = lambda a, b: pa.concat_arrays([a, b])
                # A shingle's first holder in a batch with further ones is shared too.
                again = np.zeros(f, bool)
                if f:
                    starts = np.flatnonzero(first)
                    again = np.diff(np.append(starts, len(sh_))) > 1
                yield pa.RecordBatch.from_arrays([
                    cat(pa.array(ids), pa.array(ids[doc[first]])), cat(n_, none(f)), cat(h1, none(f)), cat(h2, none(f)),
                    cat(none(m), pa.array(sh_[first].view(np.int64))), cat(pa.array(shared), pa.array(again.astype(np.int64))),
                ], names=["row", "n", "h1", "h2", "shingle", "shared"])

    return docs.select("row", "text").mapInArrow(run, "row long, n long, h1 long, h2 long, shingle long, shared long")


# ---- the join in one task --------------------------------------------------


class Links:
    """Union-find over the sets of a task."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if (nxt == up).all():
                return up
            up = self.up = nxt

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def grouped_prefix_join(sets: list[np.ndarray], side: np.ndarray | None = None) -> np.ndarray:
    """For each set the smallest index that links lead to. With side, only pairs with a 0 and a 1 are sought."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    everything = np.concatenate(sets) if m else np.zeros(0, np.int64)
    words, inv, df = np.unique(everything, return_inverse=True, return_counts=True)
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(words))
    inv, at = rank[inv], np.concatenate([[0], np.cumsum(size)])
    once = np.sort(df, kind="stable") == 1
    ranked = [np.sort(inv[at[k] : at[k + 1]]) for k in range(m)]
    links = Links(m)
    # Groups: one prefix and one size.
    groups: dict[bytes, list[int]] = {}
    for k in order:
        p = plain_prefix(int(size[k]))
        groups.setdefault(ranked[k][:p].tobytes() + int(size[k]).to_bytes(8, "little"), []).append(int(k))
    index: dict[int, list[int]] = {}
    where: dict[int, list[int]] = {}
    heads = list(groups.values())
    head_size = np.array([size[g[0]] for g in heads]) if heads else np.zeros(0, int)
    for g, members in enumerate(heads):
        n = int(head_size[g])
        prefix = ranked[members[0]][: plain_prefix(n)]
        parts: list[list[int]] = []  # inside the group: the members so far, by what links join
        for a in members:
            apart, linked = [], []
            for part in parts:
                (linked if any(similar(ranked[a], ranked[b]) for b in part) else apart).append(part)
            if linked:
                linked[0].append(a)
                links.join(a, linked[0][0])
            for part in linked[1:]:
                linked[0].extend(part)
                links.join(a, part[0])
            parts = [*apart, linked[0] if linked else [a]]
        seen, hits, spots = [], [], []
        for pos, t in enumerate(prefix.tolist()):
            if once[t]:
                continue
            got = index.get(t)
            if got:
                hits.append(np.array(got))
                spots.append(np.array(where[t]))
                seen.append(np.full(len(got), pos))
        if hits:
            h, q, p = np.concatenate(hits), np.concatenate(spots), np.concatenate(seen)
            first = np.unique(h, return_index=True)[1]  # the first shared shingle of each group pair
            h, q, p = h[first], q[first], p[first]
            k = head_size[h]
            least = -(-PERCENT * (n + k) // (100 + PERCENT))
            ok = (100 * k >= PERCENT * n) & (1 + np.minimum(n - p, k - q) - 1 >= least)
            for x in h[ok].tolist():
                for a in members:
                    for b in heads[x]:
                        if side is not None and side[a] == side[b]:
                            continue
                        if links.find(a) != links.find(b) and similar(ranked[a], ranked[b]):
                            links.join(a, b)
        for pos, t in enumerate(prefix.tolist()):
            if not once[t]:
                index.setdefault(t, []).append(g)
                where.setdefault(t, []).append(pos)
    return links.roots()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _join_task(row_lists: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None = None):
    roots = grouped_prefix_join(sets, side)
    return row_lists, row_lists[roots]


# ---- distributed ------------------------------------------------------------


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """One row per input row: row (a number), doc_id, n_shingles, component_id, class (the number of one of its rows).

    docs: doc_id, text; extra columns are ignored. component_id is the smallest doc_id that links lead
    to, the document's own included. Texts null, empty or of white space only have no shingles and no
    links. Rows are documents, whether doc_id repeats or is null: rows with null doc_id take part, and
    a class of them alone has a null id. An empty table gives no rows.
    """
    rows = numbered(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    found = classes_of_rows(rows)
    discard(rows)  # the classes are written
    return found


def classes_of_rows(rows: DataFrame) -> DataFrame:
    """jaccard_classes() of rows that have their number in a written column `row`."""
    posts = materialize(prefix_postings(rows), "postings")
    sized = materialize(posts.where("n is not null").select("row", "n", "h1", "h2", "shared"), "sized")
    # 1. One row of each set goes on.
    same = materialize(sized.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("row").alias("rep"), F.count("*").alias("rows")), "sets")
    # 2. How many shingles of its extended prefix does each document share?
    held = posts.where("shingle is not null").select("shingle", "row", "shared")
    # Written, so that the shuffles of the count are gone before those of the join.
    twice = materialize(held.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1").select("shingle"), "twice")
    more = held.join(twice, "shingle", "left_semi").where("shared = 0").groupBy("row").agg(F.count("*").alias("more"))
    own = held.where("shared = 1").groupBy("row").agg(F.count("*").alias("own"))
    count = F.col("shared") + F.coalesce("more", F.lit(0)) + F.coalesce("own", F.lit(0))
    # A partner may be a quarter larger or a fifth smaller, and its bound that much lower.
    least = F.greatest(F.lit(1), F.floor(F.col("n") * PERCENT / 1000))
    passed = sized.where("n > 0").join(more, "row", "left").join(own, "row", "left").where(count >= least)
    left = materialize(passed.join(same, ["n", "h1", "h2"]).where("row = rep").select("row", "n"), "left")
    discard(posts, twice)
    # 3. Sets of the documents left, and their candidate classes.
    sets = materialize(shingle_sets(rows.join(checked(left.select("row")), "row", "left_semi")), "shingles")
    prefix = sets.select("row", F.explode(F.expr(f"slice(shingles, 1, cast(n - ceil(n * {PERCENT} / 100) + 1 as int))")).alias("shingle"))
    classes = _gathered(prefix)
    # 4. The join inside each class.
    links = _verified(sets, classes)
    found = components(links)
    # 5. Back to all rows.
    label = same.join(found.select(F.col("node").alias("rep"), "label"), "rep", "left").select("n", "h1", "h2", F.coalesce("label", "rep").alias("label"))
    known = sized.join(label, ["n", "h1", "h2"], "left").select("row", "n", F.coalesce("label", "row").alias("label"))
    ids = rows.select("row", "doc_id")
    full = materialize(ids.join(known, "row"), "labels")
    # Written, so that both sides of the join are plain exchanges and Spark can split a large class.
    best = materialize(full.groupBy("label").agg(F.min("doc_id").alias("component_id")), "best")
    return full.join(best, "label").select("row", "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("label").alias("class"))


def _gathered(prefix: DataFrame) -> DataFrame:
    """Components (node, label) of rows that share a shingle. prefix: row, shingle."""
    first = prefix.groupBy("shingle").agg(F.min("row").alias("a"), F.max("row").alias("top")).where("a < top").select("shingle", "a")
    edges = materialize(prefix.join(first, "shingle").where("row > a").select("a", F.col("row").alias("b")).distinct(), "edges")
    found = components(edges)
    discard(edges)
    return found


def _rare_prefixes(sets: DataFrame) -> DataFrame:
    """row, shingle: plain prefixes in the order of how many of the sets hold a shingle; those of one set only are left out."""
    every = sets.select("row", "n", F.explode("shingles").alias("shingle"))
    held = materialize(every.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "held")
    shared = materialize(every.join(held, "shingle"), "shared")
    discard(held)
    # A set's shingles that no other holds come first in its order, so they take the first places of its prefix.
    few = shared.groupBy("row").agg(F.count("*").alias("common"), F.first("n").alias("n")).select("row", F.expr(f"cast(n - ceil(n * {PERCENT} / 100) + 1 - (n - common) as long)").alias("places")).where("places > 0")
    place = F.row_number().over(Window.partitionBy("row").orderBy("df", "shingle"))
    out = materialize(shared.join(few, "row").withColumn("place", place).where("place <= places").select("row", "shingle"), "prefixes")
    discard(shared)
    return out


def _of_classes(sets: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets with their class, and the classes over BLOCK_SHINGLES."""
    inside = materialize(sets.join(checked(classes), sets["row"] == classes["node"]).select(F.col("label").alias("class"), "row", "n", "shingles"), "classes")
    big = inside.groupBy("class").agg(F.sum("n").alias("total")).where(F.col("total") > BLOCK_SHINGLES)
    return inside, materialize(big, "big")


def _verified(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) that join all similar sets of each class. Deletes the table of sets."""
    inside, big = _of_classes(sets, classes)
    discard(sets)
    small, large = inside.join(big.select("class"), "class", "left_anti"), None
    if not big.isEmpty():
        large = inside.join(big.select("class"), "class", "left_semi").select("row", "n", "shingles")
        prefixes = _rare_prefixes(large)
        again, big = _of_classes(large, _gathered(prefixes))
        discard(prefixes)
        small, large = small.unionByName(again.join(big.select("class"), "class", "left_anti")), again

    def whole(keys, table):
        release()
        rows = np.asarray(table["row"].combine_chunks())
        order = np.argsort(rows, kind="stable")
        values = table["shingles"].combine_chunks()
        sets_ = [np.asarray(values[int(k)].values) for k in order]
        a, b = _join_task(rows[order], sets_)
        keep = a != b
        return pa.table({"a": b[keep], "b": a[keep]})

    links = small.groupBy("class").applyInArrow(whole, "a long, b long")
    links = materialize(links, "links")
    if large is not None and not big.isEmpty():
        links = links.unionByName(materialize(_blocks(large.join(big, "class")), "links"))
    discard(inside, *([large] if large is not None else []))
    return links


def _blocks(inside: DataFrame) -> DataFrame:
    """Links in large classes: blocks by size, and each pair of blocks whose sizes allow a link, in a task of its own."""
    # Size slabs: powers of 0.8 apart, so similar sets are in one slab or in adjacent ones; slabs are cut into hashed blocks.
    slab = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(PERCENT / 100)))
    x = inside.withColumn("slab", slab.cast("long"))
    sums = x.groupBy("class", "slab").agg(F.sum("n").alias("words")).withColumn("parts", F.ceil(F.col("words") / (BLOCK_SHINGLES // 2)).cast("long"))
    x = x.join(sums.select("class", "slab", "parts"), ["class", "slab"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    after = sums.select("class", (F.col("slab") - 1).alias("slab"), F.col("parts").alias("next_parts"))
    x = x.join(after, ["class", "slab"], "left").withColumn("next_parts", F.coalesce("next_parts", F.lit(0)))
    before = sums.select("class", (F.col("slab") + 1).alias("slab"), F.col("parts").alias("last_parts"))
    x = x.join(before, ["class", "slab"], "left").withColumn("last_parts", F.coalesce("last_parts", F.lit(0)))
    # A task is (slab, part, slab', part'): the row goes to all tasks that hold its block.
    own = F.expr("transform(sequence(0, parts - 1), p -> struct(slab as s1, least(p, part) as p1, slab as s2, greatest(p, part) as p2))")
    up = F.expr("if(next_parts > 0, transform(sequence(0, next_parts - 1), p -> struct(slab as s1, part as p1, slab + 1 as s2, p as p2)), array())")
    down = F.expr("if(last_parts > 0, transform(sequence(0, last_parts - 1), p -> struct(slab - 1 as s1, p as p1, slab as s2, part as p2)), array())")
    tasks = x.select("class", "row", "shingles", "slab", "part", F.explode(F.concat(own, up, down)).alias("t")).select("class", "row", "shingles", "slab", "part", "t.*")

    def pair(keys, table):
        release()
        rows = np.asarray(table["row"].combine_chunks())
        order = np.argsort(rows, kind="stable")
        values = table["shingles"].combine_chunks()
        s1, p1, s2, p2 = (k.as_py() for k in keys[1:])
        second = (np.asarray(table["slab"].combine_chunks()) == s2) & (np.asarray(table["part"].combine_chunks()) == p2)
        side = None if (s1, p1) == (s2, p2) else second[order].astype(int)
        a, b = _join_task(rows[order], [np.asarray(values[int(k)].values) for k in order], side)
        keep = a != b
        return pa.table({"a": b[keep], "b": a[keep]})

    return tasks.groupBy("class", "s1", "p1", "s2", "p2").applyInArrow(pair, "a long, b long")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without documents whose class holds a smaller doc_id (or the same in an earlier row); null ids come last.

    Texts don't move, unless over BROADCAST_ROWS documents go.
    """
    rows = numbered(docs, row="__row")
    found = classes_of_rows(rows.select(F.col("__row").alias("row"), "doc_id", "text"))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))
    kept = materialize(found.groupBy("class").agg(first.alias("f"), F.count("*").alias("n")).where("n > 1").select("class", F.col("f.row").alias("kept")), "kept")
    gone = found.join(kept, "class").where("row <> kept").select(F.col("row").alias("__row"))
    return rows.join(checked(materialize(gone, "gone")), "__row", "left_anti").select(*docs.columns)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
