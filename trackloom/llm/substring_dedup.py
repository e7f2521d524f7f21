"""Suffix-array dedup: repeats of LENGTH bytes or more, by LCP intervals of an enhanced sparse suffix array.

1. Anchors. Of every LENGTH-byte window the leftmost least hash of its GRAM-byte strings is an
   anchor. The choice depends on the window's bytes only, so equal windows have equal anchors at
   equal places: to find all repeated windows it is enough to compare suffixes at anchors with the
   same gram.
2. Grams that occur at one anchor only are dropped; the other anchors get their context, the bytes
   that a window with the anchor can reach. Equal contexts of a gram are collapsed.
3. The contexts of a gram are sorted by their suffix from the anchor on, with longest common
   prefixes. A stack scan gives the tree of common-prefix intervals. In each interval the members
   are put in order of the text left of the anchor, read backwards, and a second scan gives those
   that share a left extent. Groups that are diverse on both sides are the maximal repeats; where
   left and right extent make up LENGTH, the bytes of all their members repeat.
   A gram with over GROUP contexts is first divided by what its windows contain; see _large().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import CHUNK_BYTES, discard, materialize, mix, numbered, powers, text_chunks

LENGTH, GRAM = 400, 64
LEFT = LENGTH - GRAM
#: Distinct contexts of a gram that one task puts in order.
GROUP = 4096
MOST_LISTED = 2000
#: Occurrences that a worker holds before it sends them.
CONTEXTS = 2000
_ORDER_BITS = np.uint64(31)


def gram_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all strings of `width` bytes."""
    p, q = powers(len(raw) + 1)
    acc = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[:-1], out=acc[1:])
    n = len(raw) - width + 1
    return mix((acc[width:] - acc[:-width]) * q[:n])


def anchors(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the anchors of all documents in a chunk."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(raw) < LENGTH:
        return none
    h = gram_hashes(raw, GRAM)
    w = LENGTH - GRAM + 1
    n = len(h)
    key = (h >> _ORDER_BITS << _ORDER_BITS) | np.arange(n, dtype=np.uint64)  # leftmost of the least
    m = -(-n // w) * w
    x = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    x[:n] = key
    x = x.reshape(-1, w)
    pre = np.minimum.accumulate(x, 1).ravel()
    suf = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(suf[: n - w + 1], pre[w - 1 : n])
    # Only windows inside one document count.
    size = np.diff(offs)
    ok = np.zeros(len(least) + 1, np.int64)
    a = offs[:-1][size >= LENGTH]
    np.add.at(ok, a, 1)
    np.add.at(ok, offs[1:][size >= LENGTH] - LENGTH + 1, -1)
    least = least[np.cumsum(ok)[:-1] > 0]
    if not len(least):
        return none
    change = np.ones(len(least), bool)
    change[1:] = least[1:] != least[:-1]
    at = np.unique((least[change] & np.uint64((1 << 31) - 1)).astype(np.int64))
    return at, h[at]


def anchors_of(raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """anchors() in pieces of CHUNK_BYTES, which overlap so that each window is whole in one; an anchor may come from two."""
    step = CHUNK_BYTES
    for a in range(0, max(1, len(raw) - LENGTH + 1), step):
        piece = raw[a : a + step + LENGTH - 1]
        at, h = anchors(piece, np.clip(offs - a, 0, len(piece)))
        yield at + a, h


def anchor_table(docs: DataFrame) -> DataFrame:
    """gram, row, pos of all anchors."""

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for i, j, raw, offs in text_chunks(batch.column(1)):
                last = -1
                for at, h in anchors_of(raw, offs):
                    new = at > last  # pieces overlap by less than a window
                    at, h = at[new], h[new]
                    last = at[-1] if len(at) else last
                    d = np.searchsorted(offs, at, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[i:j][d]), pa.array((at - offs[d]))], names=["gram", "row", "pos"])

    return docs.select("row", F.col("text").cast("binary")).mapInArrow(run, "gram long, row long, pos long")


def contexts(docs: DataFrame) -> DataFrame:
    """docs: row, text, grams, places. An occurrence a row: gram, c1, c2 (the context's hash), row, pos, and for the first of a batch left, right and n."""
    schema = "gram long, c1 long, c2 long, row long, pos long, n long, left binary, right binary"

    def run(batches):
        import hashlib

        def batch_of(out):
            kinds = [pa.int64()] * 6 + [pa.binary()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["gram", "c1", "c2", "row", "pos", "n", "left", "right"])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                out, first = [], {}
                for row, text, grams, places in zip(*(part.column(c) for c in range(4)), strict=True):
                    row, text = row.as_py(), text.as_py()
                    for g, p in zip(grams.as_py(), places.as_py(), strict=True):
                        if len(out) >= CONTEXTS:
                            yield batch_of(out)
                            out, first = [], {}
                        a, b = text[max(0, p - LEFT) : p], text[p : p + LENGTH]
                        if len(a) + len(b) < LENGTH:
                            continue
                        d = hashlib.blake2b(a, digest_size=16, person=len(a).to_bytes(4, "little"))
                        d.update(b)
                        d = d.digest()
                        key = (g, d)
                        r = [g, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), row, p, None, None, None]
                        if key in first:
                            first[key][5] += 1
                        else:
                            r[5:] = [1, a[::-1], b]
                            first[key] = r
                        out.append(r)
                if out:
                    yield batch_of(out)

    return docs.mapInArrow(run, schema)


# ---- the interval tree of one gram -----------------------------------------


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(lcp, first, last) of all common-prefix intervals, children before parents; lcp[k] is that of places k - 1 and k."""
    stack = [(0, 0)]
    for k in range(1, len(lcp) + 1):
        now = lcp[k] if k < len(lcp) else 0
        first = k - 1
        while stack[-1][0] > now:
            size, first = stack.pop()
            yield size, first, k - 1
        if stack[-1][0] < now:
            stack.append((now, first))


def repeat_groups_of(left: list[bytes], right: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats of `length` or more around one anchor: left extent, right extent, all members that share them.

    left: texts before the anchor, backwards; right: from the anchor on. For each interval of the right
    suffixes, a second stack scan over its members in left order gives those that share a left extent
    too. A group is left-diverse by its interval of that scan; it is right-diverse, and so maximal, if
    its members lie in several children of the right interval.
    """
    order = sorted(range(len(right)), key=right.__getitem__)
    lcp = [0] + [common(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    back = sorted(range(len(left)), key=left.__getitem__)
    place, rank = [0] * len(left), [0] * len(left)
    for k, i in enumerate(back):
        place[i] = k
    for k, i in enumerate(order):
        rank[i] = k
    for size, first, last in intervals(lcp):
        members = sorted(order[first : last + 1], key=place.__getitem__)
        ext = [0] + [common(left[a], left[b]) for a, b in zip(members, members[1:], strict=False)]
        if max(ext) + size < length:
            continue
        child = [0] * (last - first + 1)
        for k in range(1, last - first + 1):
            child[k] = child[k - 1] + (lcp[first + k] == size)
        found = list(intervals(ext))
        if min(ext[1:]) == 0:  # what all members share ends at the anchor
            found.append((0, 0, len(members) - 1))
        for e, a, b in found:
            if e + size >= length:
                in_child = [child[rank[i] - first] for i in members[a : b + 1]]
                if min(in_child) != max(in_child):
                    yield e, size, members[a : b + 1]


def extents(left: list[bytes], right: list[bytes], counts: list[int], length: int = LENGTH) -> list[tuple[int, int]]:
    """How far each context repeats to the left and right of its anchor; (0, 0): no `length` bytes repeat."""
    out = [(len(a), len(b)) if n > 1 else (0, 0) for a, b, n in zip(left, right, counts, strict=True)]
    for e, size, members in repeat_groups_of(left, right, length):
        for i in members:
            out[i] = (max(out[i][0], e), max(out[i][1], size))
    return out


def _settled(rows_of):
    """Rows sorted by gram -> rows_of(gram, keys, contexts) of each gram with repeats, as long columns."""

    def run(batches, names):
        gram, group, done = None, {}, []

        def batch():
            cols = list(zip(*done, strict=True)) if done else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        def flush():
            items = list(group.values())
            if len(items) > 1 or items and items[0][2] > 1:
                done.extend(rows_of(gram, list(group), items))

        for part in batches:
            for g, c1, c2, n, a, b in zip(*(part.column(c).to_pylist() for c in range(6)), strict=True):
                if g != gram:
                    flush()
                    gram, group = g, {}
                if (c1, c2) in group:
                    group[c1, c2][2] += n
                else:
                    group[c1, c2] = [a, b, n]
            if len(done) > 2000:
                yield batch()
                done.clear()
        flush()
        yield batch()

    return run


def _settle(batches):
    """Rows sorted by gram -> (gram, c1, c2, left extent, right extent) of contexts that repeat."""

    def rows_of(gram, keys, items):
        found = extents(*(list(x) for x in zip(*items, strict=True)))
        return [(gram, *key, a, b) for key, (a, b) in zip(keys, found, strict=True) if b]

    return _settled(rows_of)(batches, ["gram", "c1", "c2", "l", "r"])


def _grouped(batches):
    """Rows sorted by gram -> (gram, number, c1, c2, left extent, right extent): the contexts of each maximal repeat."""

    def rows_of(gram, keys, items):
        left, right, counts = (list(x) for x in zip(*items, strict=True))
        every = list(repeat_groups_of(left, right))
        # A context that stands in several places repeats as a whole.
        every += [(len(left[i]), len(right[i]), [i]) for i, n in enumerate(counts) if n > 1 and len(left[i]) + len(right[i]) >= LENGTH]
        return [(gram, k, *keys[i], e, size) for k, (e, size, members) in enumerate(every) for i in members]

    return _settled(rows_of)(batches, ["gram", "number", "c1", "c2", "l", "r"])


def _classes(width: int):
    """Contexts -> window classes: gram, a (windows with a .. a + width - 1 bytes left of the anchor), the hash
    of the bytes that all of them share (k1, k2) and of those that any has (r1, r2), c1, c2, n, extents l, r."""

    def run(batches):
        import hashlib

        two = lambda x: np.frombuffer(hashlib.blake2b(x, digest_size=16).digest(), np.int64).tolist()
        for batch in batches:
            out = []
            for g, c1, c2, n, a, b, first, last in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                text, at = a[::-1] + b, len(a)
                for s in range(first, min(last, at + 1), width):
                    share = text[at - s : at + LENGTH - s - width + 1]
                    if len(share) < LENGTH - width + 1:
                        continue
                    l, r = min(at, s + width - 1, last - 1), min(len(b), LENGTH - s)
                    # The reach of a context that ends early is its own.
                    out.append((g, s, *two(share), *two(text[at - l : at + r] + bytes((l % 256, r % 256))), c1, c2, n, l, r))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["gram", "a", "k1", "k2", "r1", "r2", "c1", "c2", "n", "l", "r"])

    return run


def _large(held: DataFrame) -> DataFrame:
    """Extents of repeating contexts of grams with many of them: windows are halved into finer classes.

    A class holds the contexts that share what all its windows have in common. Contexts equal in all
    the class's windows repeat there, and one of them goes on; classes of up to GROUP contexts are
    settled by the interval tree; larger ones are cut into finer classes, down to single windows.
    """
    keys = ["gram", "a", "k1", "k2"]
    found, todo = [], held.select("gram", "c1", "c2", "n", "left", "right", F.lit(0).alias("first"), F.lit(LEFT + 1).alias("last"))
    for width in (84, 21, 5, 1):
        rows = materialize(todo.mapInArrow(_classes(width), "gram long, a long, k1 long, k2 long, r1 long, r2 long, c1 long, c2 long, n long, l long, r long"), "window-classes")
        best = F.min_by(F.struct("c1", "c2"), F.struct("c1", "c2")).alias("one")
        same = materialize(rows.groupBy(*keys, "r1", "r2").agg(F.sum("n").alias("n"), best), "regions")
        sizes = same.groupBy(*keys).agg(F.sum("n").alias("all"), F.count("*").alias("m")).where("all > 1")
        again = same.where("n > 1").select(*keys, "r1", "r2")
        found.append(rows.where(F.col("l") + F.col("r") >= LENGTH).join(again, [*keys, "r1", "r2"], "left_semi").select("gram", "c1", "c2", "l", "r"))
        if width == 1:
            break
        open_ = materialize(same.select(*keys, F.col("n").alias("rn"), "one").join(sizes.where("m > 1").select(*keys, "m"), keys).select(*keys, "m", F.col("rn").alias("n"), "one.c1", "one.c2"), "open")
        if open_.isEmpty():
            break
        text = held.groupBy("gram", "c1", "c2").agg(F.min("left").alias("left"), F.min("right").alias("right"))
        full = materialize(open_.join(text, ["gram", "c1", "c2"]), "class-texts")
        name = F.xxhash64(*keys).alias("class")
        # A region that repeats is in `found` already; n > 1 would say that its context repeats as a whole.
        small = full.where(F.col("m") <= GROUP).select(name, "c1", "c2", F.lit(1).cast("long").alias("n"), "left", "right", "gram")
        done = small.repartition("class").sortWithinPartitions("class").mapInArrow(_settle, "class long, c1 long, c2 long, l long, r long")
        found.append(done.join(small.select("class", "c1", "c2", "gram"), ["class", "c1", "c2"]).select("gram", "c1", "c2", "l", "r"))
        todo = full.where(F.col("m") > GROUP).select("gram", "c1", "c2", "n", "left", "right", F.col("a").cast("int").alias("first"), F.least(F.lit(LEFT + 1), F.col("a") + width).cast("int").alias("last"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("gram", "c1", "c2").agg(F.max("l").alias("l"), F.max("r").alias("r"))


def _contexts_of(docs: DataFrame) -> DataFrame:
    """The written contexts of all anchors whose gram occurs at another one. docs: row, text."""
    at = materialize(anchor_table(docs), "anchors")
    # Written out, so that both sides of the join are plain exchanges and Spark can split a hot gram.
    twice = materialize(at.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram"), "grams")
    places = at.join(twice, "gram", "left_semi").groupBy("row").agg(F.collect_list(F.struct("pos", "gram")).alias("x"))
    # A row lists its own anchors: as many as its text is long.
    found = docs.join(places, "row").select("row", F.col("text").cast("binary").alias("text"), F.col("x.gram").alias("grams"), F.col("x.pos").alias("places"))
    ctx = materialize(contexts(found), "contexts", "zstd")
    discard(at, twice)
    return ctx


def repeat_groups(docs: DataFrame) -> DataFrame:
    """Maximal repeats of LENGTH bytes or more, with all occurrences: gram, number, length, row, start. docs: row, text.

    (gram, number) names a group; its occurrences hold the same bytes, and differ before and after
    them, as far as windows of LENGTH bytes around the anchor reach: a longer repeat is a chain of
    overlapping groups. A gram's contexts are put in order in one task.
    """
    ctx = _contexts_of(docs)
    held = ctx.where("n is not null").select("gram", "c1", "c2", "n", "left", "right")
    groups = held.repartition("gram").sortWithinPartitions("gram").mapInArrow(_grouped, "gram long, number long, c1 long, c2 long, l long, r long")
    return ctx.select("gram", "c1", "c2", "row", "pos").join(groups, ["gram", "c1", "c2"]).select("gram", "number", (F.col("l") + F.col("r")).alias("length"), "row", (F.col("pos") - F.col("l")).alias("start"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """row, starts, ends: byte ranges of documents (row, text) covered by repeats of LENGTH bytes; ranges may overlap."""
    ctx = _contexts_of(docs)
    held = ctx.where("n is not null").select("gram", "c1", "c2", "n", "left", "right")
    sizes = ctx.where("n is not null").groupBy("gram").agg(F.count("*").alias("m"))
    big = materialize(sizes.where(F.col("m") > GROUP).select("gram"), "big")
    hot = [r["gram"] for r in big.limit(MOST_LISTED + 1).collect()]
    if len(hot) > MOST_LISTED:  # too many to name in an expression
        small, large = held.join(big, "gram", "left_anti"), held.join(big, "gram", "left_semi")
    else:
        small, large = held.where(~F.col("gram").isin(hot)), held.where(F.col("gram").isin(hot))
    done = small.repartition("gram").sortWithinPartitions("gram").mapInArrow(_settle, "gram long, c1 long, c2 long, l long, r long")
    if hot:
        done = done.unionByName(_large(large))
    spans = ctx.select("gram", "c1", "c2", "row", "pos").join(done, ["gram", "c1", "c2"])
    out = materialize(spans.groupBy("row").agg(F.collect_set(F.struct((F.col("pos") - F.col("l")).alias("a"), (F.col("pos") + F.col("r")).alias("b"))).alias("spans")), "spans")
    discard(ctx)
    return out


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def substring_dedup(docs: DataFrame, texts: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, and with texts=True spans and kept (binary).

    Bytes covered by a LENGTH-byte string that starts anywhere else too, in the same document or
    another, are removed, all copies of them; matches never cross documents. Null is empty;
    documents shorter than LENGTH keep all. Rows are documents, whether doc_id repeats or is null;
    extra columns are ignored; an empty table gives no rows.
    """
    docs = numbered(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    spans = repeated_spans(docs.select("row", "text"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long" + ", spans array<struct<a:long,b:long>>, kept binary" * texts

    def run(batches):
        import hashlib

        for batch in batches:
            rows = []
            for doc_id, text, got in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                text, runs = text or b"", merged(got)
                kept, at = [], 0
                for a, b in runs:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                rows.append((doc_id, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), len(kept), *(([{"a": a, "b": b} for a, b in runs], kept) if texts else ())))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * (8 if texts else 6)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names=[f.split()[0] for f in schema.split(", ")])

    full = docs.select("row", "doc_id", F.col("text").cast("binary").alias("text")).join(spans, "row", "left")
    return full.select("doc_id", "text", "spans").mapInArrow(run, schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests, n_kept and text: what is left, as a string (a character that a cut leaves in part is U+FFFD; kept_sha256 is of the bytes)."""
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
