"""What the corpus operators share: scratch tables in the shared folder and byte-level text kernels."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy kernels hold at a time (a longer document is held alone).
CHUNK_BYTES = 1 << 18
#: Rows and bytes that go to a Python worker at a time (a longer text goes alone).
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Rows of a few numbers that a broadcast may hold.
BROADCAST_ROWS = 2_000_000


# ---- shared folder ---------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a local master gets a temporary folder; a cluster raises, as its executors share none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jsc.isDefined():
            return jsc.get()
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="trackloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def settle(spark: SparkSession) -> None:
    """Session settings of the corpus operators, which stay on.

    Batches of BATCH_ROWS and BATCH_BYTES bound what the JVM and its Python workers hold. Shuffle files go when the
    query that made them ends: nothing goes back to them, as tables in the shared folder cut the
    lineage (a query that does makes them anew).
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df written to the shared folder as Parquet and read again: cuts lineage and outlives executors."""
    spark = df.sparkSession
    settle(spark)
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote and nothing will read again."""
    for t in tables:
        path = getattr(t, "_scratch_path", None)
        if path:
            delete(t.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def numbered(docs: DataFrame, name: str = "rows", row: str = "row") -> DataFrame:
    """docs with a first column that tells its rows apart, written so that all later reads see the same numbers."""
    return materialize(docs.select(F.monotonically_increasing_id().alias(row), "*"), name)


def checked(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The hint for the smaller side of a join: broadcast if it has `rows` rows at most, which is counted; else sort-merge."""
    return F.broadcast(small) if small.count() <= rows else small.hint("merge")


# ---- what Python workers keep ----------------------------------------------

_KEPT: list = []


def kept(make: Callable) -> Callable:
    """A cache of the last two results of `make`, kept for a worker's next tasks until release()."""
    out = lru_cache(maxsize=2)(make)
    _KEPT.append(out)
    return out


def release() -> None:
    """Forgets what kept() holds in this process and gives the memory back to the system.

    Spark hands a Python worker from one stage to the next, so tasks that don't use the tokenizer's
    tables begin with this.
    """
    if any(f.cache_info().currsize for f in _KEPT):
        for f in _KEPT:
            f.cache_clear()
        gc.collect()  # tables and their memos refer to each other
        with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
            ctypes.CDLL(None).malloc_trim(0)


# ---- text as bytes ---------------------------------------------------------

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: An odd multiplier and its inverse modulo 2**64, for prefix hashes.
_R = 0x9E3779B97F4A7C15
_RI = pow(_R, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse."""
    if len(_powers[0]) < n:
        m = 1 << (n - 1).bit_length()
        for k, r in enumerate((_R, _RI)):
            x = np.full(m, r, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a string or binary column: (first, last, bytes, offsets); null is empty."""
    column = pa.array(column) if not isinstance(column, pa.Array) else column
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words_of(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of all words [^\\x20\\x09-\\x0D]+; words end with their document."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    on = ~_WS[raw]
    st, en = on.copy(), on.copy()
    st[1:] &= ~on[:-1]
    en[:-1] &= ~on[1:]
    full = offs[:-1] < offs[1:]
    a, b = offs[:-1][full], offs[1:][full] - 1
    st[a], en[b] = on[a], on[b]
    starts, ends = np.flatnonzero(st), np.flatnonzero(en) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans, which ascend and don't overlap; a piece of the bytes is worked on at a time."""
    out, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK_BYTES, "right")))
        piece, first, last = raw[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a]
        p, q = powers(len(piece) + 1)
        acc = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(((_LOWER[piece] if lower else piece).astype(np.uint64) + np.uint64(1)) * p[:-1], out=acc[1:])
        out[a:b] = mix((acc[last] - acc[first]) * q[first] + (last - first).astype(np.uint64))
        a = b
    return out


_SALTS = mix(np.arange(1, 9, dtype=np.uint64))


def shingles_of(hashes: np.ndarray, docs: np.ndarray, n_docs: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending within it, and their offsets.

    A document with 1 to width-1 words has its whole sequence as one shingle; without words, none.
    """
    counts = np.bincount(docs, minlength=n_docs)
    ends = np.cumsum(counts)
    sh, sd = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(hashes) >= width:
        sh = np.zeros(len(hashes) - width + 1, np.uint64)
        for k in range(width):
            sh += hashes[k : len(hashes) - width + 1 + k] * (_SALTS[k] | np.uint64(1))
        keep = docs[: len(sh)] == docs[width - 1 :]
        sh, sd = mix(sh[keep]), docs[: len(sh)][keep]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.array([int(np.sum(hashes[ends[d] - counts[d] : ends[d]] * (_SALTS[: counts[d]] | np.uint64(1)), dtype=np.uint64)) for d in short], np.uint64)
        sh, sd = np.concatenate([sh, mix(extra + counts[short].astype(np.uint64) * _SALTS[7])]), np.concatenate([sd, short])
    order = np.lexsort((sh, sd))
    sh, sd = sh[order], sd[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (sd[1:] != sd[:-1])
    sh, sd = sh[new], sd[new]
    return sh, np.concatenate([[0], np.cumsum(np.bincount(sd, minlength=n_docs))])


def hash_lists(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    """A list<int64> array of the values between offsets."""
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values.view(np.int64)))
