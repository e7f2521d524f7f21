"""Token ids as binary shards: fixed-width bit packing with block offsets.

Shard layout, little-endian: the header (see _HEADER), n_docs pairs (doc_id int64, end int64: ids up
to and with this document), n_blocks + 1 byte offsets (uint64, from the start of the payload), the
payload. A block holds BLOCK ids in `bits` bits each, lowest bit first; the last one may be shorter.
A block starts at a byte, so any range of ids can be read with the blocks that hold it.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import kept, materialize, scratch
from trackloom.llm.word_pieces import END, LOWER, MEMO_CHARS, Memo, for_words, latin, library, parts, spec, words_at

BLOCK = 1 << 15
#: Ids after which a shard is closed; a document is never split.
SHARD_IDS = 1 << 22
END_ID = 2
#: Words in each generation of the memo: about 100 MB in all.
MEMO = 500_000
#: Documents that are encoded together, and the bytes of them that are looked up together (and what is left of the last word).
DOCS, CHUNK = 256, 1 << 20
_WHITE = re.compile(rb"[\x09-\x0d \x85\xa0]")
_HEADER = struct.Struct("<8sIIQQQQ")  # magic, bits, block, n_docs, n_ids, n_blocks, ids before it in its partition
_MAGIC = b"TLTOKEN1"
NO_ID = np.iinfo(np.int64).min


# ---- packing ---------------------------------------------------------------


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    lanes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(lanes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, n: int, first: int = 0) -> np.ndarray:
    """n ids from the first-th on."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n, first * bits // 8).astype(np.uint32)
    padded = np.frombuffer(raw + b"\0" * 8, np.uint8)
    windows = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    at = np.arange(first, first + n, dtype=np.int64) * bits
    return ((windows[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class ShardWriter:
    """Writes the documents of one partition; a shard appears whole, under a name that a rerun gives again."""

    def __init__(self, root: str, partition: int, bits: int):
        self.fs, self.root = pafs.FileSystem.from_uri(root)
        self.partition, self.bits, self.seq, self.before = partition, bits, 0, 0
        self.docs: list[int] = []
        self.ends: list[int] = []
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, doc_id: int | None, ids: np.ndarray):
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.n += len(ids)
        self.ends.append(self.n)
        self.parts.append(ids)
        return self.close() if self.n >= SHARD_IDS else None

    def close(self):
        """(partition, seq, ids, docs, name) of the shard written, or None."""
        if not self.docs:
            return None
        ids = np.concatenate(self.parts)
        blocks = [pack(ids[k : k + BLOCK], self.bits) for k in range(0, len(ids), BLOCK)]
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
        table = np.stack([np.array(self.docs, "<i8"), np.array(self.ends, "<i8")], 1)
        name = f"ids-{self.partition:06d}-{self.seq:06d}.bin"
        from pyspark import TaskContext

        own = f"{self.root}/.{name}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
        with self.fs.open_output_stream(own) as f:
            f.write(_HEADER.pack(_MAGIC, self.bits, BLOCK, len(self.docs), len(ids), len(blocks), self.before))
            f.write(table.tobytes())
            f.write(offsets.tobytes())
            for b in blocks:
                f.write(b)
        self.fs.move(own, f"{self.root}/{name}")
        out = (self.partition, self.seq, len(ids), len(self.docs), name)
        self.before += len(ids)
        self.seq, self.n, self.docs, self.ends, self.parts = self.seq + 1, 0, [], [], []
        return out


class Shard:
    """Random access to a shard: the document table is read at once, ids block by block."""

    def __init__(self, root: str, name: str):
        fs, at = pafs.FileSystem.from_uri(root)
        self.file = fs.open_input_file(f"{at}/{name}")
        magic, self.bits, self.block, n_docs, self.n_ids, n_blocks, self.before = _HEADER.unpack(self.file.read_at(_HEADER.size, 0))
        if magic != _MAGIC:
            raise ValueError(f"{name} isn't a token shard")
        table = np.frombuffer(self.file.read_at(16 * n_docs, _HEADER.size), "<i8").reshape(-1, 2)
        self.doc_ids, self.ends = table[:, 0], table[:, 1]
        at = _HEADER.size + 16 * n_docs
        self.offsets = np.frombuffer(self.file.read_at(8 * (n_blocks + 1), at), "<u8").astype(np.int64)
        self.payload = at + 8 * (n_blocks + 1)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids [first, last) of the shard, from the blocks that hold them."""
        if first >= last:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (last - 1) // self.block
        raw = self.file.read_at(int(self.offsets[b + 1] - self.offsets[a]), int(self.payload + self.offsets[a]))
        # Full blocks end at a byte, so the ids of successive blocks are contiguous.
        return unpack(raw, self.bits, last - first, first - a * self.block)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


# ---- encoding --------------------------------------------------------------


class Encoder:
    """Whole texts to ids with the tokenizers library, each distinct word encoded once while the memo holds it."""

    def __init__(self, path: str):
        self.lib = library(path)
        self.plain = for_words(path)
        self.memo = Memo(self._one, MEMO)
        vocab = spec(path)[0]
        #: By id: does it end a word?
        self.last = np.zeros(self.lib.get_vocab_size(with_added_tokens=True), bool)
        self.last[[i for t, i in vocab.items() if t.endswith(END)]] = True

    def _one(self, word: str) -> bytes:
        return np.array(self.plain.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _whole(self, part: str) -> np.ndarray:
        return np.array(self.lib.encode(part, add_special_tokens=False).ids, "<u4")

    def _many(self, words: list[str]) -> list[bytes]:
        """_one() of each, by one call of the library: a word ends where an id ends one."""
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.last[ids]) + 1
        if len(stops) != len(words):
            return [self._one(w) for w in words]
        at, raw = [0, *(stops * 4).tolist()], ids.tobytes()
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _ids_of(self, distinct: list[str]) -> list[bytes]:
        """The ids of each word: from the memo, or encoded and, if the word is short, kept in it."""
        memo, old, new = self.memo, self.memo.old, []
        out = list(map(memo.get, distinct))
        for k in [k for k, b in enumerate(out) if b is None]:
            b = out[k] = old.get(distinct[k])
            if b is None:
                new.append(k)
            else:
                memo.put(distinct[k], b)
        for j in range(0, len(new), 2000):
            some = new[j : j + 2000]
            for k, b in zip(some, self._many([distinct[k] for k in some]), strict=True):
                out[k] = b
                if len(distinct[k]) <= MEMO_CHARS:
                    memo.put(distinct[k], b)
        return out

    def _looked_up(self, raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of Latin-1 bytes in lower case, and how many of them come before each of the places `cuts`, where no word goes on."""
        on, first = words_at(raw)
        begins = np.flatnonzero(first)
        if not len(begins):
            return np.zeros(0, "<u4"), np.zeros(len(cuts), np.int64)
        solid = raw[on]
        offsets = np.append(np.flatnonzero(first[on]), len(solid))
        # Told apart by Arrow's table of whole words, so that each distinct one is a Python string once.
        words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(solid)]).dictionary_encode()
        _, at, data = words.dictionary.buffers()
        at, text = np.frombuffer(at, np.int64)[: len(words.dictionary) + 1].tolist(), data.to_pybytes().decode("latin-1")
        found = self._ids_of([text[a:b] for a, b in zip(at, at[1:], strict=False)])
        ids = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        code = words.indices.to_numpy()
        size = sizes[code]
        ends = np.append(0, np.cumsum(size))
        places = np.repeat((np.cumsum(sizes) - sizes)[code] - ends[:-1], size)
        places += np.arange(len(places))
        return ids[places], ends[np.searchsorted(begins, cuts)]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [parts(t) for t in texts]
        plain = [p.encode("latin-1") for t in split for s, p in t if not s and latin(p)]
        raw = b"\n".join([*plain, b""]).translate(LOWER)
        stops = np.cumsum([0] + [len(p) + 1 for p in plain])
        ids, before, n, a = [], [], 0, 0
        while a < len(raw):  # a chunk ends at white space
            gap = _WHITE.search(raw, a + CHUNK)
            b = gap.end() if gap else len(raw)
            got, at = self._looked_up(np.frombuffer(raw, np.uint8)[a:b], stops[np.searchsorted(stops, a) : np.searchsorted(stops, b)] - a)
            ids.append(got)
            before.append(n + at)
            n, a = n + len(got), b
        ids, ends = np.concatenate([np.zeros(0, "<u4"), *ids]), np.concatenate([*before, [n]])
        plain, out = iter([ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]), []
        for t in split:
            got = [next(plain) if not s and latin(p) else self._whole(p) for s, p in t]
            out.append(got[0] if len(got) == 1 else np.concatenate(got))
        return out


@kept
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_token_shards(docs: DataFrame, root: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of all documents, ascending by doc_id, as shards under root; returns the manifest.

    Manifest: partition, seq, ids, docs, name. A document's ids end with end_id. A null text is
    empty, a null doc_id comes first, rows that share a doc_id follow each other ordered by text;
    an empty table gives no shards. Partitions are ranges of doc_id.
    """
    path = path or default_path()
    fs, at = pafs.FileSystem.from_uri(root)
    fs.create_dir(at, recursive=True)
    bits = max(1, int(max(library(path).get_vocab_size(with_added_tokens=True) - 1, end_id)).bit_length())
    tail = np.array([end_id], np.uint32)

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc, out = encoder(path), ShardWriter(root, TaskContext.get().partitionId(), bits)
        for batch in batches:
            for k in range(0, batch.num_rows, DOCS):
                part = batch.slice(k, DOCS)
                got = enc.batch([t or "" for t in part.column(1).to_pylist()])
                done = [s for d, ids in zip(part.column(0).to_pylist(), got, strict=True) if (s := out.add(d, np.concatenate([ids, tail])))]
                if done:
                    yield _manifest(done)
        if last := out.close():
            yield _manifest([last])

    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(run, "partition int, seq int, ids long, docs long, name string"), "manifest")


def _manifest(rows):
    p, s, i, d, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(s, pa.int32()), pa.array(i, pa.int64()), pa.array(d, pa.int64()), pa.array(n)], names=["partition", "seq", "ids", "docs", "name"])


def read_token_shards(manifest: DataFrame, root: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    sums = {r["partition"]: r["n"] for r in manifest.groupBy("partition").agg(F.sum("ids").alias("n")).collect()}  # a row for each partition
    starts, total = {}, 0
    for p in sorted(sums):
        starts[p], total = total, total + sums[p]

    def run(batches):
        for batch in batches:
            for p, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(root, name)
                base, m, k = starts[p] + shard.before, len(shard.ends), 0
                begin = np.concatenate([[0], shard.ends[:-1]])
                while k < m:  # documents of about 64 blocks at a time
                    e = max(k + 1, int(np.searchsorted(shard.ends, begin[k] + 64 * shard.block, "right")))
                    ids = shard.ids(int(begin[k]), int(shard.ends[e - 1])).astype("<u4")
                    crc = [zlib.crc32(ids[a - begin[k] : b - begin[k]]) for a, b in zip(begin[k:e], shard.ends[k:e], strict=True)]
                    d = shard.doc_ids[k:e]
                    yield pa.RecordBatch.from_arrays([pa.array(d, mask=d == NO_ID), pa.array(base + begin[k:e]), pa.array(shard.ends[k:e] - begin[k:e]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    k = e

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("partition", "name").repartition(n, "name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark, "token-shards")
    return read_token_shards(write_token_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), root), root)
