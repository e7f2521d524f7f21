"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features are counted on the bytes of whole texts: densities of a seed lexicon and of a lexicon
learnt from the training rows, second-person words near hits, capitals, punctuation and
obfuscation. Lexicons are learnt and features counted on the executors, from whole texts of a bounded
sample of labelled rows; trees and calibration are fitted at the driver, in numpy, on the features.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import discard, materialize, mix, release, settle, text_chunks, word_hashes, words_of

#: Labelled rows that the model is fitted on, at most: those with the smallest hashed doc_id.
SAMPLE_ROWS = 8_000
#: Parts of the sample whose margins calibrate, each by a model of the others.
PARTS = 3
FOLDS, TREES, DEPTH, BINS, RATE = 5, 80, 3, 32, 0.15

SEED_WORDS = """idiot idiots moron morons stupid dumb fool loser losers trash garbage scum pathetic worthless disgusting
clown hate kill die ugly shut freak creep jerk bastard bitch damn hell crap shit fuck fucking asshole imbecile cretin
vermin filth filthy useless idiota estúpido imbécil basura asco payaso inútil idiot imbécile stupide ordure déchet
nul minable dummkopf blödmann dumm abschaum müll widerlich wertlos trottel""".split()
SECOND_PERSON = "you your yours yourself youre u ur du dich dir dein deine ihr euch tu toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_PUNCT = ~(_LETTER | _DIGIT | _SPACE)
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
for _a, _b in zip("013457@$!", "oieastasi", strict=True):
    _PLAIN[ord(_a)] = ord(_b)
_KEPT = _LETTER | (_PLAIN != np.arange(256)) | _SPACE


def hash_words(words: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    s, e, _ = words_of(raw, np.array([0, len(raw)]))
    return np.unique(word_hashes(raw, s, e))


_SEED, _YOU = hash_words(SEED_WORDS), hash_words(SECOND_PERSON)


def _in(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(h):
        return np.zeros(len(h), bool)
    k = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return table[k] == h


def letter_words(raw: np.ndarray, offs: np.ndarray):
    """Hashes, documents and spans of runs of letters."""
    on = _LETTER[raw]
    st, en = on.copy(), on.copy()
    st[1:] &= ~on[:-1]
    en[:-1] &= ~on[1:]
    full = offs[:-1] < offs[1:]
    a, b = offs[:-1][full], offs[1:][full] - 1
    st[a], en[b] = on[a], on[b]
    s, e = np.flatnonzero(st), np.flatnonzero(en) + 1
    return word_hashes(raw, s, e), np.searchsorted(offs, s, "right") - 1, s, e


def features(raw: np.ndarray, offs: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A row of features for each document of a chunk."""
    n = len(offs) - 1
    size = np.diff(offs).astype(float)
    if not len(raw):
        return np.zeros((n, N_FEATURES))
    words, weights = lexicon
    # A text is under 2 GB, so 32 bits count its bytes.
    upto = lambda mask: np.concatenate([np.zeros(1, np.int32), np.cumsum(mask, dtype=np.int32)])
    count = lambda mask: np.diff(upto(mask)[offs]).astype(float)
    h, d, s, e = letter_words(raw, offs)
    nw = np.bincount(d, minlength=n).astype(float)
    per = lambda x, by=None: np.bincount(d, weights=x, minlength=n) if len(d) else np.zeros(n)
    seed, you = _in(h, _SEED), _in(h, _YOU)
    hit = _in(h, words)
    w = np.zeros(len(h))
    if hit.any():
        w[hit] = weights[np.searchsorted(words, h[hit])]
    best = np.zeros(n)
    np.maximum.at(best, d[hit], w[hit])
    bad = seed | (w > 0)
    # Second person within five words of a hit, in the same document.
    near = np.zeros(len(h), bool)
    for k in range(1, 6):
        if len(h) > k:
            same = d[k:] == d[:-k]
            near[k:] |= you[:-k] & same
            near[:-k] |= you[k:] & same
    distinct = np.zeros(n)
    if bad.any():
        pair = np.unique(np.stack([d[bad].astype(np.uint64), h[bad]], 1), axis=0)
        distinct = np.bincount(pair[:, 0].astype(np.int64), minlength=n).astype(float)
    up = upto(_UPPER[raw])
    caps = (up[e] - up[s] == e - s) & (e - s > 2)
    # Words with look-alike characters read as letters and other characters inside them left out.
    kept = _KEPT[raw]
    plain = _PLAIN[raw][kept]
    koffs = upto(kept)[offs].astype(np.int64)
    ks, ke, kd = words_of(plain, koffs)
    kh = word_hashes(plain, ks, ke)
    read = _in(kh, _SEED) | _in(kh, words[weights > 0])
    hidden = np.maximum(np.bincount(kd[read], minlength=n) - per(bad), 0) if len(kd) else np.zeros(n)
    punct, digit = _PUNCT[raw], _DIGIT[raw]
    run = np.zeros(len(raw), bool)
    run[1:] = punct[1:] & punct[:-1]
    mid = np.zeros(len(raw), bool)  # a digit or sign between letters
    if len(raw) > 2:
        mid[1:-1] = (punct | digit)[1:-1] & _LETTER[raw][:-2] & _LETTER[raw][2:]
    # Neither looks over the edge of its document.
    run[offs[:-1][size > 0]] = False
    mid[offs[:-1][size > 0]] = mid[offs[1:][size > 0] - 1] = False
    nz, nb = np.maximum(nw, 1), np.maximum(size, 1)
    pos = per(np.where(w > 0, w, 0))
    return np.stack([
        np.log1p(nw), per(seed), per(seed) / nz, per(w > 0), per(w > 0) / nz, pos, per(w) / nz, best, distinct, distinct / nz,
        per(you) / nz, per(near & bad), per(near & bad) / nz, count(_UPPER[raw]) / nb, per(caps) / nz, count(punct) / nb, count(run) / nb,
        count(raw == 33) / nb, count(raw == 63) / nb, count(digit) / nb, hidden, hidden / nz, count(mid) / nb, size / nz,
    ], 1)


N_FEATURES = 24


def word_presence(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(place in the array, distinct word hashes) of each text."""
    for i, j, raw, offs in text_chunks(texts):
        h, d, _, _ = letter_words(raw, offs)
        ends = np.searchsorted(d, np.arange(j - i + 1))
        for k in range(j - i):
            yield i + k, np.unique(h[ends[k] : ends[k + 1]])


def learn_lexicon(counts: np.ndarray, hashes: np.ndarray, n1: float, n0: float, most: int = 200, least: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Words whose presence tells the classes apart by over 4 standard errors: hashes and log odds, `most` at most.

    counts: for each hash the texts of class 1 and of all classes that hold it; n1, n0: texts of each class.
    """
    pos, all_ = counts[:, 0].astype(float), counts[:, 1].astype(float)
    n1, n0 = max(1.0, n1), max(1.0, n0)
    a, b = pos + 0.5, all_ - pos + 0.5
    odds = np.log(a / (n1 - pos + 0.5)) - np.log(b / (n0 - (all_ - pos) + 0.5))
    z = odds / np.sqrt(1 / a + 1 / b)
    good = np.flatnonzero((all_ >= least) & (z > 4))
    good = good[np.lexsort((hashes[good], -z[good]))[:most]]
    good = good[np.argsort(hashes[good], kind="stable")]
    return hashes[good], odds[good]


class Boosted:
    """Gradient-boosted trees for the logistic loss, on binned features; complete trees as arrays."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.n, self.depth, self.rate = trees, depth, rate

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        # A rare count is zero at most quantiles: half of its range must still be told from zero.
        self.cuts = [np.unique(np.concatenate([c, np.quantile(v[v > 0], [0, 0.25, 0.5, 0.75]) - 1e-9])) if (v > 0).any() else c for c, v in zip(self.cuts, x.T, strict=True)]
        width = max(map(len, self.cuts)) + 1
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, f = float(np.log(p / (1 - p))), np.full(len(y), np.log(p / (1 - p)))
        self.trees = []
        nf, col = x.shape[1], np.arange(x.shape[1])
        for _ in range(self.n):
            q = 1 / (1 + np.exp(-f))
            g, hess = y - q, q * (1 - q)
            feat, cut = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf)
            node = np.zeros(len(y), int)
            for level in range(self.depth):
                k = 2**level
                at = ((node[:, None] * nf + col) * width + binned).ravel()
                sg = np.bincount(at, np.repeat(g, nf), k * nf * width).reshape(k, nf, width).cumsum(2)
                sh = np.bincount(at, np.repeat(hess, nf), k * nf * width).reshape(k, nf, width).cumsum(2)
                tg, th = sg[:, :, -1:], sh[:, :, -1:]
                gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                gain[(sh < 2) | (th - sh < 2)] = 0
                top = gain.reshape(k, -1).argmax(1)
                for j in range(k):
                    if gain.reshape(k, -1)[j, top[j]] > 1e-6:
                        a, b = divmod(int(top[j]), width)
                        feat[k - 1 + j], cut[k - 1 + j] = a, self.cuts[a][b] if b < len(self.cuts[a]) else np.inf
                at = k - 1 + node
                node = node * 2 + (x[np.arange(len(y)), feat[at]] > cut[at])
            leaf = np.bincount(node, g, 2**self.depth) / (np.bincount(node, hess, 2**self.depth) + 1) * self.rate
            f = f + leaf[node]
            self.trees.append((feat, cut, leaf))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for feat, cut, leaf in self.trees:
            node = np.zeros(len(x), int)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = node * 2 + (x[rows, feat[at]] > cut[at])
            f += leaf[node]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots of a non-decreasing piecewise linear map from x to the mean of y."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # weight, sum of y, sum of x
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([1.0, float(b), float(a)])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


class Model:
    """Lexicon, trees and calibration; score() takes a chunk of texts."""

    def __init__(self, lexicon: tuple[np.ndarray, np.ndarray], tables: np.ndarray, y: np.ndarray, part: np.ndarray):
        """tables: features of the sample by the lexicons learnt without parts 0 to PARTS - 1 and by the whole one; part: of each row."""
        y = y.astype(float)
        self.lexicon, self.trees = lexicon, None
        if not len(y) or y.min() == y.max():
            warnings.warn("labels of one class only: no document is told toxic", stacklevel=2)
            return
        # The margins that calibrate come from trees and lexicons that haven't seen their rows.
        out, seen = np.zeros(len(y)), np.zeros(len(y), bool)
        for k in range(PARTS):
            own, rest = part == k, part != k
            if own.any() and rest.any() and 0 < y[rest].sum() < rest.sum():
                out[own] = Boosted().fit(tables[k][rest], y[rest]).margin(tables[k][own])
                seen |= own
        self.trees = Boosted().fit(tables[PARTS], y)
        self.knots = isotonic(out[seen], y[seen]) if seen.any() else (np.array([-1.0, 1.0]), np.array([0.0, 1.0]))

    def score(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(offs) - 1)
        return np.clip(np.interp(self.trees.margin(features(raw, offs, self.lexicon)), *self.knots), 0, 1)


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most `rows` labelled rows outside the held-out fold, whole texts of any length.

    Null labels and doc_ids aren't drawn; a doc_id with several labels or texts counts once for each.
    Null texts count as empty. Labels of one class, or none, tell nothing: every score is then 0, with
    a warning. The driver gets N_FEATURES numbers a row and the words that pass as a lexicon.
    """
    place = F.xxhash64("doc_id", F.lit(6))
    drawn = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"), place.alias("place")).orderBy("place", "toxic").limit(rows)
    # At most `rows` rows of three numbers: the broadcast is bounded.
    sample = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id").select("place", "toxic", F.xxhash64("text").alias("tie"), "text")
    sample = materialize(sample, "sample")

    def part_of(place: pa.Array) -> np.ndarray:
        return (mix(np.asarray(place).view(np.uint64)) % np.uint64(97) % np.uint64(PARTS)).astype(np.int64)

    def presence(batches):
        release()
        for batch in batches:
            part, y = part_of(batch.column(0)), np.asarray(batch.column(1))
            for k, h in word_presence(batch.column(2)):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), part[k] * 2 + (y[k] > 0)))], names=["hash", "cell"])

    cells = [F.count_if(F.col("cell") == c).alias(f"c{c}") for c in range(2 * PARTS)]
    held = sample.select("place", "toxic", "text").mapInArrow(presence, "hash long, cell long").groupBy("hash").agg(*cells)
    # A word of a lexicon is in 5 texts at least, and relatively more often in those of class 1.
    marks = sample.select("place", "toxic", "tie").toArrow()
    part, y = part_of(marks["place"].combine_chunks()), (np.asarray(marks["toxic"]) > 0).astype(float)
    pos, every = (reduce(add, [F.col(f"c{c}") for c in range(k, 2 * PARTS, 1 + k)]) for k in (1, 0))
    few = held.withColumn("pos", pos).withColumn("every", every).where((F.col("every") >= 5) & (F.col("pos") * 2 >= F.col("every") * float(y.mean() if len(y) else 0)))
    few = few.select("hash", *[f"c{c}" for c in range(2 * PARTS)]).toArrow()
    hashes = np.asarray(few["hash"]).view(np.uint64) if few.num_rows else np.zeros(0, np.uint64)
    table = np.stack([np.asarray(few[f"c{c}"]) for c in range(2 * PARTS)], 1) if few.num_rows else np.zeros((0, 2 * PARTS), np.int64)
    lexicons = []
    for k in [*range(PARTS), None]:
        rest, cols = part != k if k is not None else np.ones(len(y), bool), [p for p in range(PARTS) if p != k]
        counts = np.stack([table[:, [2 * p + 1 for p in cols]].sum(1), table[:, [2 * p + c for p in cols for c in (0, 1)]].sum(1)], 1)
        lexicons.append(learn_lexicon(counts, hashes, y[rest].sum(), len(y[rest]) - y[rest].sum()))

    def measured(batches):
        release()
        for batch in batches:
            for i, j, raw, offs in text_chunks(batch.column(3)):
                x = np.concatenate([features(raw, offs, lex) for lex in lexicons], 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(3)), lists], names=["place", "toxic", "tie", "x"])

    got = sample.mapInArrow(measured, "place long, toxic int, tie long, x array<double>").toArrow()
    discard(sample)
    place, y, tie = (np.asarray(got[c]) for c in ("place", "toxic", "tie"))
    order = np.lexsort((tie, y, place))  # so that the fit doesn't depend on partitions
    x = np.asarray(got["x"].combine_chunks().flatten()).reshape(len(y), PARTS + 1, N_FEATURES) if len(y) else np.zeros((0, PARTS + 1, N_FEATURES))
    return Model(lexicons[-1], x[order].transpose(1, 0, 2), (y[order] > 0).astype(float), part_of(pa.array(place[order])) if len(y) else np.zeros(0, np.int64))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a last column __toxicity, 0 to 1. Empty and null texts score too; long ones are read whole."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    settle(docs.sparkSession)
    k = docs.columns.index("text")
    spec = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers per tree, and 200 words

    def run(batches):
        release()
        m = spec.value
        for batch in batches:
            for i, j, raw, offs in text_chunks(batch.column(k)):  # small batches back, so no side holds many texts
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(m.score(raw, offs))], names=[*batch.schema.names, "__toxicity"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__toxicity", DoubleType())]))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("__toxicity").alias("score"), (F.col("__toxicity") >= 0.5).cast("int").alias("predicted"))
