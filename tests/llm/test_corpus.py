"""The corpus operators against brute force, and on nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackloom.llm import bpe_automaton, components, exact_dedup, importance, jaccard_join, line_dedup, mixing, nearest, substring_dedup, token_output, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, size long, label string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[k] + str(r.integers(40)) for k in r.integers(len(WORDS), size=n))


TEXTS = [
    None, "", " \n\t ", "one two", "ONE two", "one two", prose(200, 1), prose(200, 1) + " tail", prose(200, 1), prose(120, 2) + " " + prose(90, 3), prose(90, 3), prose(4000, 4),
    "a\nb\nc\nd", "x\na\nb\nc\ny", "a\nb\nc\na\nb\nc", "don't STOP Σ ½ <|endoftext|> é\x1cz 日本 it's", "aaaa" * 300, "aaaa" * 300 + "b",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", ["s1", "s2", None][k % 3], 1, 7, 8, "x") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


# ---- exact dedup -----------------------------------------------------------


def test_exact_dedup(docs, none):
    groups = defaultdict(list)
    for k, t in enumerate(TEXTS):
        groups[t or ""].append(k)
    got = by_id(exact_dedup.exact_dedup(docs))
    assert len(got) == len(TEXTS)
    for t, ids in groups.items():
        for k in ids:
            assert (got[k]["keep_id"], got[k]["group_size"], got[k]["kept"], got[k]["text_sha256"]) == (max(ids), len(ids), k == max(ids), hashlib.sha256(t.encode()).hexdigest())
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(max(i) for i in groups.values())
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_of_repeated_rows_and_null_ids(spark):
    x = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b"), (3, "a")], "doc_id long, text string")
    assert Counter((r["doc_id"], r["kept"]) for r in exact_dedup.exact_dedup(x).collect()) == {(1, False): 2, (3, True): 1, (None, True): 1, (None, False): 1}
    assert sorted(map(str, (tuple(r) for r in exact_dedup.keep_one(x).collect()))) == ["(3, 'a')", "(None, 'b')"]


def test_index_grows(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    a = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    b = spark.createDataFrame([(3, "b"), (4, "c")], "doc_id long, text string")
    exact_dedup.exact_dedup(a, at).collect()
    got = by_id(exact_dedup.exact_dedup(b, at))
    assert (got[3]["kept"], got[3]["keep_id"], got[4]["kept"]) == (False, 2, True)


def test_a_batch_given_twice_keeps_nothing(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    x = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c")], "doc_id long, text string")
    first = exact_dedup.exact_dedup(x, at).collect()
    again = exact_dedup.exact_dedup(x, at).collect()
    assert sum(r["kept"] for r in first) == 3 and [r["kept"] for r in again] == [False] * 4
    assert {(r["doc_id"], r["keep_id"]) for r in again} == {(1, 1), (2, 2), (None, None)}
    # The files of an index from before batches had names.
    old = f"file://{tmp_path}/old"
    spark.read.parquet(at).drop("batch").repartition(64, "digest").write.bucketBy(64, "digest").sortBy("digest").option("path", old).saveAsTable("old_index")
    assert not any(r["kept"] for r in exact_dedup.exact_dedup(x, old).collect())


def test_index_over_three_batches(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    at = f"file://{tmp_path}/index"
    exact_dedup.exact_dedup(frame(*((k, f"t{k}") for k in range(1000)), (1000, "t7")), at).collect()
    got = by_id(exact_dedup.exact_dedup(frame((1, "t7"), (2, "t7"), (3, "new"), (4, "t8")), at))  # a small batch on a larger index
    assert [(got[k]["keep_id"], got[k]["group_size"], got[k]["kept"]) for k in (1, 2, 3, 4)] == [(1000, 4, False), (1000, 4, False), (3, 1, True), (8, 2, False)]
    got = by_id(exact_dedup.exact_dedup(frame((9, "t7"), (10, "new")), at))
    assert [(got[k]["keep_id"], got[k]["group_size"], got[k]["kept"]) for k in (9, 10)] == [(1000, 5, False), (3, 2, False)]
    index = exact_dedup.DigestIndex(spark, at)
    small = index.compacted(f"file://{tmp_path}/small")
    key = lambda r: r["digest"]
    assert sorted(index.digests().collect(), key=key) == sorted(small.digests().collect(), key=key) and small.frame().count() == 1001
    assert small.buckets == index.buckets == exact_dedup.BUCKETS[0] and len(list((tmp_path / "small").glob("*.parquet"))) <= small.buckets
    assert [r["group_size"] for r in exact_dedup.exact_dedup(frame((11, "t7")), small.path).collect()] == [6]
    index.drop()
    assert not (tmp_path / "index").exists()


def test_a_failed_batch_leaves_the_index(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, at)
    index.append(exact_dedup.digests_of(rows))
    before = sorted(map(tuple, index.frame().collect()))
    bad = exact_dedup.digests_of(rows).unionByName(spark.createDataFrame([(3, 0)], "doc_id long, row long").withColumn("digest", F.expr("if(doc_id = 3, raise_error('lost'), 'x')").cast("string")))
    with pytest.raises(Exception, match="lost"):
        index.append(bad)
    assert sorted(map(tuple, exact_dedup.DigestIndex(spark, at).frame().collect())) == before
    assert not any(r["kept"] for r in exact_dedup.exact_dedup(rows, at).collect())


# ---- Jaccard join ----------------------------------------------------------


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode()))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_classes(texts):
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[b]:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return [(len(sets[k]), find(k)) for k in range(len(sets))]


@pytest.mark.parametrize("block", [2_000_000, 400])
def test_jaccard_join(spark, docs, none, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    r = np.random.default_rng(3)
    texts = list(TEXTS)
    for k in range(40):  # near copies at many distances
        w = prose(120, 50 + k % 4).split()
        for i in r.integers(len(w), size=k % 9):
            w[i] = "edit" + str(r.integers(9))
        texts.append(" ".join(w))
    x = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, row long")
    got = by_id(jaccard_join.jaccard_classes(x))
    assert [(got[k]["n_shingles"], got[k]["component_id"]) for k in range(len(texts))] == brute_classes(texts)


def test_members_of_a_group_link_to_all_that_they_are_similar_to():
    r, c = [1, 2, 3], list(range(10, 20))  # r: rare, in the prefix of all three
    b1, b2, a = r + c[1:7] + c[8:9], r + c[2:8] + c[9:], r + c[1:8]
    others = [c[1:] + list(range(100 * k, 100 * k + 10)) for k in range(1, 5)]
    for order in itertools.permutations([b1, b2, a]):
        sets = [np.array(x) for x in (*order, *others)]
        assert jaccard_join.grouped_prefix_join(sets).tolist() == [0, 0, 0, 3, 4, 5, 6]


def test_one_of_each(docs, none):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {c if n else k for k, (n, c) in enumerate(brute_classes(TEXTS))}
    assert {r["doc_id"] for r in kept.collect()} == want
    assert jaccard_join.one_of_each(none).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.components(e).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# ---- BPE and token output --------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_automaton.default_path())


def test_bpe_automaton(docs, none, library):
    got = by_id(bpe_automaton.encode_documents(docs, texts=True))
    for k, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[k]["ids"] == ids and got[k]["n_tokens"] == len(ids)
        assert got[k]["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe_automaton.encode_documents(none).count() == 0


def test_bpe_on_random_words(library):
    r, c = np.random.default_rng(0), bpe_automaton.codec(bpe_automaton.default_path())
    for alphabet in ("ab", "the quickér", "0a'!_ ", "estionrandl"):
        for _ in range(60):
            t = "".join(r.choice(list(alphabet), size=80))
            ids = library.encode(t, add_special_tokens=False).ids
            assert c.encode(t) == ids and c.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 31])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype(np.uint32)
    raw = token_output.pack(ids, bits)
    assert (token_output.unpack(raw, bits, 1003) == ids).all() and (token_output.unpack(raw, bits, 100, 555) == ids[555:655]).all()


def test_token_output(spark, docs, none, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "SHARD_IDS", 500)
    root = f"file://{tmp_path}/ids"
    got = by_id(token_output.read_token_shards(m := token_output.write_token_shards(docs, root), root))
    at = 0
    for k, t in enumerate(TEXTS):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    shard = token_output.Shard(root, m.orderBy("name").first()["name"])
    assert shard.document(0).tolist()[-1] == 2
    root = f"file://{tmp_path}/none"
    assert token_output.read_token_shards(token_output.write_token_shards(none, root), root).count() == 0


# ---- suffix-array dedup ----------------------------------------------------


@pytest.mark.parametrize("group", [4096, 1])
def test_substring_dedup(spark, docs, none, group, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    passage = prose(80, 99)
    texts = [*TEXTS, *(prose(30 + k, 200 + k) + " " + passage + " " + prose(20, 300 + k) for k in range(6)), prose(60, 7) + passage[:420] + passage]
    x = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "row long, doc_id long, text string")
    got = by_id(substring_dedup.substring_dedup(x, texts=True))
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    for k, b in enumerate(raw):
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                cover[i : i + 400] = True
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        runs = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        assert (got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"], bytes(got[k]["kept"])) == (len(b), int(cover.sum()), runs, kept)
    assert substring_dedup.substring_dedup(none).count() == 0


@pytest.mark.parametrize("group", [2, 5, 10])
def test_substring_dedup_of_a_passage_whose_neighbours_agree_for_a_few_bytes(spark, group, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    r, passage = np.random.default_rng(5), prose(80, 99)
    few = lambda: "".join(r.choice(list("ab"), size=4))
    texts = [prose(90, 400 + k) + few() + passage + few() + prose(90, 500 + k) for k in range(40)]
    x = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "row long, doc_id long, text string")
    got = by_id(substring_dedup.substring_dedup(x, texts=True))
    raw = [t.encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    for k, b in enumerate(raw):
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                cover[i : i + 400] = True
        assert (got[k]["n_removed"], bytes(got[k]["kept"])) == (int(cover.sum()), bytes(x for x, c in zip(b, cover, strict=True) if not c))


@pytest.mark.parametrize("seed", range(6))
def test_groups_around_an_anchor_are_the_maximal_repeats(seed):
    """Against all pairs of extents: members that share them, no more on either side."""
    r = np.random.default_rng(seed)
    left, right = (["".join(r.choice(list("ab"), size=r.integers(0, 7))).encode() for _ in range(14)] for _ in range(2))
    keep = [k for k in range(14) if (left[k], right[k]) not in list(zip(left, right, strict=True))[:k]]
    left, right = [left[k] for k in keep], [right[k] for k in keep]
    want = set()
    for e in range(7):
        for size in range(1, 7):
            if e + size < 4:
                continue
            by = defaultdict(list)
            for k, (a, b) in enumerate(zip(left, right, strict=True)):
                if len(a) >= e and len(b) >= size:
                    by[a[:e], b[:size]].append(k)
            for members in by.values():
                if len(members) > 1 and len({left[k][e : e + 1] or k for k in members}) > 1 and len({right[k][size : size + 1] or k for k in members}) > 1:
                    want.add((e, size, tuple(members)))
    assert {(e, size, tuple(sorted(m))) for e, size, m in substring_dedup.repeat_groups_of(left, right, 4)} == want


def test_repeat_groups_have_all_their_occurrences(spark):
    a, b = prose(80, 99), prose(90, 98)
    texts = [prose(30, 1) + a, prose(25, 2) + a + "!" + b, "x" + b + prose(20, 3), a[:430] + "?" + prose(20, 4), prose(300, 5)]
    x = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    groups = defaultdict(set)
    for r in substring_dedup.repeat_groups(x).collect():
        groups[r["gram"], r["number"], r["length"]].add((r["row"], r["start"]))
    cover, held = defaultdict(set), set()
    for (_, _, n), places in groups.items():
        same = {texts[row].encode()[start : start + n] for row, start in places}
        assert n >= 400 and len(places) > 1 and len(same) == 1
        held.add(frozenset(row for row, _ in places))
        for row, start in places:
            cover[row] |= set(range(start, start + n))
    assert frozenset({0, 1, 3}) in held and frozenset({1, 2}) in held
    got = by_id(substring_dedup.substring_dedup(x.withColumn("doc_id", F.col("row"))))
    assert {k: len(cover[k]) for k in range(5)} == {k: r["n_removed"] for k, r in got.items()}


# ---- mixing ----------------------------------------------------------------


def test_targets():
    t = mixing.targets([("b", 100), ("a", 100), (None, 100), ("c", 0)])
    assert t == {"a": pytest.approx(300 / 7 * 1), "b": pytest.approx(300 / 7 * 2), "c": 0, None: pytest.approx(300 / 7 * 4)} or sum(t.values()) == pytest.approx(300)
    t = mixing.targets([("a", 1000), ("b", 10), ("c", 10)])
    assert t["b"] == 30 and t["c"] == 30 and t["a"] == pytest.approx(960)
    assert mixing.targets([]) == {}


def test_split_tree():
    out = mixing.split_tree([100, 0, 7, 33], 6, 1)
    assert out.sum(1).tolist() == [100, 0, 7, 33] and max(out.sum(0)) - min(out.sum(0)) <= 1 and (out >= 0).all()


def test_block_draws_come_from_the_tree():
    words = [np.array([5, 0, 7, 9, 4]), np.array([3]), np.zeros(2, int), np.array([10, 10])]
    goals, shards = [62.0, 8.0, 0.0, 25.0], 3
    drawn, lacks = mixing.block_draws(words, goals, shards, 5)
    quotas = [sum(map(len, own)) for own in drawn]
    dealt = mixing.split_tree(quotas, shards, 5)
    for k, own in enumerate(drawn):
        got = Counter(s for block in own for s in block)
        assert [got[s] for s in range(shards)] == dealt[k].tolist()
        passes = int(goals[k] // words[k].sum()) if words[k].sum() else 0
        assert all(passes <= len(block) <= passes + 1 for block in own)  # disjoint in each pass
        taken = sum(len(block) * w for block, w in zip(own, words[k], strict=True))
        assert taken <= goals[k] and abs(goals[k] - taken - lacks[k][0]) < 1e-9 and all(len(own[b]) == passes for b in lacks[k][1])
    assert drawn == mixing.block_draws(words, goals, shards, 5)[0]
    assert mixing.fitting([5, 9, 0, 4, 4], 13) == [1, 3] and mixing.fitting([], 3) == []


def brute_mix(rows, shards, seed):
    """draws and shards of each row of plan_draws(), from key, source and size alone, one row after the other."""
    order, out = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or "")), {}
    size = {s: sum(r["size"] for r in rows if r["source"] == s) for s in order}
    weights, left, rest, goal = {s: k % 3 + 1 for k, s in enumerate(order)}, set(order), sum(size.values()), {}
    while left:
        unit = rest / sum(weights[s] for s in left)
        over = [s for s in left if unit * weights[s] > 3 * size[s]]
        for s in over or left:
            goal[s] = 3 * size[s] if over else unit * weights[s]
        rest, left = rest - sum(goal[s] for s in over), left - set(over) if over else set()
    held, words = defaultdict(list), []
    for k, s in enumerate(order):
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: (r["key"], r["doc_id"], r["size"]))
        n = max(1, -(-size[s] // mixing.BLOCK_WORDS))
        words.append(np.zeros(n, np.int64))
        at = 0
        for r in own:
            block = min(n - 1, int((at + r["size"] / 2) * n / max(1, size[s])))
            at += r["size"]
            words[k][block] += r["size"]
            held[k, block].append(r)
    drawn, lacks = mixing.block_draws(words, [goal[s] for s in order], shards, seed)
    for (k, block), docs_ in held.items():
        for r in docs_:
            out[r["doc_id"]] = list(drawn[k][block])
    for k, (room, turn) in enumerate(lacks):
        if room > mixing.FILL_SHARE * goal[order[k]]:
            for r in sorted((r for b in turn for r in held[k, b]), key=lambda r: (-r["size"], r["key"])):
                if 0 < r["size"] <= room:
                    out[r["doc_id"]].append(r["key"] % shards)
                    room -= r["size"]
    return goal, out


def test_mixing(spark, docs, none):
    rows = [(k, prose(20 + k % 97, k), ["p", "q", "r"][k % 3 if k % 7 else 0] if k % 10 else None) for k in range(900)]
    x = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r.asDict() for r in mixing.plan_draws(x, shards=4).collect()]
    again = [r.asDict() for r in mixing.plan_draws(x.repartition(5), shards=4).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    goal, want = brute_mix(got, 4, 17)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and r["taken"] == r["size"] * r["draws"] <= 3 * r["size"]
        assert r["shards"] == want[r["doc_id"]] and r["target"] == pytest.approx(goal[r["source"]])
    for s, g in goal.items():
        assert 0 <= g - taken[s] <= 0.005 * g
    out = mixing.mix_documents(x, shards=4)
    assert out.columns == x.columns and Counter(r["doc_id"] for r in out.collect()) == {r["doc_id"]: r["draws"] for r in got if r["draws"]}
    parts = out.select("doc_id", F.spark_partition_id().alias("p")).collect()
    assert Counter((r["doc_id"], r["p"]) for r in parts) == Counter((r["doc_id"], s) for r in got for s in r["shards"])  # a shard is a partition
    assert len(by_id(mixing.plan_draws(docs))) == len(TEXTS) and mixing.plan_draws(none).count() == 0
    assert mixing.mix_documents(docs).columns == docs.columns and mixing.mix_documents(none).count() == 0


# ---- toxicity --------------------------------------------------------------


def test_toxicity(spark, docs, none):
    rows = [(k, prose(30, k) + (" you are such a WORTHLESS idiot, " if k % 4 == 0 else " fine then ") + prose(10, k)) for k in range(800)]
    x = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(800)], "doc_id long, toxic int")
    model = toxicity.fit(x, labels)
    test = toxicity.score_documents(x, model).where(toxicity.held_out()).collect()
    assert len(test) > 100 and np.mean([(r["__toxicity"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in test]) > 0.97
    odd = toxicity.score_documents(docs, model)
    assert odd.columns == [*docs.columns, "__toxicity"] and all(0 <= r["__toxicity"] <= 1 for r in odd.collect())
    assert toxicity.score_documents(none, toxicity.fit(none, labels)).count() == 0


def plain_features(text):
    """Some features counted from the string alone."""
    words = re.findall(r"[A-Za-z\x80-\U0010ffff]+", text)
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    seed, you = [w in toxicity.SEED_WORDS for w in low], [w in toxicity.SECOND_PERSON for w in low]
    near = [any(you[j] for j in range(max(0, i - 5), min(len(low), i + 6)) if j != i) for i in range(len(low))]
    raw, n = text.encode(), max(1, len(words))
    punct = [not re.match(rb"[A-Za-z0-9\x80-\xff \t-\r]", raw[i : i + 1]) for i in range(len(raw))]
    caps = sum(len(w) > 2 and all("A" <= c <= "Z" for c in w) for w in words)
    b = max(1, len(raw))
    return {
        0: np.log1p(len(words)), 1: sum(seed), 2: sum(seed) / n, 8: len({w for w, s in zip(low, seed, strict=True) if s}), 10: sum(you) / n, 11: sum(a and c for a, c in zip(near, seed, strict=True)),
        13: sum(65 <= c <= 90 for c in raw) / b, 14: caps / n, 15: sum(punct) / b, 16: sum(a and c for a, c in itertools.pairwise(punct)) / b, 17: raw.count(b"!") / b, 18: raw.count(b"?") / b,
        19: sum(48 <= c <= 57 for c in raw) / b, 23: len(raw) / n,
    }


def test_features_against_plain_counting():
    texts = ["You are an IDIOT!! id1ot, really?", "", "fool " * 3 + "and you, YOU... 12 fools", "nothing here", "WORTHLESS trash -- don't YELL é ÉTÉ you", "a1b2 !?! tú eres idiota"]
    _, _, raw, offs = next(toxicity.text_chunks(pa.array(texts)))
    got = toxicity.features(raw, offs, (np.zeros(0, np.uint64), np.zeros(0)))
    for row, t in zip(got, texts, strict=True):
        for k, v in plain_features(t).items():
            assert row[k] == pytest.approx(v if t else 0), (k, t)


def test_the_lexicon_is_that_of_plain_counting(spark):
    r = np.random.default_rng(3)
    texts = [prose(40, k) + (" grumpy gnarl" if k % 3 == 0 and r.random() < 0.9 else "") + (" filler" if r.random() < 0.5 else "") for k in range(600)]
    x = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(600)], "doc_id long, toxic int")
    used = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5]
    model = toxicity.fit(x, labels)
    words = {w: [k for k in used if w in re.findall("[A-Za-z]+", texts[k])] for w in ("grumpy", "gnarl", "filler", "alpha")}
    n1 = sum(k % 3 == 0 for k in used)
    odds = {}
    for w, at in words.items():
        a = sum(k % 3 == 0 for k in at)
        odds[w] = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((len(at) - a + 0.5) / (len(used) - n1 - len(at) + a + 0.5))
    held = dict(zip(model.lexicon[0].tolist(), model.lexicon[1], strict=True))
    for w in words:
        h = int(toxicity.hash_words([w])[0])
        assert (h in held) == (w[0] == "g") and (h not in held or held[h] == pytest.approx(odds[w]))


def test_labels_of_one_class_reject_nothing(spark):
    x = spark.createDataFrame([(1, "fine"), (2, "words " * 100_000), (3, None)], "doc_id long, text string")
    for toxic in (0, 1):
        with pytest.warns(UserWarning, match="one class"):
            model = toxicity.fit(x, spark.createDataFrame([(2, toxic)], "doc_id long, toxic int"))
        assert [r["__toxicity"] for r in toxicity.score_documents(x, model).collect()] == [0.0] * 3


def test_isotonic():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(y) >= 0).all() and y[0] == 0 and y[-1] == 1


# ---- nearest neighbours ----------------------------------------------------


def test_nearest(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(3000, 8))
    v[10:40] = v[100]  # ties
    rows = [(k, [float(z) for z in x]) for k, x in enumerate(v)] + [(5000, None), (5100, [0.0] * 8), (5200, [float("nan")] * 8), (5300, [1.0]), (None, [1.0] * 8)]
    x = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for q in nearest.nearest(x).collect():
        got[q["query_id"]].append((q["rank"], q["vec_id"], q["score"]))
    assert set(got) == set(range(0, 3000, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and all(abs(s - d[i]) < 1e-12 for _, i, s in found)
        hits += len(set(want) & {i for _, i, _ in found})
    assert hits >= 0.9 * 10 * len(got)
    assert [i for _, i, _ in got[100]] == list(range(10, 20))
    twice = x.where("vec_id < 60").unionByName(spark.createDataFrame([(7, [9.0] * 8), (7, list(map(float, v[0])))], x.schema))
    found = sorted(tuple(q) for q in nearest.nearest(twice, every=100).collect())
    assert found[0] == (0, 1, 7, 0.0) and len({q[2] for q in found}) == 10
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in nearest.nearest(few).collect()] == [(0, 1, 1, 1.0)]
    assert nearest.nearest(few.where("vec_id > 5")).count() == 0


def test_blocks_hold_all_cells():
    counts = np.random.default_rng(1).integers(0, 9, 50)
    counts[17] = 95
    first, parts = nearest.blocks(counts, 20)
    held = Counter()
    for c in np.flatnonzero(counts):
        for p in range(parts[c]):
            held[first[c] + p] += counts[c] / parts[c]
    assert parts[17] == 5 and max(held.values()) <= 20 and sorted(held) == list(range(len(held)))


def test_traverse_is_in_order():
    r = np.random.default_rng(4)
    a, b = r.random(7), r.random(5)
    cells = nearest.traverse(a, b, np.ones(35, int), 35)
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sorted(cells) == list(range(35)) and sums == sorted(sums)


# ---- importance resampling -------------------------------------------------


def test_importance(spark, docs, none, monkeypatch):
    rows = [(k, prose(60, k) if k % 5 else "%%% " + " ".join(f"junk{(k * i) % 13}***" for i in range(60))) for k in range(500)]
    x = spark.createDataFrame(rows, "doc_id long, text string")
    good = spark.createDataFrame([(k, bool(k % 5)) for k in range(0, 500, 2)], "doc_id long, good boolean")
    got = by_id(importance.resample(x, good))
    assert sum(r["kept"] for r in got.values()) == 400 and all(r["kept"] == bool(k % 5) for k, r in got.items())
    half = importance.resample(x, good, share=0.5).where("kept").count()
    assert half == 250
    monkeypatch.setattr(importance.checked, "__defaults__", (1,))  # the way beyond the broadcast
    assert {k: r["kept"] for k, r in by_id(importance.resample(x, good)).items()} == {k: r["kept"] for k, r in got.items()}
    assert len(importance.resample(docs, good).collect()) == len(TEXTS) and importance.resample(none, good).count() == 0


def test_importance_against_plain_counting(spark):
    """Weights by dictionaries of words and pairs, put in the same buckets; the k largest by sorting."""
    texts = [prose(30 + k % 20, k % 60) if k % 4 else prose(25, k) + " \tZap zap, zip" for k in range(300)]
    x = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(importance.resample(x, spark.createDataFrame([(k, bool(k % 4)) for k in range(0, 300, 3)], "doc_id long, good boolean"), share=0.4))

    def grams(t):
        w = t.lower().encode().split()
        h = [int(importance.word_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0]) for x in w]
        one = [int(importance.mix(np.array([a], np.uint64))[0]) for a in h]
        two = [int(importance.mix(np.array([(a * 3 + b) % 2**64], np.uint64))[0]) for a, b in itertools.pairwise(h)]
        return [g % importance.BUCKETS for g in one + two]

    every = [grams(t) for t in texts]
    raw, target = Counter(g for e in every for g in e), Counter(g for k in range(0, 300, 3) if k % 4 for g in every[k])
    p = lambda c, g: (c[g] + 1) / (sum(c.values()) + importance.BUCKETS)
    for k, e in enumerate(every):
        assert abs(got[k]["log_weight"] - sum(np.log(p(target, g)) - np.log(p(raw, g)) for g in e)) < 1e-8
    best = sorted(got.values(), key=lambda r: -r["noisy"])
    assert {r["doc_id"] for r in best[:120]} == {k for k, r in got.items() if r["kept"]}
    noise = np.array([r["noisy"] - r["log_weight"] for r in best])  # Gumbel: mean 0.577, standard deviation 1.28
    assert abs(noise.mean() - 0.577) < 0.25 and abs(noise.std() - 1.28) < 0.25


def test_largest_of_ties(spark):
    x = spark.createDataFrame([(5, t, r) for r, t in enumerate([1, 1, 1, 2, 2])] + [(-7, 0, 9), (8, 0, 10)], "o long, tie long, row long")
    for k in range(9):
        got = x.select("*", importance.among_largest(x, min(k, 7), "o", "tie", "row").alias("kept")).where("kept").collect()
        want = sorted(map(tuple, x.collect()), reverse=True)[:k]
        assert sorted((r["o"], r["tie"], r["row"]) for r in got) == sorted(want)


# ---- line dedup ------------------------------------------------------------


def brute_lines(texts, run, least=None):
    """Per text: number of lines, lines removed, what stays. Places are in the order of the texts."""
    seen, gone = set(), defaultdict(set)
    for k, t in enumerate(texts):
        lines = (t or "").split("\n")
        for i in range(len(lines)):
            for size in {1, 2, run}:
                key = tuple(lines[i : i + size])
                if len(key) < size:
                    continue
                if key in seen and (size == run or (least is not None and size < run and sum(len(x.encode()) for x in key) >= least)):
                    gone[k] |= set(range(i, i + size))
                seen.add(key)
    return [(len((t or "").split("\n")), len(gone[k]), "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone[k])) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("run", "least"), [(1, None), (2, None), (3, None), (5, None), (3, 12)])
def test_line_dedup(spark, docs, none, run, least):
    r = np.random.default_rng(run)
    long = ["\n".join(f"line {x}" for x in r.integers(4, size=n)) for n in (3, 9, 40, 80)]
    texts = [*TEXTS, *long, "\n".join(long), long[3], "unique\n" + long[2][:150], "lone line of some length", "x\nlone line of some length\ny"]
    x = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, rank long").repartition(3)
    got = by_id(line_dedup.line_dedup(x, run, least))
    assert [(got[k]["n_lines"], got[k]["n_removed"], got[k]["kept"]) for k in range(len(texts))] == brute_lines(texts, run, least)
    assert line_dedup.line_dedup(none).count() == 0


def line_table(spark, *texts):
    return spark.createDataFrame([(r, r, k, c, len(c)) for r, t in enumerate(texts) for k, c in enumerate(t)], "row long, doc_id long, pos int, id string, bytes int")


def test_repeated_runs_are_maximal(spark):
    assert [tuple(r) for r in line_dedup.repeated_runs(line_table(spark, "abcde", "xabcdy")).collect()] == [(1, 1, 4, 0, 0)]


def test_intervals_are_those_of_the_suffix_array(spark):
    """Each round's intervals hold the places with a common prefix, and their ranks are in the order of the suffixes."""
    r = np.random.default_rng(8)
    texts = ["".join(r.choice(list("abc"), size=n)) for n in (30, 50, 7)]
    levels = line_dedup.intervals(line_table(spark, *texts), 3)
    for level in levels:
        rows = level.collect()
        size = rows[0]["size"]
        runs = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
        assert {(x["row"], x["pos"]) for x in rows} == {(k, i) for k, t in enumerate(texts) for i in range(len(t) - size + 1) if runs[t[i : i + size]] > 1}
        named = sorted((x["rank"], texts[x["row"]][x["pos"] : x["pos"] + size]) for x in rows)
        assert [a for _, a in named] == sorted(a for _, a in named)
        first = {}
        for k, (rank, run) in enumerate(named):  # a rank counts the places before its interval
            assert rank == first.setdefault(run, k)
    assert [x.first()["size"] for x in levels][:4] == [1, 2, 3, 6]


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = out.persist()
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert final.count() == docs.count() and corpus_pipeline.run(spark, sf).count() == final.count()


def test_toxicity_features_dont_depend_on_neighbours():
    from trackloom.llm import toxicity
    from trackloom.llm.common import text_chunks, word_hashes

    texts = ["ends in a digit 7", "x starts with a letter", "!", "!! you id1ot", "", None, "a", "1", "b. You IDIOT-s", "5"]
    raw = np.frombuffer(b"idiot", np.uint8)
    lexicon = word_hashes(raw, np.array([0]), np.array([5])), np.array([1.5])
    of = lambda limit: np.concatenate([toxicity.features(r, o, lexicon) for _, _, r, o in text_chunks(pa.array(texts), limit)])
    assert np.array_equal(of(1), of(1 << 20)) and np.array_equal(of(1), of(20))


# ---- odd rows --------------------------------------------------------------

BASE = prose(100, 31)
ODD = [
    (None, BASE), (None, None), (None, ""), (4, BASE + " end"), (4, prose(100, 32)), (4, prose(100, 32)), (5, None), (6, "\n\n"), (6, prose(30, 33)), (7, "x " * 600_000), (8, prose(160_000, 34)),
    (9, prose(160_000, 34)), (None, "a\nb\nc\na\nb\nc"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, repeated rows, null and empty texts, texts over 1 MB, and columns named as the operators' own."""
    extra = "row long, source string, size long, block long, label long, n long, spans string, place long, key long, src string, kept string, rank long, good boolean"
    rows = [(d, t, k % 2, "st"[k % 2], 3, 4, 5, 6, "x", 8, 9, "y", "z", 1, False) for k, (d, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}").repartition(3).persist()


def ids(frame, *columns):
    return sorted((tuple(r) for r in frame.select("doc_id", *columns).collect()), key=lambda r: tuple((x is not None, x) for x in r))


IDS = sorted((d for d, _ in ODD), key=lambda d: (d is not None, d))


def test_odd_rows_of_the_jaccard_join(odd):
    classes = brute_classes([t for _, t in ODD])
    least = defaultdict(list)
    for (d, _), (_, c) in zip(ODD, classes, strict=True):
        least[c].append(d)
    want = [(d, n, min((x for x in least[c] if x is not None), default=None)) for (d, _), (n, c) in zip(ODD, classes, strict=True)]
    assert ids(jaccard_join.jaccard_classes(odd), "n_shingles", "component_id") == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == len({c if n else f"r{k}" for k, (n, c) in enumerate(classes)})


def test_odd_rows_of_substring_dedup(odd):
    raw = [(t or "").encode() for _, t in ODD]
    seen = Counter(hash(b[i : i + 400]) for b in raw for i in range(len(b) - 399))
    want = []
    for (d, _), b in zip(ODD, raw, strict=True):
        edge = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 399):
            if seen[hash(b[i : i + 400])] > 1:
                edge[i] += 1
                edge[i + 400] -= 1
        cover = np.cumsum(edge[:-1]) > 0
        want.append((d, len(b), int(cover.sum()), int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum()), len(b) - int(cover.sum())))
    assert ids(substring_dedup.substring_dedup(odd), "n_bytes", "n_removed", "n_spans", "n_kept") == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))


def test_odd_rows_of_line_dedup(odd):
    # Rows with equal doc_ids are in the order read, so only sums are fixed.
    got = line_dedup.line_dedup(odd).collect()
    want = brute_lines([t for _, t in sorted(ODD, key=lambda r: (r[0] is not None, r[0]))], line_dedup.MIN_RUN, line_dedup.MIN_BYTES)
    assert [r[0] for r in sorted(((r["doc_id"],) for r in got), key=lambda r: (r[0] is not None, r[0]))] == IDS
    assert sum(r["n_lines"] for r in got) == sum(w[0] for w in want) and sum(len(r["kept"]) for r in got) == sum(len(w[2]) for w in want)


def test_odd_rows_of_other_operators(spark, odd, library, tmp_path):
    assert ids(importance.resample(odd, spark.createDataFrame([(4, True), (4, True), (6, False), (None, True), (8, None)], "doc_id long, good boolean")))  == [(d,) for d in IDS]
    assert [r[0] for r in ids(bpe_automaton.encode_documents(odd), "n_tokens")] == IDS
    n = Counter((d, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in ODD)
    assert Counter(ids(bpe_automaton.encode_documents(odd), "n_tokens")) == n
    root = f"file://{tmp_path}/ids"
    assert Counter((d, k - 1) for d, k in ids(token_output.read_token_shards(token_output.write_token_shards(odd, root), root), "n_tokens")) == n
    plan = mixing.plan_draws(odd, shards=3)
    assert [r[0] for r in ids(plan)] == IDS and mixing.mix_documents(odd, shards=3).count() == plan.agg(F.sum("draws")).first()[0]
    assert [r[0] for r in ids(exact_dedup.exact_dedup(odd))] == IDS and exact_dedup.keep_one(odd).count() == len({t or "" for _, t in ODD})
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (6, None), (7, 0), (9, 1)], "doc_id long, toxic int")
    for model in (toxicity.fit(odd, labels), toxicity.fit(odd, labels.where("doc_id = 7")), toxicity.fit(odd, labels.where("toxic > 1"))):
        scored = toxicity.score_documents(odd, model)
        assert scored.columns == [*odd.columns, "__toxicity"] and [r[0] for r in ids(scored)] == IDS
        assert all(0 <= r["__toxicity"] <= 1 for r in scored.select("__toxicity").collect())


def test_sql_of_the_queries(spark):
    """The registered queries against their SQL, on the smallest tables."""
    import duckdb

    from trackloom.llm import queries

    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        want = c.sql(sql)
        assert sorted(got.columns) == sorted(want.columns), name
        cols = sorted(got.columns)
        assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, want.select(*cols).fetchall())), name
