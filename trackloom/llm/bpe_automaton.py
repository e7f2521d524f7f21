"""BPE encoding and decoding by a deterministic automaton over tokens.

The automaton is compiled from the merge list, one merge gadget after the other. At first there is
one state, with an arc to itself for each base symbol. The merge (u, v) -> w forbids v right after
u: the state that u's arcs lead to is replaced by a copy without the arc v, and each state with an
arc u gets an arc w to the state that v's arcs lead to. All arcs with one label always lead to one
state, so a state is named by its incoming label, and it is stored as a copy-on-write difference:
the state it was copied from, when, and the arcs removed since. A word's path through the automaton
is unique, and so is the path of each of its prefixes: encoding follows the longest arc and steps
back from positions without one, each at most once. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import kept, settle
from trackloom.llm.word_pieces import END, Memo, byte_chars, cuts, latin, parts, pre_tokens, spec, words_in

ARC_ENTRIES = 250_000


class MergeAutomaton:
    """States and arcs for a vocabulary and its ordered merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.label = {i: t for t, i in vocab.items()}
        n = max(vocab.values()) + 1
        #: When a token's arcs were made, as the index of its merge; base symbols: -1.
        self.born = [-1] * n
        #: The halves that a token was merged of: its first arcs are copies of the left half's arcs, its state a copy of the right half's.
        self.left, self.right = [-1] * n, [-1] * n
        #: (u, v) -> when the arc v was removed from the state of u.
        self.removed: dict[tuple[int, int], int] = {}
        self.vocab = vocab
        for t, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if (u, v) in self.removed or self.left[w] >= 0 or not self._arc(u, v, t):
                continue  # no state has such a path: the gadget adds nothing
            self.born[w], self.left[w], self.right[w] = t, u, v
            self.removed[u, v] = t
        self._arcs: dict[tuple[int, int], bool] = {}
        #: Labels with arcs: the base symbols and what a gadget has made.
        self.labels = {t: i for t, i in vocab.items() if self.born[i] >= 0 or len(t.removesuffix(END) or t) == 1}
        #: The labels as a transition table by character: node[char] -> node, node["" or END] -> label.
        self.table: dict = {}
        for label, i in self.labels.items():
            node = self.table
            for c in label.removesuffix(END) or label:
                node = node.setdefault(c, {})
            node[END if label.endswith(END) and label != END else ""] = i

    def _arc(self, u: int, v: int, now: int) -> bool:
        """Is there an arc v at the state of u just before merge `now`?

        Walks back in time: the younger of both labels was a copy, of the right half's state or of
        the left half's arcs; on the way the arc must not have been removed.
        """
        while True:
            gone = self.removed.get((u, v))
            if gone is not None and gone < now:
                return False
            bu, bv = self.born[u], self.born[v]
            if bu < 0 and bv < 0:
                return True
            if bu >= bv:
                # The gadget copies the right half's state as it was before its removals.
                if bu == bv and u == v and self.left[u] == self.right[u]:
                    return True
                u, now = (self.right[u], bu) if bu > bv else (u, now)
                if bu == bv:  # both are the label of one merge
                    u, v, now = self.right[u], self.left[v], bu
            else:
                # Arcs of the new label go to states that have the left half's arc after this gadget's removal.
                v, now = self.left[v], bv + 1

    def arc(self, u: int, v: int) -> bool:
        """May v follow u?"""
        key = (u, v)
        out = self._arcs.get(key)
        if out is None:
            if len(self._arcs) >= ARC_ENTRIES:
                self._arcs.clear()
            out = self._arcs[key] = self._arc(u, v, 1 << 60)
        return out

    def _arcs_at(self, symbols: str, i: int) -> list[tuple[int, int]]:
        """(end, label) of the labels that read on from position i, shortest first."""
        out, node = [], self.table
        n = len(symbols)
        for j in range(i, n):
            node = node.get(symbols[j])
            if node is None:
                return out
            t = node.get("" if j + 1 < n else END)
            if t is not None:
                out.append((j + 1, t))
        return out

    def encode(self, symbols: str) -> list[int]:
        """Labels on the path of a word, given as byte characters without the word end."""
        n, arc = len(symbols), self.arc
        path: list[int] = []
        at, todo = [0], [self._arcs_at(symbols, 0)]
        dead: set[int] = set()
        while at[-1] < n:
            options = todo[-1]
            while options:
                j, t = options.pop()
                if j not in dead and (not path or arc(path[-1], t)):
                    path.append(t)
                    at.append(j)
                    todo.append(self._arcs_at(symbols, j))
                    break
            else:
                if not path:
                    raise ValueError(f"no path for {symbols!r}")
                dead.add(at.pop())
                todo.pop()
                path.pop()
        return path


@kept
def automaton(path: str) -> MergeAutomaton:
    vocab, merges, _ = spec(path)
    return MergeAutomaton(vocab, merges)


class Codec:
    """Encodes whole texts and decodes ids with the automaton of a tokenizer file."""

    def __init__(self, path: str):
        self.machine = automaton(path)
        self.special = spec(path)[2]
        self.path = path
        self.chars = byte_chars()
        self.words = Memo(self._symbols, 60_000)
        self.memo = Memo(self._cut)

    def _symbols(self, symbols: str) -> tuple[str, str]:
        ids = self.machine.encode(symbols)
        label = self.machine.label
        return " ".join(map(str, ids)), " ".join([label[i] for i in ids])

    def _cut(self, cut: str) -> tuple[str, str]:
        words = words_in(cut)
        if len(words) == 1:
            return self._symbols(self._bytes(cut))
        got = [self.words[self._bytes(w)] for w in words]
        return " ".join([a for a, _ in got]), " ".join([b for _, b in got])

    def _bytes(self, word: str) -> str:
        if word.isascii():  # printable ones stand for themselves
            return word if word.isprintable() else "".join([self.chars[b] for b in word.encode()])
        return "".join([self.chars[b] for b in word.encode()])

    def run(self, text: str) -> tuple[str, str]:
        """Decimal ids joined by spaces, and the decoded text: arc labels joined by spaces."""
        got = []
        for special, part in parts(text):
            if special:
                got.append((str(self.special[part]), part))
            elif latin(part):
                got += map(self.memo.__getitem__, cuts(part))
            else:
                got += map(self.words.__getitem__, pre_tokens(part, self.path))
        return " ".join([a for a, _ in got]), " ".join([b for _, b in got])

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.run(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        names = {i: s for s, i in self.special.items()}
        return " ".join(names.get(i) or self.machine.label[i] for i in ids)


@kept
def codec(path: str) -> Codec:
    return Codec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None, texts: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with texts=True ids (list) and decoded.

    A null text is an empty one: no ids, and an empty decoded text. doc_id may be null or repeat;
    extra columns are ignored; an empty table gives no rows.
    """
    settle(docs.sparkSession)
    path = path or default_path()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts

    def run(batches):
        import hashlib

        machine = codec(path)
        for batch in batches:
            ids_of, n, ids, dec, raw, out = batch.column(0), [], [], [], [], []
            for x in batch.column(1):
                a, b = machine.run(x.as_py() or "")
                n.append(a.count(" ") + 1 if a else 0)
                ids.append(hashlib.sha256(a.encode()).hexdigest())
                dec.append(hashlib.sha256(b.encode()).hexdigest())
                if texts:
                    raw.append([int(i) for i in a.split()])
                    out.append(b)
            yield pa.RecordBatch.from_arrays([ids_of, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(dec, pa.string()), *((pa.array(raw, pa.list_(pa.int32())), pa.array(out, pa.string())) if texts else ())], names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
