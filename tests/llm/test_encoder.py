"""op8's encoder against the tokenizers library."""

import random

from trackloom.llm import token_output
from trackloom.llm.word_pieces import library

SIGNS = [chr(c) for c in range(1, 256)] + ["é", "日", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL"]


def texts(n, seed):
    r = random.Random(seed)
    return ["", " \n", *(" ".join("".join(r.choices(SIGNS, k=r.randrange(1, 9))) + "Word" * r.randrange(3) for _ in range(r.randrange(1, 30))) for _ in range(n))]


def test_ids_are_the_librarys():
    path = token_output.default_path()
    enc, lib = token_output.Encoder(path), library(path)
    enc.memo.entries = 50  # generations change within a batch
    for seed in range(4):
        some = texts(60, seed) + texts(60, 0)
        for t, got in zip(some, enc.batch(some), strict=True):
            assert got.tolist() == lib.encode(t, add_special_tokens=False).ids, ascii(t)


def test_each_cut_is_looked_up_once_a_batch_and_long_ones_are_not_kept():
    enc = token_output.Encoder(token_output.default_path())
    long = "x" * 5000
    first = enc.batch(["one two three two " + long, long + " one"])
    assert sorted(enc.memo) == ["one", "three", "two"]
    asked = []

    class Watched(type(enc.memo)):
        def get(self, cut, *other):
            asked.append(cut)
            return super().get(cut, *other)

    memo = Watched(enc.memo.make)
    memo.update(enc.memo)
    enc.memo = memo
    assert [a.tolist() for a in enc.batch(["one two three two " + long, long + " one"])] == [a.tolist() for a in first]
    assert sorted(asked) == sorted({"one", "two", "three", long})
