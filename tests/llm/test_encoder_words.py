"""op8's encoder: each distinct word is encoded once, whatever stands beside it."""

import random

import numpy as np

from trackloom.llm import token_output, word_pieces


def test_words_are_encoded_once_whatever_stands_beside_them(monkeypatch):
    enc = token_output.Encoder(token_output.default_path())
    asked, many = [], enc._many
    monkeypatch.setattr(enc, "_many", lambda some: asked.extend(some) or many(some))
    some = ["zorblique, Zorblique. (zorblique)", "zorblique's zorblique;", "\xa0ZORBLIQUE\x85zorblique ", "zorblique!!"]
    got = [g.tolist() for _ in range(2) for g in enc.batch(some)]
    assert got == [enc.lib.encode(t, add_special_tokens=False).ids for t in some] * 2
    assert sorted(asked) == sorted({"zorblique", ",", ".", "(", ")", "'s", ";", "!!"})


def test_chunks_end_between_words(monkeypatch):
    monkeypatch.setattr(token_output, "CHUNK", 7)
    enc = token_output.Encoder(token_output.default_path())
    some = ["", "one two  threefourfive\tsix", "seven", " ", "日本 eight", "nine<|endoftext|>ten eleven's <|ENDOFTEXT|>", "x" * 40 + " y'll", ""]
    assert [g.tolist() for g in enc.batch(some)] == [enc.lib.encode(t, add_special_tokens=False).ids for t in some]
    assert enc.batch([]) == [] and [g.tolist() for g in enc.batch(["日本"])] == [enc.lib.encode("日本", add_special_tokens=False).ids]


def test_words_at_is_the_pattern():
    r = random.Random(5)
    signs = [*"'''srvteldm1 .\n", "'s", "'ll", *map(chr, range(256))]
    for _ in range(4000):
        text = "".join(r.choices(signs[:17] if r.random() < 0.7 else signs, k=r.randrange(1, 14)))
        raw = text.encode("latin-1").translate(word_pieces.LOWER)
        on, first = word_pieces.words_at(np.frombuffer(raw, np.uint8))
        solid, at = np.frombuffer(raw, np.uint8)[on], np.append(np.flatnonzero(first[on]), on.sum())
        got = [solid[a:b].tobytes().decode("latin-1") for a, b in zip(at, at[1:], strict=False)]
        assert got == [w for c in word_pieces.cuts(text) for w in word_pieces.words_in(c)], ascii(text)
