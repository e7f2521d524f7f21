"""Splitting whole texts into pre-tokens as public_tokenizers' word_bpe_49k.json does, with a memo by word.

The file's normaliser (NFC, white space to one space, lower case) and its split pattern never join
characters across white space, so a text is cut at white space first and each distinct cut is
handled once; a bounded memo holds the outcome. That is done for texts within Latin-1, where every
Unicode version agrees on letters, digits and cases; others go through the tokenizers library's own
normaliser and pre-tokeniser.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

from trackloom.llm.common import kept

#: Entries of each of the two generations of a worker's memo.
MEMO_ENTRIES = 150_000
#: A cut longer than this isn't kept in the memo.
MEMO_CHARS = 64
#: The mark of a label that ends a word.
END = "</w>"
SPECIAL = regex.compile(r"<\|startoftext\|>|<\|endoftext\|>")
# The split pattern and special tokens of word_bpe_49k.json.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
_SPACE = regex.compile(r"[^\p{White_Space}]+")
#: str.split() takes these for white space; the pattern doesn't.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Latin-1 bytes in lower case, and their kinds: white space, letter, number, other.
LOWER = bytes(ord(chr(c).lower()) for c in range(256))
_WHITE, _LETTER, _NUMBER, _OTHER = range(4)
_KIND = np.array([next(k for k, p in enumerate((r"\p{White_Space}", r"\p{L}", r"\p{N}", ".")) if regex.fullmatch(p, chr(c), regex.DOTALL)) for c in range(256)], np.uint8)


@kept
def spec(path: str) -> tuple[dict[str, int], list[tuple[str, str]], dict[str, int]]:
    """Vocabulary, merges in order and special tokens of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in j["model"]["merges"]]
    return j["model"]["vocab"], merges, {t["content"]: t["id"] for t in j["added_tokens"]}


@lru_cache(maxsize=1)
def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = [""] * 256
    for b in plain:
        out[b] = chr(b)
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[b] = chr(256 + k)
    return out


def latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def cuts(text: str) -> list[str]:
    """A Latin-1 text in lower case, cut at white space."""
    text = text.lower()
    if any(c in text for c in _SEPARATORS):
        return _SPACE.findall(text)
    return text.split()


@kept
def library(path: str):
    """The file as the tokenizers library reads it."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def for_words(path: str):
    """library() for words_in() joined by spaces: nothing is normalised or cut further, and what reads like a special token in lower case is none."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

    t = Tokenizer.from_str(library(path).to_str())
    t.normalizer = None
    t.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
    t.encode_special_tokens = True
    return t


def pre_tokens(text: str, path: str) -> list[str]:
    """Pre-tokens in byte characters, by the library's own normaliser and pre-tokeniser."""
    t = library(path)
    return [w for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))]


class Memo(dict):
    """cut -> make(cut). Two generations of at most `entries` each; the older one is forgotten."""

    def __init__(self, make: Callable[[str], object], entries: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, cut: str):
        out = self.old.get(cut)
        if out is None:
            out = self.make(cut)
        if len(cut) <= MEMO_CHARS:
            self.put(cut, out)
        return out

    def put(self, cut: str, out) -> None:
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[cut] = out


def words_in(cut: str) -> list[str]:
    """Pre-tokens of a Latin-1 cut."""
    if cut.isalpha():
        return [cut]
    if cut[:-1].isalpha() and cut[-1] in ".,!?;:":
        return [cut[:-1], cut[-1]]
    return PATTERN.findall(cut)


def words_at(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """words_in() of all cuts of Latin-1 bytes in lower case: which bytes are no white space, and which begin a word."""
    kind = _KIND[raw]
    on = kind != _WHITE
    first = on.copy()
    first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    # A run of "'" alone takes s, t, m, d, re, ve or ll with it.
    at = np.flatnonzero((raw == ord("'")) & first)
    if len(at):
        after = np.concatenate([raw, np.zeros(3, np.uint8)])
        a, b = after[at + 1], after[at + 2]
        size = np.isin(a, list(b"stmd")) + 2 * (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        at, size = at[size > 0], size[size > 0]
        first[at + 1] = False
        rest = at + 1 + size
        rest = rest[rest < len(raw)]
        first[rest] = on[rest]
    return on, first


def parts(text: str) -> list[tuple[bool, str]]:
    """The text cut at special tokens: (is it one, string)."""
    if "<|" not in text:
        return [(False, text)]
    out, at = [], 0
    for m in SPECIAL.finditer(text):
        out += [(False, text[at : m.start()]), (True, m[0])]
        at = m.end()
    return [*out, (False, text[at:])]
