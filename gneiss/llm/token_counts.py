"""Operator 7: exact BPE token counts by rank-synchronous array merging.

Pre-tokens that a task has not seen yet are laid out as one ragged numpy array of symbol
ids. In each round every sequence finds the lowest rank among its adjacent pairs, and all
occurrences of that pair (left to right, not overlapping) merge at once; sequences without
a mergeable pair leave. What survives is counted. Counts of pre-tokens are memoised per
task in a table of bounded size, so a text costs one lookup per pre-token.

Results: null text counts as empty (0 bytes, 0 tokens); special strings inside a text count
one token each, as the tokenizer's default has it; nothing is truncated. Repeated rows count
alike, an empty table gives no rows, and columns that clash with the new ones give way. Counts
equal the library's on every code point."""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gneiss.llm.common import map_rows

#: Entries of the per-task table of pre-token counts before it starts anew.
MEMO = 400_000
_NONE = np.iinfo(np.int64).max
# Capitals that Unicode 16 added, which Python's tables may lack, with their small letters.
_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}
_NEW_CAPITAL = re.compile("[" + "".join(map(chr, _CAPITALS)) + "]")


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


@functools.cache
def _plain_finder(pattern: str):
    """``(odd, findall)``: a faster equal of the pattern for texts in which ``odd`` finds nothing.

    The standard library's classes differ from the pattern's Unicode classes on a few
    characters; those below U+0250 are listed by comparing both, and any text with a character
    from there on takes the exact pattern."""
    text, odd = "".join(map(chr, range(0x250))), set()
    for exact, plain in [(r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s"), (r"[^\s\p{L}\p{N}]", r"[^\w\s]|_")]:
        odd |= set(regex.findall(exact, text)) ^ set(re.findall(plain, text))
    quick = pattern.replace(r"[^\s\p{L}\p{N}]+", r"(?:[^\w\s]|_)+").replace(r"[\p{L}]+", r"[^\W\d_]+").replace(r"[\p{N}]", r"\d")
    if r"\p" in quick:
        return None
    return re.compile("[" + "".join(map(re.escape, sorted(odd))) + "\u0250-\U0010ffff]").search, re.compile(quick).findall


@functools.cache
def _exact_finder(pattern: str):
    """``(odd, findall)``: the pattern for texts in which ``odd`` finds a character that has no
    category, though the regular expression library takes it for a letter or a number."""
    planes = "".join(map(chr, range(0x20000, 0x110000)))
    wrong = [c for c in regex.findall(r"[\p{L}\p{N}\s]", planes) if unicodedata.category(c) == "Cn" and ord(c) >= 0x323B0]
    if not wrong:
        return None
    odd = "[" + "".join(wrong) + "]"
    exact = pattern.replace(r"[^\s\p{L}\p{N}]+", rf"(?:[^\s\p{{L}}\p{{N}}]|{odd})+").replace(r"[\p{L}]+", rf"(?:(?!{odd})\p{{L}})+").replace(r"[\p{N}]", rf"(?!{odd})\p{{N}}")
    return re.compile(odd).search, regex.compile(exact).findall


class TokenCounter:
    """Counts tokens of texts for a BPE tokenizer file with byte-level symbols."""

    def __init__(self, path: str, memo: int = MEMO):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        vocab = dict(model["vocab"])
        self.base = max(vocab.values()) + 1
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.quick = _plain_finder(split["pattern"]["Regex"])
        self.exact = _exact_finder(split["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.memo: dict[str, int] = {}
        self.memo_size = memo

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """Normalised pre-tokens of a text, and how many special tokens stood in it."""
        parts = self.special.split(text) if "<|" in text else [text]
        found: list[str] = []
        for part in parts:
            # White space runs become one space before the split, which drops it anyway.
            plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            if not plain.isascii() and _NEW_CAPITAL.search(plain):
                plain = plain.translate(_CAPITALS)
            odd, find = self.quick or (None, self.find)
            if odd and odd(plain):
                wrong, exact = self.exact or (None, self.find)
                find = exact if wrong and wrong(plain) else self.find
            found += find(plain)
        return found, len(parts) - 1

    def merge(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each (non-empty) pre-token."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(length)
        ids = self.inner[data]
        ids[ends - 1] = self.last[data[ends - 1]]
        seq, total = np.repeat(np.arange(len(raw)), length), length.copy()
        while len(ids) > 1:
            key = ids[:-1] * self.base + ids[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.where((self.keys[at] == key) & (seq[:-1] == seq[1:]), self.ranks[at], _NONE)
            rank = np.append(rank, _NONE)
            starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            low = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(ids)))
            total[seq[starts]] = sizes
            lowest = np.repeat(low, sizes)
            take = (rank == lowest) & (lowest != _NONE)
            if not take.any():
                break
            where = np.flatnonzero(take)
            # In a run of overlapping matches ("aaa") every second one is taken, from the left.
            first = np.append(True, np.diff(where) > 1)
            begin = np.maximum.accumulate(np.where(first, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - begin) % 2 == 0]
            ids[where] = self.made[at[where]]
            stay = lowest != _NONE
            stay[where + 1] = False
            np.subtract.at(total, seq[where], 1)
            ids, seq = ids[stay], seq[stay]
        return total

    def count(self, texts: list[str | None]) -> list[int]:
        split = [self.pretokens(t) if t else ([], 0) for t in texts]
        if len(self.memo) > self.memo_size:
            self.memo.clear()
        memo = self.memo
        new = list({w for words, _ in split for w in words if w not in memo})
        if new:
            memo.update(zip(new, self.merge(new).tolist(), strict=True))
        return [sum(map(memo.__getitem__, words)) + extra for words, extra in split]


@functools.cache
def counter_of(tokenizer: str) -> TokenCounter:
    """One counter, and so one memo, per Python worker."""
    return TokenCounter(tokenizer)


def count_tokens(
    df: DataFrame,
    tokenizer: str,
    limit: int = 2048,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Columns ``keep`` with n_bytes, n_tokens and over_limit (n_tokens > ``limit``)."""
    fields = [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    ]

    def factory():
        counter = counter_of(tokenizer)

        def fn(texts):
            n = counter.count(texts)
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            return size, n, [x > limit for x in n]

        return fn

    return map_rows(df, [text_col], keep, fields, factory)
