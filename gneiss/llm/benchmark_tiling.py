"""Operator 8: benchmark decontamination by greedy string tiling.

Texts and benchmark items become word sequences (lower case, ASCII punctuation dropped).
Karp-Rabin hashes of every run of MIN_MATCH words are joined with those of the items; each
hit is checked word by word, and hits on one diagonal join into maximal matches. For a text
and an item that share a match, the longest match is marked again and again, cut down to what
is still unmarked on both sides, until none of MIN_MATCH words is left. The tiles' share of
the item is its coverage, so a passage counts even if its parts stand in another order. An
item shorter than MIN_MATCH words has to occur whole; an item without words is never found.

Null and empty texts give no rows; repeated texts and items each give their own; items without
text are never found. Rows without an id, or that share one, are judged by their own text. The
item index is broadcast while it has at most MAX_WORDS words; beyond that the items are worked
through in as many passes as it takes, each within the bound (an item that has more by itself
gets a pass of its own). Ties between matches go to the earlier place in the item, then in the
text. Other columns are not read."""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.common import col, cut, expand_rows, map_rows, words_of

MIN_MATCH = 5
COVERAGE = 0.5
#: Words of benchmark items that one pass holds in each worker.
MAX_WORDS = 2_000_000
#: Hits of seeds that are looked at together in one text.
HITS = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _number(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class _Numbers(dict):
    def __missing__(self, word):
        if len(self) > 100_000:
            self.clear()
        self[word] = n = _number(word)
        return n


def rolling(x: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n numbers, modulo 2**64."""
    if len(x) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(x) - n + 1, np.uint64)
        for i in range(n):
            h = h * _BASE + x[i : len(x) - n + 1 + i]
    return h


@dataclass
class Items:
    """Benchmark items and the sorted hashes of their seeds, by seed length."""

    ids: list[int]
    words: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: list[int], texts: list[str | None], least: int = MIN_MATCH) -> "Items":
        words = [np.array([_number(w) for w in words_of(t)], np.uint64) for t in texts]
        found: dict[int, list] = {}
        for k, w in enumerate(words):
            if n := min(least, len(w)):
                h = rolling(w, n)
                found.setdefault(n, []).append((h, np.full(len(h), k), np.arange(len(h))))
        seeds = {}
        for n, parts in found.items():
            h, k, p = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            seeds[n] = (h[order], k[order], p[order])
        return cls(ids, words, seeds)


def tile(matches: list[tuple[int, int, int]], n_text: int, n_item: int, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (text place, item place, length) of the tiles, from maximal matches.

    Longest first; ties go to the earlier place in the item, then in the text."""
    used_t, used_i, tiles = {}, bytearray(n_item), []
    queue = [(-n, i, t) for t, i, n in matches]
    heapq.heapify(queue)
    while queue:
        n, i, t = heapq.heappop(queue)
        n = -n
        free, run = [], 0
        for x in range(n + 1):
            if x < n and not used_i[i + x] and t + x not in used_t:
                run += 1
                continue
            if run >= least:
                free.append((x - run, run))
            run = 0
        if free == [(0, n)]:
            tiles.append((t, i, n))
            for x in range(n):
                used_i[i + x] = 1
                used_t[t + x] = True
        else:
            for at, size in free:
                heapq.heappush(queue, (-size, i + at, t + at))
    return tiles


class Tiler:
    def __init__(self, items: Items, coverage: float):
        self.items, self.coverage, self.numbers = items, coverage, _Numbers()
        self.sizes = np.array([len(w) for w in items.words], np.int64)

    def _hits(self, x: np.ndarray, n: int):
        """(item, item place, text place) of the seeds of n words in items that their number of
        hits lets reach the coverage."""
        keys, which, place = self.items.seeds[n]
        h = rolling(x, n)
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        t = np.flatnonzero(keys[at] == h)
        if not len(t):
            return
        lo = at[t]
        g = np.searchsorted(keys, h[t], "right") - lo
        total = np.cumsum(g)
        cuts = [0, *np.searchsorted(total, np.arange(HITS, total[-1], HITS)).tolist(), len(t)]
        slices = [slice(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
        expand = lambda s: (np.repeat(lo[s], g[s]) + np.arange(int(g[s].sum())) - np.repeat(np.cumsum(g[s]) - g[s], g[s]), np.repeat(t[s], g[s]))
        count = np.zeros(len(self.sizes), np.int64)
        for s in slices:
            count += np.bincount(which[expand(s)[0]], minlength=len(count))
        enough = n * count >= self.coverage * self.sizes
        for s in slices:
            seed, text = expand(s)
            stay = enough[which[seed]]
            yield which[seed[stay]], place[seed[stay]], text[stay]

    def text(self, text: str | None) -> list[tuple[int, int, int, int, int, float]]:
        """(item id, tiles, longest, covered words, item words, coverage) for the items found."""
        numbers, items, out = self.numbers, self.items, []
        x = np.array([numbers[w] for w in words_of(text)], np.uint64)
        for n in items.seeds:
            found = list(self._hits(x, n))
            if not found:
                continue
            k, i, t = (np.concatenate(c) for c in zip(*found, strict=True))
            true = np.ones(len(k), bool)
            for at in range(n):  # a hash is no proof
                true &= x[t + at] == self.flat[self.starts[k] + i + at]
            k, i, t = k[true], i[true], t[true]
            order = np.lexsort((i, t - i, k))
            k, i, d = k[order], i[order], (t - i)[order]
            # Hits on one diagonal, one after the other, are a maximal match.
            head = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1))) if len(k) else np.zeros(0, np.int64)
            size = np.diff(np.append(head, len(k))) + n - 1
            edge = np.flatnonzero(np.append(True, k[head][1:] != k[head][:-1])) if len(head) else head
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(head)], strict=False):
                item, h = int(k[head[a]]), head[a:b]
                whole = int(self.sizes[item])
                tiles = tile(list(zip((i[h] + d[h]).tolist(), i[h].tolist(), size[a:b].tolist(), strict=True)), len(x), whole, n)
                covered = sum(m for _, _, m in tiles)
                if tiles and covered >= self.coverage * whole:
                    out.append((items.ids[item], len(tiles), max(m for _, _, m in tiles), covered, whole, covered / whole, item))
        return [r[:-1] for r in sorted(out, key=lambda r: r[-1])]

    @functools.cached_property
    def flat(self) -> np.ndarray:
        return np.concatenate(self.items.words) if self.items.words else np.zeros(0, np.uint64)

    @functools.cached_property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


def _passes(benchmark: DataFrame, item_col: str, text_col: str, max_words: int) -> Iterator[Items]:
    """The items in parts of at most ``max_words`` words, one after the other."""
    items = benchmark.select(col(item_col).cast("long").alias("i"), col(text_col).alias("t")).filter("t is not null")
    counted = map_rows(items, ["t"], ["i", "t"], [T.StructField("n", T.LongType())], lambda: lambda texts: ([len(words_of(t)) for t in texts],))
    counted = cut(counted.withColumn("row", F.xxhash64(F.monotonically_increasing_id())))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, 64 * -(-int(total) // max_words)) if total > max_words else 1
    sizes = counted.groupBy(F.pmod("row", F.lit(buckets)).alias("b")).agg(F.sum("n").alias("n")).collect()  # 64 numbers a pass
    parts: list[tuple[int, list[int]]] = []
    for b, n in sorted((r["b"], r["n"]) for r in sizes):
        if parts and parts[-1][0] + n <= max_words:
            parts[-1] = parts[-1][0] + n, [*parts[-1][1], b]
        else:
            parts.append((n, [b]))
    for _, wanted in parts or [(0, [])]:
        rows = counted.filter(F.pmod("row", F.lit(buckets)).isin(wanted)).select("i", "t").collect()  # within max_words words
        yield Items.of([r["i"] for r in rows], [r["t"] for r in rows])


def find_contamination(
    df: DataFrame,
    benchmark: DataFrame,
    coverage: float = COVERAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """One row for each text and item whose coverage reaches ``coverage``: id, item id, n_tiles,
    longest_tile, covered_words, item_words, coverage."""
    sc = df.sparkSession.sparkContext
    fields = [
        T.StructField(id_col, df.schema[id_col].dataType),
        T.StructField(item_col, T.LongType()),
        T.StructField("n_tiles", T.IntegerType()),
        T.StructField("longest_tile", T.IntegerType()),
        T.StructField("covered_words", T.IntegerType()),
        T.StructField("item_words", T.IntegerType()),
        T.StructField("coverage", T.DoubleType()),
    ]
    out = None
    for part in _passes(benchmark, item_col, item_text_col, max_words):
        shared = sc.broadcast(part)

        def factory(shared=shared):
            tiler = Tiler(shared.value, coverage)

            def fn(ids, texts):
                found = [(i, *r) for i, t in zip(ids, texts, strict=True) for r in tiler.text(t)]
                return list(zip(*found, strict=True)) if found else [[] for _ in fields]

            return fn

        made = expand_rows(df, [id_col, text_col], fields, factory)
        out = made if out is None else out.unionByName(made)
    return out


def remove_contaminated(
    df: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_words: int = MAX_WORDS
) -> DataFrame:
    """The rows of ``df`` whose own text reaches no item's coverage, whatever their id."""
    out = df
    for part in _passes(benchmark, item_col, item_text_col, max_words):
        shared = df.sparkSession.sparkContext.broadcast(part)

        def factory(shared=shared):
            tiler = Tiler(shared.value, coverage)
            return lambda texts: ([not tiler.text(t) for t in texts],)

        out = map_rows(out, [text_col], df.columns, [T.StructField("_clean", T.BooleanType())], factory).filter("_clean").select(*[col(c) for c in df.columns])
    return out
