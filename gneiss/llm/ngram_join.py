"""Operator 3: exact Jaccard self-join on word 5-grams, as connected components.

A text's set holds the 64-bit hashes of its distinct shingles. Equal sets become one class, and
only classes are joined. Sets are not stored, as they are larger than their texts: shingling is
vectorised over batches of texts, and done again for prefixes and for candidates. Tokens
are ordered from rare to frequent by a count sketch over every text of the table; any two sets
with 100 * |A & B| >= 80 * |A | B| share a token among the first |A| - ceil(0.8 |A|) + 1 of
either (prefix filter), so the prefixes form inverted lists.

Index lists are skipped in blocks. A list is sorted by set size and, within a size, by the
token's position, and cut into blocks that know their sizes and smallest position; a probing
set tests the blocks first, and no pair is made for a block whose sizes or positions rule a
link out. In short lists every member probes, in long ones the leader (the smallest position,
so the fewest tokens of its own).

Answers are derived from those of a similar set. Each link keeps its intersection, and sets
that link with a leader follow it with a known difference. Long lists with one component are
finished. In the others followers are folded into their leader's entry, and only leaders of
different components are compared. From |L & M| of two leaders that do not link, the
intersection of their followers R and S is at most |L & M| + |R - L| + |S - M|; only pairs that
this bound leaves are compared themselves. Every link is verified on whole sets, and what is
left out cannot link or is connected already, so the components are exact (up to collisions
of 64-bit hashes).

Null, empty or wordless texts have an empty set and link with nothing. Texts of fewer than five
words have one shingle, the whole sequence. Repeated rows are links. Rows that share a doc_id
count as one document, which links as any of its texts does. Rows without a doc_id have no
component, though others may be linked through their text. Other columns are not read."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.common import col, cut, expand_rows, give_back, map_rows, shuffle_width
from gneiss.llm.components import components

WORDS = 5
SIMILARITY = 0.8
#: Counters of the frequency sketch, the same at every size.
SKETCH = 1 << 20
SLICE = 1 << 14
#: Lists up to this length are compared pair by pair; longer ones through their leader.
SHORT = 16
#: Entries of a block that is skipped as a whole.
SKIP = 16
#: Members of a block of a long list, and of a salted part of a very frequent token's list.
BLOCK = 2048
#: Partners of a set that are verified in one task.
PARTNERS = 256
#: Rows that a semi-join broadcasts at most; beyond that it shuffles.
MAX_BROADCAST_ROWS = 1_000_000
#: Bytes of text that are hashed at once, but for longer words.
CHUNK = 1 << 20
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


@functools.cache
def _byte_numbers() -> np.ndarray:
    """A random odd number for each byte; none for white space."""
    table = np.random.Generator(np.random.PCG64(17)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.where(_SPACE, np.uint64(0), table)


@functools.cache
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.append(np.uint64(1), np.full(n - 1, 0xA0761D6478BD642F, np.uint64)), dtype=np.uint64)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of lower-case text, and where each begins."""
    data = np.frombuffer(raw, np.uint8)
    space = _SPACE[data]
    begin = np.flatnonzero(~space & np.append(True, space[:-1])) if len(data) else np.zeros(0, np.int64)
    out = np.zeros(len(begin), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(begin):
            to = max(at + 1, int(np.searchsorted(begin, begin[at] + CHUNK)))
            first, last = int(begin[at]), int(begin[to]) if to < len(begin) else len(data)
            heads = begin[at:to] - first
            size = np.diff(np.append(heads, last - first))
            place = np.arange(last - first) - np.repeat(heads, size)
            powers = _powers(1 << max(6, int(size.max() - 1).bit_length()))
            out[at:to] = np.add.reduceat(_byte_numbers()[data[first:last]] * powers[place], heads)
            at = to
        return _finish(out * _FACTORS[0]), begin


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    x, begin = word_hashes(b" ".join(raw))
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    cuts = np.searchsorted(begin, np.append(0, np.cumsum(size))).tolist()
    with np.errstate(over="ignore"):
        grams = np.full(max(0, len(x) - WORDS + 1), WORDS, np.uint64)
        for i in range(WORDS if len(grams) else 0):
            grams = _finish(grams ^ x[i : len(x) - WORDS + 1 + i]) * _FACTORS[i]
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a >= WORDS:
                h = np.sort(grams[a : b - WORDS + 1])
                out.append(h[np.append(True, h[1:] != h[:-1])])
            else:
                h = np.full(min(1, b - a), b - a, np.uint64)
                for i in range(a, b):
                    h = _finish(h ^ x[i]) * _FACTORS[i - a]
                out.append(h)
    return out


def least_overlap(a, b, similarity: float):
    """The smallest intersection that links sets of these sizes (whole numbers, exact)."""
    p = round(100 * similarity)
    return -(-p * (a + b) // (100 + p))


def _print(s: np.ndarray) -> int | None:
    """The class of a set; none for the empty one."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None


class _Profiles:
    """A row per text; at the end of the partition its slices of the sketch."""

    def __init__(self):
        self.counts = np.zeros(SKETCH, np.int64)

    def __call__(self, ids, texts):
        sets = shingle_sets(texts)
        self.counts += np.bincount((np.concatenate(sets) >> np.uint64(44)).astype(np.int64), minlength=SKETCH)
        none = [None] * len(ids)
        return ids, [len(s) for s in sets], list(map(_print, sets)), none, none

    def finish(self):
        rows = [(i, self.counts[i * SLICE : (i + 1) * SLICE]) for i in range(SKETCH // SLICE)]
        rows = [(i, c.astype("<i8").tobytes()) for i, c in rows if c.any()]
        none = [None] * len(rows)
        return none, none, none, [r[0] for r in rows], [r[1] for r in rows]


def _sum_slices(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            total[i] = total.get(i, 0) + np.frombuffer(c, "<i8")
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.astype("<i8").tobytes() for c in total.values()], pa.binary())], names=["slice", "counts"])


def _sketch(profiles: DataFrame) -> np.ndarray:
    """Token counts of the whole table by hash slot; a fixed 8 MB."""
    slices = profiles.filter("slice is not null").select("slice", "counts")
    summed = slices.repartition(SKETCH // SLICE, "slice").mapInArrow(_sum_slices, "slice int, counts binary")
    out = np.zeros(SKETCH, np.int64)
    for i, c in summed.collect():
        out[i * SLICE : (i + 1) * SLICE] = np.frombuffer(c, "<i8")
    return out


def prefix(s: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The rarest tokens that a set has to share with any partner, and their counts."""
    keep = len(s) - -(-round(100 * similarity) * len(s) // 100) + 1
    c = counts[(s >> np.uint64(44)).astype(np.int64)]
    order = np.argsort(c, kind="stable")[:keep]
    return s[order], c[order]


class _Sets:
    """(print, id, set) of texts with words; a text that a task has seen is mostly left out."""

    def __init__(self):
        self.seen: set[tuple[int, int | None]] = set()

    def of(self, ids, texts):
        if len(self.seen) > 500_000:
            self.seen.clear()
        for i, s in zip(ids, shingle_sets(texts), strict=True):
            key = _print(s), i
            if len(s) and key not in self.seen:
                self.seen.add(key)
                yield *key, s

    def __call__(self, ids, texts):
        found = [(f, i, s.tobytes()) for f, i, s in self.of(ids, texts)]
        return list(zip(*found, strict=True)) if found else [[], [], []]


class _Prefixes(_Sets):
    """(print, id, set size, prefix tokens, salts) of texts with words."""

    def __init__(self, counts: np.ndarray, similarity: float):
        super().__init__()
        self.counts, self.usual, self.similarity = counts, int(np.median(counts)), similarity

    def __call__(self, ids, texts):
        out = []
        for f, i, s in self.of(ids, texts):
            p, c = prefix(s, self.counts, self.similarity)
            # A frequent token's list is dealt to parts; all of them are looked at again.
            parts = np.maximum(0, c - self.usual) // BLOCK
            salt = np.where(parts > 0, (f * 0x9E3779B97F4A7C15 >> 33 & 0x3FFFFFFF) % (parts + 1), -1)
            out.append((f, i, len(s), p.view(np.int64), salt.astype(np.int32)))
        return list(zip(*out, strict=True)) if out else [[] for _ in range(5)]


def _bounds(n, pos, m, other, similarity):
    """Whether a first common token at these positions leaves enough to link."""
    return np.minimum(n - pos, m - other) >= least_overlap(n, m, similarity)


def _may_link(n, pos, least, most, first, similarity):
    """Whether a block with these sizes and this smallest position may hold a partner."""
    p = round(100 * similarity)
    fits = (100 * least <= -(-100 * 100 * n // p)) & (100 * most >= p * n)
    return fits & (np.minimum(n - pos, most - first) >= least_overlap(n, least, similarity))


def _ramp(sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _runs(batches, keys: int = 2):
    """Whole runs of more than one row with equal first columns, as lists of arrays."""
    for cols, starts in _whole(batches, keys):
        ends = np.append(starts[1:], len(cols[0]))
        some = ends - starts > 1
        for at, end in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
            yield [c[at:end] for c in cols]


def _whole(batches, keys: int = 2):
    """Columns of sorted batches, cut so that no run of equal first columns is parted, and where
    the runs begin."""

    def heads(cols):
        change = np.zeros(len(cols[0]) - 1, bool)
        for c in cols[:keys]:
            change |= c[1:] != c[:-1]
        return np.flatnonzero(change) + 1

    def ready():
        done = [np.concatenate(c) for c in zip(*held, strict=True)]
        return done, np.append(0, heads(done))

    held: list[list[np.ndarray]] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        new = heads(cols)
        if last is not None and [c[0] for c in cols[:keys]] != last:
            new = np.append(0, new)
        last = [c[-1] for c in cols[:keys]]
        if len(new):
            held.append([c[: new[-1]] for c in cols])
            yield ready()
            held = [[c[new[-1] :] for c in cols]]
        else:
            held.append(cols)
    if held:
        yield ready()
    held = []
    give_back()


def probe(n, pos, probes, first, count, similarity: float):
    """(prober, partner) places that may link. ``n`` and ``pos`` are lists one after the other,
    each sorted by size and position; probe k tests the ``count[k]`` entries from ``first[k]``
    on, block by block, before any pair is made."""
    blocks = -(-count // SKIP)
    at = np.repeat(first, blocks) + SKIP * _ramp(blocks)
    end = np.minimum(at + SKIP, np.repeat(first + count, blocks))
    who = np.repeat(probes, blocks)
    if not len(at):
        return who, at
    lowest = np.minimum.reduceat(np.append(pos, 0), np.stack([at, end], axis=1).ravel())[::2]
    stay = _may_link(n[who], pos[who], n[at], n[end - 1], lowest, similarity)
    who, at, size = who[stay], at[stay], (end - at)[stay]
    who, at = np.repeat(who, size), np.repeat(at, size) + _ramp(size)
    fits = (who != at) & _bounds(n[who], pos[who], n[at], pos[at], similarity)
    return who[fits], at[fits]


def _lists(similarity: float):
    """Candidates (kind 0: a, b) and members of lists to look at again (kind 1); input sorted by
    (token, salt, n, pos)."""

    def run(batches):
        for (token, salt, node, n, pos), starts in _whole(batches):
            g = np.diff(np.append(starts, len(token)))
            hot = salt[starts] >= 0
            short = (g > 1) & (g <= SHORT)
            long = g > SHORT
            # In a short list each member probes those behind it; in a long one the leader all.
            where, size = starts[short], g[short]
            turn = _ramp(size)
            mine = np.repeat(where, size) + turn
            i, j = probe(n, pos, mine, mine + 1, np.repeat(size, size) - turn - 1, similarity)
            if long.any():
                lead = np.array([a + int(np.lexsort((node[a : a + k], n[a : a + k], pos[a : a + k]))[0]) for a, k in zip(starts[long].tolist(), g[long].tolist(), strict=True)])
                x, y = probe(n, pos, lead, starts[long], g[long], similarity)
                i, j = np.concatenate([i, x]), np.concatenate([j, y])
            pairs = np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])])
            pairs = np.unique(pairs[:, pairs[0] < pairs[1]], axis=1)
            for at in range(0, pairs.shape[1], 50_000):
                a, b = pairs[:, at : at + 50_000]
                yield _batch(np.zeros(len(a), np.int32), np.zeros(len(a), np.int64), a, b, np.zeros(len(a), np.int32), np.zeros(len(a), np.int32))
            again = np.repeat(long | hot, g)
            if again.any():
                yield _batch(np.ones(int(again.sum()), np.int32), token[again], node[again], node[again], n[again], pos[again])

    return run


def _batch(*cols, names=("kind", "token", "a", "b", "n", "pos")):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=list(names))


def _across(similarity: float):
    """Pairs of leaders from different components that share a block of a long list; the key is
    (token, block). An entry stands for a leader's followers in the list, with their smallest
    and largest size and their smallest position."""

    def run(batches):
        for token, _, lead, comp, least, most, pos, half in _runs(batches):
            a, b = np.flatnonzero(half != 1), np.flatnonzero(half != 0)
            b = b[np.argsort(least[b], kind="stable")]
            ceiling = np.maximum.accumulate(most[b])
            found = []
            for at in range(0, len(a), 256):
                x = a[at : at + 256]
                # Sorted by size, whole stretches of partners are skipped.
                p = round(100 * similarity)
                lo = np.searchsorted(ceiling, p * least[x].min() // 100)
                hi = np.searchsorted(least[b], -(-100 * most[x].max() // p), "right")
                y = b[lo:hi]
                common = np.minimum((most - pos)[x][:, None], (most - pos)[y][None])
                ok = (comp[x][:, None] != comp[y][None]) & (common >= least_overlap(least[x][:, None], least[y][None], similarity))
                i, j = np.nonzero(ok)
                found.append(np.stack([np.minimum(lead[x[i]], lead[y[j]]), np.maximum(lead[x[i]], lead[y[j]])]))
            pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
            for at in range(0, pairs.shape[1], 50_000):
                yield _batch(*pairs[:, at : at + 50_000], names=("a", "b"))

    return run


def _small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


class _Classes:
    """The classes (node, f, rep, n) of a table's texts, and their sets on demand."""

    def __init__(self, docs: DataFrame, rows: DataFrame):
        found = cut(rows.filter("f is not null").groupBy("f").agg(F.min("i").alias("rep"), F.min("n").alias("n")))
        # Small numbers make small shuffles; the checkpoint keeps them as they are.
        self.docs, self.table = docs, found.withColumn("node", F.monotonically_increasing_id())

    def sets(self, ids: DataFrame) -> DataFrame:
        """(node, s) for some nodes; a repeated row may give its set again."""
        wanted = cut(self.table.join(_small(ids), "node", "left_semi").select("node", "f", "rep"))
        reps = _small(cut(wanted.select("rep").distinct()))
        texts = self.docs.join(reps, F.col("i").eqNullSafe(F.col("rep")), "left_semi")
        fields = [T.StructField("f", T.LongType()), T.StructField("i", T.LongType()), T.StructField("s", T.BinaryType())]
        made = expand_rows(texts, ["i", "t"], fields, _Sets)
        return made.join(_small(wanted.withColumnRenamed("f", "_f")), (F.col("f") == F.col("_f")) & F.col("i").eqNullSafe(F.col("rep"))).select("node", "s")


def _compared(pairs: DataFrame, classes: _Classes, similarity: float, every: bool = False) -> DataFrame:
    """(a, b, o, na, nb) of the pairs that link, or of all: o is the intersection. A set goes to a
    task once for up to PARTNERS partners, and with more partners to several tasks."""
    pairs = cut(pairs.distinct())
    ids = cut(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    needed = cut(classes.sets(ids))
    parts = cut(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("parts")))
    theirs = pairs.join(_small(parts), "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    theirs = theirs.join(needed.withColumnRenamed("node", "b"), "b").select("a", "part", "b", F.lit(1).alias("turn"), "s")
    own = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(needed.withColumnRenamed("node", "a"), "a")
    both = theirs.unionByName(own.select("a", "part", F.col("a").alias("b"), F.lit(0).alias("turn"), "s"))
    ready = both.repartition(shuffle_width(pairs.sparkSession), "a", "part").sortWithinPartitions("a", "part", "turn")

    def check(batches):
        q, out = np.zeros(0, np.uint64), []
        for batch in batches:
            for a, _, b, turn, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                s = np.frombuffer(raw, np.uint64)
                if not turn:
                    q = s
                    continue
                n, m = len(q), len(s)
                if not every and 100 * min(n, m) < round(100 * similarity) * max(n, m):
                    continue
                at = np.searchsorted(q, s)
                at[at == n] = 0
                o = int((q[at] == s).sum())
                if every or o >= least_overlap(n, m, similarity):
                    out.append((a, b, o, n, m))
            if out:
                yield _batch(*np.array(out, np.int64).T, names=("a", "b", "o", "na", "nb"))
                out = []
        give_back()

    return ready.mapInArrow(check, "a long, b long, o long, na long, nb long")


def _followers(links: DataFrame) -> DataFrame:
    """(node, leader, extra): sets that follow a leader, and how many tokens the leader lacks. A
    leader is smaller than all that it links with; whoever's smallest partner is one follows it."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("to"), "o", F.col("na").alias("n"))
    both = both.unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("to"), "o", F.col("nb").alias("n")))
    best = cut(both.groupBy("node").agg(F.min(F.struct("to", "o", "n")).alias("x")).select("node", F.col("x.to").alias("leader"), (F.col("x.n") - F.col("x.o")).alias("extra")))
    chiefs = best.filter("leader > node").select(F.col("node").alias("leader"))
    return cut(best.filter("leader < node").join(chiefs, "leader", "left_semi").select("node", "leader", "extra"))


def _late_links(again: DataFrame, links: DataFrame, classes: _Classes, similarity: float, spread: int) -> DataFrame:
    """The links that connect components across long lists: (a, b)."""
    part = cut(components(links))
    members = _followers(links)
    entries = again.join(part.select("node", "component"), "node", "left").join(members, "node", "left")
    entries = cut(entries.select("token", F.coalesce("leader", "node").alias("leader"), F.coalesce("component", "node").alias("component"), "n", "pos"))
    open_lists = entries.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token")
    # Followers fold into their leader; the sizes of a fold are within one bucket of size.
    bucket = F.floor(F.log(F.col("n")) / F.log(F.lit(1 / similarity)) + 1e-9).cast("int")
    folded = entries.join(_small(cut(open_lists)), "token", "left_semi").withColumn("bucket", bucket).groupBy("token", "bucket", "leader", "component")
    folded = cut(folded.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("pos").alias("pos")))
    held = cut(folded.groupBy("token", "bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    # Sizes that link are in one bucket or in neighbours, so an entry meets its own bucket's and the next one's blocks.
    own = folded.withColumn("up", F.lit(0)).unionByName(folded.withColumn("up", F.lit(1)))
    there = held.withColumn("up", F.lit(0)).unionByName(held.withColumn("bucket", F.col("bucket") - 1).withColumn("up", F.lit(1)))
    there = there.withColumnRenamed("blocks", "theirs")
    here = _small(held.select("token", "bucket", "blocks"))
    lower = own.join(here, ["token", "bucket"]).join(_small(there), ["token", "bucket", "up"])
    mine = F.pmod(F.xxhash64("leader"), F.col("blocks")).cast("int")
    target = ["token", "key", "leader", "component", "least", "most", "pos", "half"]
    block_key = lambda low, x, y: F.xxhash64("token", low, "up", x, y)
    lower = lower.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)))
    same = F.when(F.col("mine") < F.col("other"), 0).when(F.col("mine") > F.col("other"), 1).otherwise(2)
    lower = lower.withColumn("half", F.when(F.col("up") == 1, 0).otherwise(same)).withColumn(
        "key", F.when(F.col("up") == 1, block_key("bucket", "mine", "other")).otherwise(block_key("bucket", F.least("mine", "other"), F.greatest("mine", "other")))
    ).select(*target)
    below = _small(held.select("token", (F.col("bucket") + 1).alias("bucket"), F.col("blocks").alias("theirs")))
    upper = folded.withColumn("up", F.lit(1)).join(here, ["token", "bucket"]).join(below, ["token", "bucket"])
    upper = upper.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1))).withColumn("half", F.lit(1))
    upper = upper.withColumn("key", block_key(F.col("bucket") - 1, "other", "mine")).select(*target)
    blocks = lower.unionByName(upper).repartition(spread, "token", "key").sortWithinPartitions("token", "key")
    leaders = blocks.mapInArrow(_across(similarity), "a long, b long")
    known = cut(_compared(leaders, classes, similarity, every=True))
    linked = known.filter(_links(F.col("o"), F.col("na"), F.col("nb"), similarity)).select("a", "b")
    # Followers of leaders that do not link, as far as the difference to the leader lets them.
    group = members.join(classes.table.select("node", "n"), "node").select("leader", F.col("node").alias("x"), "extra", "n")
    alone = known.select(F.col("a").alias("leader"), F.col("na").alias("n")).unionByName(known.select(F.col("b").alias("leader"), F.col("nb").alias("n"))).distinct()
    group = cut(group.unionByName(alone.select("leader", F.col("leader").alias("x"), F.lit(0).cast("long").alias("extra"), "n")))
    reach = cut(group.groupBy("leader").agg(F.max("extra").alias("far"), F.min("n").alias("small"), F.count(F.lit(1)).alias("g")))
    apart = known.join(linked, ["a", "b"], "left_anti")
    side = lambda k: reach.select(F.col("leader").alias(k), F.col("far").alias("far_" + k), F.col("small").alias("small_" + k), F.col("g").alias("g_" + k))
    near = apart.join(side("a"), "a").join(side("b"), "b").filter("g_a * g_b > 1")
    near = cut(near.filter(_links(F.col("o") + F.col("far_a") + F.col("far_b"), F.col("small_a"), F.col("small_b"), similarity)).select("a", "b", "o"))
    one = group.select(F.col("leader").alias("a"), F.col("x").alias("r"), F.col("extra").alias("ea"), F.col("n").alias("nr"))
    two = group.select(F.col("leader").alias("b"), F.col("x").alias("t"), F.col("extra").alias("eb"), F.col("n").alias("nt"))
    derived = near.join(one, "a").join(two, "b").filter(_links(F.col("o") + F.col("ea") + F.col("eb"), F.col("nr"), F.col("nt"), similarity) & ((F.col("r") != F.col("a")) | (F.col("t") != F.col("b"))))
    derived = derived.select(F.least("r", "t").alias("a"), F.greatest("r", "t").alias("b"))
    return linked.unionByName(_compared(derived, classes, similarity).select("a", "b"))


def _links(o, n, m, similarity: float):
    """Whether an intersection (at most ``o``) links sets of these sizes (at least)."""
    p = round(100 * similarity)
    return ((100 + p) * o >= p * (n + m)) & (100 * F.least(n, m) >= 0)


def linked_classes(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """For texts (i, t): rows (i, n, f) with the print of each row's set (null: empty), and
    (f, component, rep): the classes' components, and the smallest id of each component."""
    spark, long = docs.sparkSession, T.LongType()
    fields = [
        T.StructField("i", long), T.StructField("n", long), T.StructField("f", long), T.StructField("slice", T.IntegerType()), T.StructField("counts", T.BinaryType()),
    ]
    profiles = cut(expand_rows(docs, ["i", "t"], fields, _Profiles))
    counts = spark.sparkContext.broadcast(_sketch(profiles))
    rows = profiles.filter("slice is null").select("i", "n", "f")
    classes = _Classes(docs, rows)
    fields = [
        T.StructField("f", long), T.StructField("i", long), T.StructField("n", T.IntegerType()), T.StructField("tokens", T.ArrayType(long)), T.StructField("salts", T.ArrayType(T.IntegerType())),
    ]
    made = expand_rows(docs, ["i", "t"], fields, lambda: _Prefixes(counts.value, similarity))
    named = classes.table.select(F.col("f").alias("_f"), "rep", "node")
    made = made.join(_small(named), (F.col("f") == F.col("_f")) & F.col("i").eqNullSafe(F.col("rep"))).select("node", "n", F.posexplode(F.arrays_zip("tokens", "salts")).alias("pos", "x"))
    spread = shuffle_width(spark)
    postings = made.select(F.col("x.tokens").alias("token"), F.col("x.salts").alias("salt"), "node", "n", "pos")
    lists = postings.repartition(spread, "token", "salt").sortWithinPartitions("token", "salt", "n", "pos")
    found = cut(lists.mapInArrow(_lists(similarity), "kind int, token long, a long, b long, n int, pos int"))
    links = cut(_compared(found.filter("kind = 0").select("a", "b"), classes, similarity))
    again = found.filter("kind = 1").select("token", F.col("a").alias("node"), "n", "pos").distinct()
    late = _late_links(again, links, classes, similarity, spread)
    # Texts that share an id are one document's.
    several = cut(rows.filter("i is not null and f is not null").groupBy("i").agg(F.min("f").alias("a"), F.max("f").alias("b")).filter("a <> b").select("i", F.col("a").alias("first")))
    shared = rows.join(_small(several), "i").filter("f <> first").select("first", "f").distinct()
    number = lambda name, to: classes.table.select(F.col("f").alias(name), F.col("node").alias(to))
    shared = shared.join(number("first", "a"), "first").join(number("f", "b"), "f").select("a", "b")
    part = components(cut(links.select("a", "b").unionByName(late).unionByName(shared)))
    named = cut(classes.table.join(part, "node", "left").select("f", F.coalesce("component", "node").alias("component"), "rep"))
    reps = named.groupBy("component").agg(F.min("rep").alias("rep"))
    return rows, cut(named.select("f", "component").join(_small(cut(reps)), "component"))


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id."""
    docs = df.select(col(id_col).cast("long").alias("i"), col(text_col).alias("t"))
    rows, named = linked_classes(docs, similarity)
    found = rows.join(named, "f", "left")
    own = F.when(F.col("i").isNotNull(), F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("i")))
    return found.select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` with one row of each component: the one with the smallest id, of rows
    that share it the smallest, and where no row has an id the smallest row. Empty texts stay."""
    rows, named = linked_classes(df.select(col(id_col).cast("long").alias("i"), col(text_col).alias("t")), similarity)
    found = cut(rows.join(named, "f", "left"))
    columns, key = [col(c) for c in df.columns], col(id_col).cast("long")
    ident, node, by = (_free(df, n) for n in ("_id", "_node", "_by"))
    full = found.filter("n > 0")
    chosen = full.filter("i = rep").groupBy(F.col("i").alias(ident)).agg(F.count(F.lit(1)).alias("_rows"))
    # An empty text has its own row even where its id has other texts.
    empty = found.filter("n = 0 and i is not null").select(F.col("i").alias(ident)).distinct()
    blank = col(text_col).isNull() | ~col(text_col).rlike(r"[^\x20\x09-\x0D]")
    of = lambda rows, ids: rows.join(_small(cut(ids.select(ident))), key == F.col(ident), "left_semi")
    out = of(df.filter(~blank), chosen.filter("_rows = 1")).unionByName(of(df.filter(blank), empty))
    whole = F.struct(*[col(c).alias(f"_{n}") for n, c in enumerate(df.columns)])
    first = lambda rows: rows.groupBy(by).agg(F.min("_whole").alias("_whole")).select(*[F.col(f"_whole._{n}").alias(c) for n, c in enumerate(df.columns)])
    out = out.unionByName(first(of(df.filter(~blank), chosen.filter("_rows > 1")).select(key.alias(by), whole.alias("_whole"))))
    none = map_rows(df.filter(col(id_col).isNull()), [text_col], df.columns, [T.StructField(node, T.LongType())], lambda: lambda texts: ([_print(s) for s in shingle_sets(texts)],))
    out = out.unionByName(none.filter(F.col(node).isNull()).select(*columns))
    alone = none.join(named.filter("rep is null").select(F.col("f").alias(node), F.col("component").alias(by)), node)
    return out.unionByName(first(alone.select(by, whole.alias("_whole"))))


def _free(df: DataFrame, name: str) -> str:
    """A name like this one that no column has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
