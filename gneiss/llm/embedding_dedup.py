"""Operator 9: near-duplicate embeddings by cross-polytope hashing.

A vector is padded to a power of two, and for every hash its signs are flipped and a fast
Hadamard transform applied three times (a pseudo-random rotation); the hash is the place and
sign of the largest coordinate. ``hashes`` of them make a bucket's code; each of ``tables``
tables also puts the vector into the bucket reached by the runner-up coordinate of its least
certain hash (multiprobe). Equal vectors form one class, and classes that meet in a bucket are
compared by cosine in double precision. A pair is counted in the first bucket that it shares.

Vectors are hashed once. Buckets are counted by their codes, and only vectors that share a
bucket are sent to it. Buckets of more than BLOCK members are cut into blocks, and pairs of
blocks go to different tasks, so no task holds an unbounded bucket, nothing is dropped, and no
pair leaves a task: a block gives link counts and a spanning star only.

``hashes`` is a parameter, the same for tables of every size: more of them make buckets of
unrelated vectors smaller (64 dimensions: 128 ** hashes buckets a table), and ``tables`` follows from it and
the dimension so that a pair at the cosine 0.9 is found with a probability of 0.97.

Null or zero vectors, and vectors with null or non-finite components, link with nothing; so
do rows without an id (their component is null). Vectors of different lengths never link. Rows
that repeat an id count as equal or different vectors like any others. Other columns are not
read."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.common import col, cut, expand_rows, shuffle_width
from gneiss.llm.components import components
from gneiss.llm.ngram_join import _runs

COSINE = 0.9
BLOCK = 512
HASHES = 3
#: Shared buckets that are broadcast at most, as (table, code, blocks); beyond that they are joined.
MAX_BROADCAST = 500_000
SEED = 20240501


def tables_for(hashes: int, dimensions: int) -> int:
    """Tables that find a pair at the cosine 0.9 with a probability of 0.97 at least, by a fit to
    measured shares of single tables (1 to 4 hashes, 64 to 1,024 dimensions)."""
    size = 1 << max(1, (dimensions - 1).bit_length())
    return math.ceil(2.6 * 2.25 ** (hashes - 1) * max(1.0, size / 64) ** (0.08 * (hashes + 1)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The unnormalised Walsh-Hadamard transform of each row."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def bucket_codes(v: np.ndarray, tables: int, hashes: int) -> np.ndarray:
    """For each unit vector its 2 * tables codes: per table the own bucket's and the probed one's."""
    size = 1 << max(1, (v.shape[1] - 1).bit_length())
    padded = np.zeros((len(v), size))
    padded[:, : v.shape[1]] = v
    out = np.zeros((len(v), 2 * tables), np.uint64)
    rows = np.arange(len(v))
    for t in range(tables):
        rng = np.random.Generator(np.random.PCG64([SEED, t, size]))
        own, other, gap = [], [], []
        for _ in range(hashes):
            x = padded
            for _ in range(3):
                x = hadamard(x * rng.choice([-1.0, 1.0], size)) / math.sqrt(size)
            a = np.abs(x)
            one = a.argmax(axis=1)
            high = a[rows, one]
            a[rows, one] = -1.0
            two = a.argmax(axis=1)
            own.append((2 * one + (x[rows, one] > 0)).astype(np.uint64))
            other.append((2 * two + (x[rows, two] > 0)).astype(np.uint64))
            gap.append(high - a[rows, two])
        weak = np.argmin(np.array(gap), axis=0)
        with np.errstate(over="ignore"):
            for h in range(hashes):
                out[:, 2 * t] = out[:, 2 * t] * np.uint64(2 * size) + own[h]
                out[:, 2 * t + 1] = out[:, 2 * t + 1] * np.uint64(2 * size) + np.where(weak == h, other[h], own[h])
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit rows in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _prints(kind: str):
    """A row per vector: id, fingerprint, length and bytes; nulls for vectors that link with nothing."""

    def fn(ids, vectors):
        out = [[None] * len(ids) for _ in range(3)]
        for r, v in enumerate(vectors):
            if v is None or not len(v) or any(c is None for c in v):
                continue
            x = np.array(v, kind) + 0.0
            if np.isfinite(x).all() and x.any():
                out[0][r] = int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True)
                out[1][r], out[2][r] = len(x), x.tobytes()
        return [ids, *out]

    return fn


def _code_kind(width: int, hashes: int) -> str:
    """The number type that holds the codes of vectors of a length."""
    return "<u4" if (2 << max(1, (width - 1).bit_length())) ** hashes <= 1 << 32 else "<u8"


def _hashed(kind: str, tables: int | None, hashes: int):
    def fn(reps, weights, widths, blobs):
        codes = [b""] * len(reps)
        for width in set(widths):
            part = [k for k, w in enumerate(widths) if w == width]
            v = _unit(np.frombuffer(b"".join(blobs[k] for k in part), kind).reshape(len(part), -1))
            found = bucket_codes(v, tables or tables_for(hashes, width), hashes).astype(_code_kind(width, hashes))
            for k, own in zip(part, found, strict=True):
                codes[k] = own.tobytes()
        return reps, weights, widths, blobs, codes

    return fn


def _bucket_rows(hashes: int):
    """(length and table, code, vector) of the buckets of each vector."""

    def fn(reps, widths, codes):
        tables, found, who = [], [], []
        for rep, width, raw in zip(reps, widths, codes, strict=True):
            own = np.frombuffer(raw, _code_kind(width, hashes)).reshape(-1, 2)
            twice = own[:, 0] == own[:, 1]
            place = np.repeat(np.arange(len(own)), 2)[np.stack([~twice, np.ones(len(own), bool)], axis=1).ravel()]
            tables.append((width << 16) + place)
            found.append(own[np.stack([~twice, np.ones(len(own), bool)], axis=1)].astype(np.uint64).view(np.int64))
            who.append(np.full(len(place), rep))
        return [np.concatenate(x) if x else x for x in (tables, found, who)]

    return fn


def _compare(cosine: float, kind: str, hashes: int):
    """Link counts and spanning stars of blocks; input sorted by (table, code, pair of blocks)."""

    def run(batches):
        made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for table, code, _, rep, weight, blob, own, half in _runs(batches, 3):
            width, at_table = int(table[0]) >> 16, int(table[0]) & 0xFFFF
            v = _unit(np.frombuffer(b"".join(blob), kind).reshape(len(rep), -1))
            codes = np.frombuffer(b"".join(own), _code_kind(width, hashes)).reshape(len(rep), -1, 2)
            mine = np.int64(code[0]).astype(np.uint64).astype(codes.dtype)
            a, b = np.flatnonzero(half != 1), np.flatnonzero(half != 0)
            within = bool((half == 2).all())
            count, low = np.zeros(len(rep), np.int64), rep.copy()
            edges_a, edges_b = [], []
            for at in range(0, len(a), 256):
                x = a[at : at + 256]
                i, j = np.nonzero(v[x] @ v[b].T >= cosine)
                i, j = x[i], b[j]
                i, j = (i[i < j], j[i < j]) if within else (i, j)
                first = _first_here(codes, i, j, at_table, mine)
                i, j = i[first], j[first]
                np.add.at(count, i, weight[j])
                np.add.at(count, j, weight[i])
                edges_a.append(i)
                edges_b.append(j)
            if not sum(map(len, edges_a)):
                continue
            i, j = np.concatenate(edges_a), np.concatenate(edges_b)
            while True:
                before = low.copy()
                np.minimum.at(low, i, low[j])
                np.minimum.at(low, j, low[i])
                if (before == low).all():
                    break
            hit = np.flatnonzero(count)
            made.append((rep[hit], count[hit], low[hit]))
            held += len(hit)
            if held > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made, strict=True)], names=["rep", "links", "low"])
                made, held = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made, strict=True)], names=["rep", "links", "low"])

    return run


def _first_here(codes: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, code) -> np.ndarray:
    """Which pairs share no bucket of an earlier table, and none of this one with a smaller code."""
    out = np.ones(len(i), bool)
    for at in range(0, len(i), 20_000):
        p, q = codes[i[at : at + 20_000], : table + 1], codes[j[at : at + 20_000], : table + 1]
        meet = p[:, :, :, None] == q[:, :, None, :]
        earlier = meet[:, :table].any(axis=(1, 2, 3))
        lower = (meet[:, table].any(axis=2) & (p[:, table] < code)).any(axis=1)
        out[at : at + 20_000] = ~(earlier | lower)
    return out


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, hashes: int = HASHES, tables: int | None = None
) -> DataFrame:
    """One row per row of ``df``: id, n_links, component_id, kept. ``tables`` is
    :func:`tables_for` each vector's length unless it is given."""
    long, binary, spread = T.LongType(), T.BinaryType(), shuffle_width(df.sparkSession)
    single = isinstance(df.schema[vector_col].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"
    src = df.select(col(id_col).cast("long").alias("i"), col(vector_col).alias("v"))
    fields = lambda **kinds: [T.StructField(n, k) for n, k in kinds.items()]
    rows = cut(expand_rows(src, ["i", "v"], fields(i=long, f1=long, wd=T.IntegerType(), u=binary), lambda: _prints(kind)))
    usable = rows.filter("f1 is not null and i is not null")
    # Two vectors may share an id, so a class goes by its fingerprint.
    classes = usable.groupBy("f1").agg(F.min("i").alias("rep"), F.count(F.lit(1)).alias("w"), F.first("wd").alias("wd"), F.first("u").alias("u"))
    classes = cut(classes)
    hashed = expand_rows(
        classes.select(F.col("f1").alias("node"), "w", "wd", "u"), ["node", "w", "wd", "u"],
        fields(node=long, w=long, wd=T.IntegerType(), u=binary, own=binary), lambda: _hashed(kind, tables, hashes),
    )
    hashed = cut(hashed)
    light = expand_rows(hashed, ["node", "wd", "own"], fields(table=long, code=long, node=long), lambda: _bucket_rows(hashes))
    shared = light.groupBy("table", "code").agg(F.count(F.lit(1)).alias("g")).filter("g > 1")
    shared = cut(shared.select("table", "code", F.ceil(F.col("g") / BLOCK).cast("int").alias("blocks")))
    known = F.broadcast(shared) if shared.count() <= MAX_BROADCAST else shared
    members = light.join(known, ["table", "code"]).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "table", "code", (F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")).cast("long").alias("pair"), "node",
        F.when(F.col("mine") < F.col("other"), 0).when(F.col("mine") > F.col("other"), 1).otherwise(2).alias("half"),
    )
    full = members.join(hashed.select("node", "w", "u", "own"), "node").select("table", "code", "pair", "node", "w", "u", "own", "half")
    ready = full.repartition(spread, "table", "code", "pair").sortWithinPartitions("table", "code", "pair")
    found = cut(ready.mapInArrow(_compare(cosine, kind, hashes), "rep long, links long, low long"))
    links = found.groupBy(F.col("rep").alias("f1")).agg(F.sum("links").alias("links"))
    part = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "f1")
    named = cut(classes.select("f1", "rep", "w").join(links, "f1", "left").join(part, "f1", "left"))
    named = named.withColumn("component", F.coalesce("component", "f1"))
    reps = named.groupBy("component").agg(F.min("rep").alias("least"))
    per_class = cut(named.join(reps, "component").select("f1", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.col("least").alias("component_id")))
    out = rows.select("i", "f1").join(per_class, "f1", "left")
    good = F.col("i").isNotNull() & F.col("component_id").isNotNull()
    component = F.when(good, F.col("component_id")).otherwise(F.col("i"))
    return out.select(
        F.col("i").alias(id_col), F.when(good, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("i"), F.lit(False)).alias("kept"),
    )
