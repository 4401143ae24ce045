"""Operator 1: shards cut from a Hilbert curve over metadata, in DataFrame operations only.

Each metadata dimension is quantised to 2**bits bins: ``width`` by equal steps between the
column's smallest and largest number, ``log2`` by the number's bit length, ``prefix`` by
equal steps over the first six bytes of a string. The bins are the coordinates of a Hilbert
curve (Skilling's transform); rows sorted along it and cut into runs of equal length make
shards whose files have narrow ranges in every dimension, so range filters on any of them
skip files.

Rows are not ranked over the table, a shard or a cell: a cell of the curve is cut into sub-cells of about
ROWS rows by a mixed id, rows are counted per sub-cell, sub-cells are summed up per block of the
curve, blocks over the whole, and a row's place is the sum of those offsets and its rank in its
own sub-cell. Only rows that are equal in id stay in one sub-cell whatever their number. The law is
``rows``: shard sizes differ by at most one. A null in a dimension is bin 0, a null id sub-cell 0;
a null text has no bytes (size 1, crc32 0); rows that are equal in all that is ordered by take
neighbouring places; an empty table has no shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import col

BITS = 4
#: Rows that a sub-cell has on average at most.
ROWS = 4096
SHARDS = 16
#: Curve cells (a fixed number of blocks at any size) whose counts are added up together.
BLOCK_BITS = 8
DIMENSIONS = (("lang", "prefix"), ("source", "prefix"), ("n_chars", "log2"), ("doc_id", "width"))


def _key(name: str, kind: str) -> Column:
    if kind == "prefix":
        return F.conv(F.rpad(F.substring(F.hex(col(name).cast("string")), 1, 12), 12, "0"), 16, 10).cast("long")
    return col(name).cast("long")


def bins(df: DataFrame, dimensions, bits: int = BITS) -> list[Column]:
    """The bin of every dimension; two numbers a dimension are read from the table first."""
    wide = [(n, k) for n, k in dimensions if k != "log2"]
    ends = [x for n, k in wide for x in (F.min(_key(n, k)), F.max(_key(n, k)))]
    got = list(df.agg(*ends).first()) if ends else []
    span = {n: (got[2 * i], got[2 * i + 1]) for i, (n, _) in enumerate(wide)}
    top, out = (1 << bits) - 1, []
    for n, k in dimensions:
        if k == "log2":
            b = F.when(_key(n, k) > 0, F.least(F.length(F.bin(_key(n, k))), F.lit(top)))
        else:
            lo, hi = (x if x is not None else 0 for x in span[n])
            step = (_key(n, k).cast("double") - F.lit(float(lo))) / F.lit(float(hi) - float(lo) + 1.0)
            b = F.least(F.floor(step * (top + 1)).cast("int"), F.lit(top))
        out.append(F.coalesce(b.cast("int"), F.lit(0)))
    return out


def hilbert(df: DataFrame, coordinates: list[Column], name: str, bits: int = BITS) -> DataFrame:
    """``df`` with the Hilbert index of the coordinates (each under 2**bits) as ``name``."""
    n, top = len(coordinates), 1 << (bits - 1)
    q, at = f"shiftright({top}, cast(s div {n} as int))", f"cast(s % {n} as int)"
    turn = f"""aggregate(sequence(0, {n * (bits - 1) - 1}), x, (x, s) -> transform(x, (v, j) -> CASE
        WHEN (x[{at}] & {q}) <> 0 THEN IF(j = 0, v ^ ({q} - 1), v)
        WHEN j = 0 OR j = {at} THEN v ^ ((x[0] ^ x[{at}]) & ({q} - 1))
        ELSE v END))""" if bits > 1 else "x"
    gray = "transform(x, (v, i) -> aggregate(slice(x, 1, i + 1), 0, (a, b) -> a ^ b))"
    flip = f"aggregate(sequence(0, {bits - 1}), 0, (t, k) -> IF((x[{n - 1}] & shiftleft(1, k)) <> 0, t ^ (shiftleft(1, k) - 1), t))"
    index = f"aggregate(sequence(0, {n * bits - 1}), 0L, (a, k) -> a * 2 + (shiftright(x[cast(k % {n} as int)] ^ t, {bits - 1} - cast(k div {n} as int)) & 1))"
    # Each step names its input once, as the one element of an array, so the plan stays small.
    whole = f"""transform(array(_x), x -> {turn})"""
    whole = f"transform({whole}, x -> {gray})"
    whole = f"transform({whole}, x -> transform(array({flip}), t -> {index})[0])[0]"
    return df.withColumn("_x", F.array(*coordinates)).withColumn(name, F.expr(whole)).drop("_x")


def _mixed(id_col: str) -> Column:
    """A number that spreads ids evenly, whatever their spacing (a step of a Lehmer generator)."""
    prime = F.lit((1 << 31) - 1).cast("long")
    return F.pmod(F.pmod(col(id_col).cast("long"), prime) * 48271, prime)


def shard(
    df: DataFrame,
    shards: int = SHARDS,
    dimensions=DIMENSIONS,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: int = BITS,
    whole: bool = False,
) -> DataFrame:
    """One row per row: id, size, text_crc32, law, shard, slot, grown_shard (null), curve; with
    ``whole`` also the row itself as the struct ``row``."""
    where = hilbert(df, bins(df, dimensions, bits), "_h", bits)
    cells = where.groupBy("_h").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("long").alias("_parts"))
    # At most 2**(bits * dimensions) cells, whatever the table.
    cells = F.broadcast(cells) if bits * len(dimensions) <= 20 else cells
    where = where.join(cells, "_h").withColumn("_sub", F.coalesce(_mixed(id_col) % F.col("_parts"), F.lit(0)))
    counts = where.groupBy("_h", "_sub").agg(F.count(F.lit(1)).alias("_n"))
    coarse = F.shiftright("_h", max(0, bits * len(dimensions) - BLOCK_BITS))
    counts = counts.withColumn("_block", coarse)
    before = Window.partitionBy("_block").orderBy("_h", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    inner = counts.withColumn("_in", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    blocks = counts.groupBy("_block").agg(F.sum("_n").alias("_n"))
    # At most 2**BLOCK_BITS rows, whatever the table.
    ahead = Window.orderBy("_block")
    blocks = blocks.select(
        "_block",
        F.coalesce(F.sum("_n").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"),
        F.sum("_n").over(ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    )
    offsets = inner.join(F.broadcast(blocks), "_block").select("_h", "_sub", (F.col("_from") + F.col("_in")).alias("_before"), "_all")
    rows = where.select(
        col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(col(text_col)), F.lit(0)) + 1).cast("long").alias("_size"),
        F.coalesce(F.crc32(col(text_col).cast("binary")), F.lit(0)).cast("long").alias("_crc"),
        "_h",
        "_sub",
        *([F.struct(*[col(c) for c in df.columns]).alias("_row")] if whole else []),
    )
    rank = F.row_number().over(Window.partitionBy("_h", "_sub").orderBy("_id", "_crc", "_size")) - 1
    placed = rows.join(offsets, ["_h", "_sub"]).withColumn("_at", rank + F.col("_before"))
    shard_no = F.expr(f"cast((_at * {shards}) div _all as int)")
    return placed.withColumn("_shard", shard_no).select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"),
        F.expr(f"_at - (cast(_shard as bigint) * _all + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_h").alias("curve"),
        *([F.col("_row").alias("row")] if whole else []),
    )


def write_shards(df: DataFrame, path: str, rows_per_task: int = 1_000_000, **options) -> None:
    """The rows of ``df`` as Parquet files by shard, sorted along the curve. A shard is written by
    a task for each run of ``rows_per_task`` slots, so its files keep narrow ranges."""
    placed = shard(df, whole=True, **options).select("row", "shard", "slot", F.expr(f"slot div {rows_per_task}").alias("_run"))
    width = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), options.get("shards", SHARDS))
    out = placed.repartition(width, "shard", "_run").sortWithinPartitions("shard", "slot")
    own = [F.col("row").getField(c).alias(c) for c in df.columns if c.lower() != "shard"]
    out.select(*own, "shard").write.partitionBy("shard").mode("overwrite").parquet(path)
