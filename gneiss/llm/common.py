"""Shared plumbing of the training-data operators.

Every Arrow operator goes through :func:`map_rows`: it prunes the scan to the columns
named, hands small slices of Python lists to a function built once per task, and never
holds more than one Arrow batch of rows."""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: ASCII punctuation becomes a space; used on UTF-8 bytes after lower-casing.
PUNCT_TO_SPACE = bytes.maketrans(
    bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F)),
    b" " * 32,
)


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation, as UTF-8 bytes; none for null."""
    if not text:
        return []
    return text.lower().encode("utf-8", "surrogatepass").translate(PUNCT_TO_SPACE).split()


@functools.cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda _: 0


def give_back() -> None:
    """Returns freed memory to the system: a worker serves the tasks of other operators next."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def map_rows(
    df: DataFrame,
    inputs: Sequence[str],
    keep: Sequence[str],
    fields: Sequence[T.StructField],
    factory: Callable[[], Callable],
    rows: int = 256,
) -> DataFrame:
    """Columns ``keep`` of ``df`` followed by ``fields``, computed in Arrow batches.

    ``factory()`` runs once per task and returns ``fn(*lists) -> lists``, one per field; a
    kept column that has the name of a new field gives way to the new one."""
    new = {f.name for f in fields}
    kept = [c for c in keep if c not in new]
    src = df.select(*[col(c) for c in dict.fromkeys([*kept, *inputs])])
    schema = T.StructType([src.schema[c] for c in kept] + list(fields))
    types = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in schema]

    def run(batches):
        fn = factory()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = fn(*[part.column(c).to_pylist() for c in inputs])
                made = [pa.array(x, type=t) for x, t in zip(out, types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + made, names=names)
        del fn
        give_back()

    return src.mapInArrow(run, schema)


def expand_rows(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[T.StructField],
    factory: Callable[[], Callable],
    rows: int = 256,
) -> DataFrame:
    """Like :func:`map_rows`, but ``fn`` may return any number of rows, and an object with
    ``finish()`` may return more when its partition has ended."""
    src = df.select(*[col(c) for c in dict.fromkeys(inputs)])
    schema = T.StructType(list(fields))
    types = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in fields]

    def pack(out):
        return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(out, types, strict=True)], names=names)

    def run(batches):
        fn = factory()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = fn(*[part.column(c).to_pylist() for c in inputs])
                if len(out[0]):
                    yield pack(out)
        if hasattr(fn, "finish"):
            out = fn.finish()
            if len(out[0]):
                yield pack(out)
        del fn
        give_back()

    return src.mapInArrow(run, schema)


def id_remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``: the fold rule of the learned operators."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")), F.lit(0)) % divisor


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder.

    The folder is the session's ``spark.checkpoint.dir``. Where none is set, a local session (as
    in tests) gets one; on a cluster that is an error, as its nodes share no local folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="gneiss-checkpoints-"))
    return df.checkpoint(eager=True)
