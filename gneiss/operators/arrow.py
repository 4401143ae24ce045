"""A table-generating Arrow map: several rows for each text, other columns carried along."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def explode_rows(df: DataFrame, inputs: str | Sequence[str], keep: Sequence[str], fields: Sequence[T.StructField], fn: Callable[..., list[tuple]], rows: int = 256) -> DataFrame:
    """Columns ``keep`` and ``fields``, a row for each tuple of ``fn(*inputs)``; only the columns
    named are read, and a batch is worked on in small slices."""
    inputs = [inputs] if isinstance(inputs, str) else list(inputs)
    new = {f.name for f in fields}
    kept = [c for c in keep if c not in new]
    src = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, *inputs])])
    schema = T.StructType([src.schema[c] for c in kept] + list(fields))
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made, owner = [], []
                for i, args in enumerate(zip(*[part.column(c).to_pylist() for c in inputs], strict=True)):
                    found = [] if args[0] is None else fn(*args)
                    made += found
                    owner += [i] * len(found)
                if made:
                    index = pa.array(owner, pa.int32())
                    cols = [part.column(c).take(index) for c in kept]
                    cols += [pa.array(x, type=t) for x, t in zip(zip(*made, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return src.mapInArrow(run, schema)
