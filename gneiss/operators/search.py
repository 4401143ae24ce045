"""Exact cosine search over point tables.

A point table has (collection, id, vector, ...); vectors are compared in double precision.
One query vector travels as literals, so a search is one scan with a partial top-k in every
task (TakeOrderedAndProject, or a rank limit before the shuffle); no side grows with the data."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Query vectors that one pass over the points holds at most (with 1,000 dimensions about 40 MB).
QUERY_BLOCK = 5_000


class ModelMismatch(Exception):
    """The collections to search were embedded by different models."""


def as_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def normalised(vector: Column) -> Column:
    """The vector with length one; null if it has none."""
    length = F.sqrt(dot(vector, vector))
    return F.when(length > 0, F.transform(vector, lambda x: x.cast("double") / length))


def scored(points: DataFrame, query: Sequence[float], min_score: float | None = None, vector_col: str = "vector") -> DataFrame:
    """Points with a score of at least ``min_score`` (the threshold comes before any limit)."""
    out = points.withColumn("score", F.round(cosine(F.col(vector_col), as_vector(query)), 6)).filter("score is not null").drop(vector_col)
    return out if min_score is None else out.filter(F.col("score") >= min_score)


def top_k(points: DataFrame, query: Sequence[float], k: int = 5, min_score: float | None = None, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The k best points, ties by id."""
    return scored(points, query, min_score, vector_col).orderBy(F.desc("score"), id_col).limit(k)


def ranked(hits: DataFrame, k: int, id_col: str = "id", by: str = "collection") -> DataFrame:
    """The k best hits of every group with their rank (from 1)."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), id_col))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(
    points: DataFrame, query: Sequence[float], targets: DataFrame, k: int = 5, min_score: float | None = None, id_col: str = "id", vector_col: str = "vector"
) -> DataFrame:
    """Top k over several collections: the k best of each, merged, best first.

    ``targets`` is (collection, ordinal); equal scores keep target order, then rank. Scores are
    not normalised between collections. A target without points adds nothing."""
    wanted = [(r["collection"], r["ordinal"]) for r in targets.select("collection", "ordinal").collect()]
    if not wanted:
        return ranked(scored(points.limit(0), query, min_score, vector_col), k, id_col).withColumn("ordinal", F.lit(0))
    first: dict[str, int] = {}
    for name, n in wanted:
        first[name] = min(n, first.get(name, n))
    hits = scored(points.filter(F.col("collection").isin(list(first))), query, min_score, vector_col)
    place = F.element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), F.col("collection"))
    return ranked(hits, k, id_col).withColumn("ordinal", place).orderBy(F.desc("score"), "ordinal", "rank").limit(k)


def single_model(targets: DataFrame) -> str | None:
    """The one model of all targets (collection, model_id); raises if there are more."""
    models = [r[0] for r in targets.select("model_id").distinct().limit(2).collect()]
    if len(models) > 1:
        raise ModelMismatch("collections use different embedding models: " + ", ".join(sorted(map(str, models))))
    return models[0] if models else None


def neighbours(queries: DataFrame, points: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector", block: int = QUERY_BLOCK) -> DataFrame:
    """For each query row its k nearest other points, by cosine in double precision.

    Queries go out in blocks of a fixed size as unit vectors. A task multiplies its points with
    a block as matrices and keeps k points per query (and those that tie after rounding), so a
    block shuffles about k rows per query and task. Points or queries without a length, or of another length, have
    no neighbours."""
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).cast("array<double>").alias("v"))
    n = q.count()
    passes = max(1, -(-n // block))
    src = points.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    schema = T.StructType([T.StructField("query_id", q.schema["query_id"].dataType), T.StructField("id", src.schema["id"].dataType), T.StructField("raw", T.DoubleType())])
    out = None
    for i in range(passes):
        part = (q if passes == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)).collect()  # a block
        shared = points.sparkSession.sparkContext.broadcast(_units([r["query_id"] for r in part], [r["v"] for r in part]))
        found = src.mapInArrow(_nearest(shared, k, schema), schema)
        hits = found.select("query_id", F.col("id").alias(id_col), F.round("raw", 6).alias("score"))
        best = ranked(hits, k, id_col, by="query_id")
        out = best if out is None else out.unionByName(best)
    return out


def _units(ids: list, vectors: list) -> dict[int, tuple[list, np.ndarray]]:
    """Ids and unit vectors of those that have a length, by dimension."""
    found: dict[int, tuple[list, list]] = {}
    for i, v in zip(ids, vectors, strict=True):
        if v and not any(x is None for x in v) and (norm := math.sqrt(math.fsum(x * x for x in v))) > 0:
            held = found.setdefault(len(v), ([], []))
            held[0].append(i)
            held[1].append((v, norm))
    return {d: (i, np.array([v for v, _ in rows]) / np.array([[n] for _, n in rows])) for d, (i, rows) in found.items()}


def _nearest(shared, k: int, schema: T.StructType):
    def best(query, ids, raw):
        """The k best rows of each query and all that tie with the k-th after rounding."""
        order = np.lexsort((-raw, query))
        query, ids, raw = query[order], [ids[o] for o in order.tolist()], raw[order]
        head = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        size = np.diff(np.append(head, len(query)))
        last = np.repeat(raw[head + np.minimum(size, k) - 1], size)
        stay = np.flatnonzero(raw >= last - 1.1e-6)
        return query[stay], [ids[o] for o in stay.tolist()], raw[stay]

    def run(batches):
        kept = {d: (np.zeros(0, np.int64), [], np.zeros(0)) for d in shared.value}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                for d, (ids, v) in _units(part.column(0).to_pylist(), part.column(1).to_pylist()).items():
                    if d not in kept:
                        continue
                    names, q = shared.value[d]
                    score = q @ v.T
                    least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(q), -np.inf)
                    # A query's own row may be among its k, so one more is looked at.
                    more = np.partition(score, -k - 1, axis=1)[:, -k - 1] if score.shape[1] > k + 1 else np.full(len(q), -np.inf)
                    i, j = np.nonzero(score >= (np.minimum(least, more) - 1.1e-6)[:, None])
                    other = np.array([names[a] != ids[b] for a, b in zip(i.tolist(), j.tolist(), strict=True)], bool)
                    i, j = i[other], j[other]
                    old = kept[d]
                    if len(i):
                        kept[d] = best(np.append(old[0], i), old[1] + [ids[b] for b in j.tolist()], np.append(old[2], score[i, j]))
        for d, (query, ids, raw) in kept.items():
            names = shared.value[d][0]
            columns = [[names[x] for x in query.tolist()], ids, raw.tolist()]
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=to_arrow_type(f.dataType)) for c, f in zip(columns, schema, strict=True)], names=schema.names)

    return run
