"""Versioned Parquet tables: a collection is a folder of immutable parts and a pointer.

Points are kept in buckets of their file's path. A write reads only the buckets that it touches,
writes their next version beside the others and swaps the pointer file in one rename, so readers
see the old or the new table and a failed job leaves the old. Versions that the pointer left stay
for ``keep_seconds``, as plans made before still read them. Writers of a collection take its lock; a second
one fails instead of losing the first one's update. The file system is reached through Hadoop's
API, hence any store that Spark can write to and that creates a file only once."""

from __future__ import annotations

import contextlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.operators import catalog, reconcile

POINT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("text", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("repo_name", T.StringType()),
    T.StructField("heading", T.StringType()), T.StructField("breadcrumb", T.ArrayType(T.StringType())), T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()), T.StructField("symbol_name", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("community", T.LongType()), T.StructField("community_name", T.StringType()), T.StructField("is_god_node", T.BooleanType()),
    T.StructField("related_symbols", T.ArrayType(T.StringType())),
])
META_SCHEMA = "collection string, model_id string, dimensions int, files long, repo_name string, kind string, indexed_at string, report string, god_nodes array<string>"


#: Buckets of a new collection; a bucket is the least that a write rewrites.
BUCKETS = 64
KEEP_SECONDS = 24 * 3600
#: A lock older than this was left by a writer that died.
LOCK_SECONDS = 6 * 3600


class StoreLocked(Exception):
    """Another writer is at work on the collection."""


class VectorStore:
    def __init__(self, spark: SparkSession, root: str, keep_seconds: int = KEEP_SECONDS, lock_seconds: int = LOCK_SECONDS):
        self.spark, self.root = spark, root.rstrip("/")
        self.keep_seconds, self.lock_seconds = keep_seconds, lock_seconds
        jvm = spark._jvm
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        self._fs = self._path("x").getFileSystem(spark._jsc.hadoopConfiguration())
        self._jvm = jvm

    # ---------------------------------------------------------------- versions

    def _pointer(self, name: str) -> dict | None:
        path = self._path(name, "CURRENT")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _swap(self, name: str, state: dict) -> None:
        new, current = self._path(name, f"CURRENT.{uuid.uuid4().hex}"), self._path(name, "CURRENT")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, current, options)

    @contextlib.contextmanager
    def locked(self, name: str):
        """Holds the collection's lock file."""
        path = self._path(name, "LOCK")
        if self._fs.exists(path) and time.time() - self._fs.getFileStatus(path).getModificationTime() / 1000 > self.lock_seconds:
            self._fs.delete(path, False)
        try:
            self._fs.create(path, False).close()
        except Exception as e:
            raise StoreLocked(f"another writer is at work on {name}") from e
        try:
            yield
        finally:
            self._fs.delete(path, False)

    def _clean(self, name: str, state: dict) -> None:
        """Deletes versions that the pointer left long ago."""
        used = {state.get("version"), *state.get("buckets", {}).values()}
        for s in self._fs.listStatus(self._path(name)):
            old = time.time() - s.getModificationTime() / 1000 >= self.keep_seconds
            if s.isDirectory() and s.getPath().getName() not in used and old:
                self._fs.delete(s.getPath(), True)

    def _write(self, name: str, df: DataFrame, state: dict, touched: list[int]) -> None:
        """The next version: ``df`` has all rows of the touched buckets."""
        version = f"v-{uuid.uuid4().hex}"
        out = df.withColumn("bucket", self._bucket(state)).repartition("bucket").sortWithinPartitions("bucket", "file_path", "start_line")
        out.write.partitionBy("bucket").parquet(f"{self.root}/{name}/{version}")
        kept = {k: v for k, v in state["buckets"].items() if int(k) not in touched}
        kept |= {str(k): version for k in touched if self._fs.exists(self._path(name, version, f"bucket={k}"))}
        state = state | {"buckets": kept}
        self._swap(name, state)
        self._clean(name, state)

    @staticmethod
    def _bucket(state: dict):
        return F.pmod(F.xxhash64(F.coalesce("file_path", F.lit(""))), F.lit(state["count"])).cast("int")

    def exists(self, name: str) -> bool:
        return self._pointer(name) is not None

    def _folders(self, name: str, state: dict | None, only: list[int] | None = None) -> list[str]:
        buckets = state["buckets"].items() if state else ()
        return [f"{self.root}/{name}/{version}/bucket={k}" for k, version in sorted(buckets) if only is None or int(k) in only]

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(POINT_SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], POINT_SCHEMA)

    def read(self, name: str) -> DataFrame:
        """The points of a collection; no rows if there is none."""
        return self._read(self._folders(name, self._pointer(name)))

    def points(self, names: list[str] | None = None) -> DataFrame:
        """All points of some collections with their collection's name, as one scan."""
        names = names if names is not None else self.names()
        folders = [f for n in dict.fromkeys(names) for f in self._folders(n, self._pointer(n))]
        if not folders:
            return self._read([]).withColumn("collection", F.lit(""))
        path = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/v-[0-9a-f]+/bucket=\d+/[^/]*$", 1)
        return self._read(folders).withColumn("collection", F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))

    # ---------------------------------------------------------------- collections

    def recreate_collection(self, name: str, vector_size: int) -> None:
        with self.locked(name):
            self._swap(name, {"vector_size": vector_size, "count": BUCKETS, "buckets": {}})

    def vector_size(self, name: str) -> int | None:
        state = self._pointer(name)
        return state and state["vector_size"]

    def replace(self, name: str, points: DataFrame, drop_paths: DataFrame | None = None) -> int:
        """One new version: rows of ``drop_paths`` go, ``points`` (with ``ordinal``) are put in.
        Gives the number of points that were made. They are computed once, into a folder beside the versions."""
        with self.locked(name):
            state = self._pointer(name)
            if state is None:
                raise KeyError(name)
            fit = F.col("vector").isNull() | (F.size("vector") == state["vector_size"])
            checked = points.withColumn("vector", F.when(fit, F.col("vector")).otherwise(F.raise_error(F.lit(f"vectors of {name} have {state['vector_size']} dimensions"))))
            stage = f"stage-{uuid.uuid4().hex}"
            try:
                checked.write.parquet(f"{self.root}/{name}/{stage}")
                staged = self.spark.read.schema(checked.schema).parquet(f"{self.root}/{name}/{stage}")
                made = staged.count()
                fresh = reconcile.last_wins(staged, ["id"], ["ordinal"]).select(*POINT_SCHEMA.names)
                paths = staged.select("file_path")
                gone = drop_paths.select("file_path").distinct() if drop_paths is not None else paths.limit(0)
                moved = self.read(name).select("id", "file_path").join(staged.select("id"), "id", "left_semi").select("file_path")
                touched = [r[0] for r in paths.unionByName(gone).unionByName(moved).select(self._bucket(state).alias("b")).distinct().collect()]  # at most the count of buckets
                old = self._read(self._folders(name, state, touched)).join(gone, "file_path", "left_anti").join(staged.select("id"), "id", "left_anti")
                self._write(name, old.select(*POINT_SCHEMA.names).unionByName(fresh), state, touched)
                return made
            finally:
                self._fs.delete(self._path(name, stage), True)

    def upsert(self, name: str, points: DataFrame) -> None:
        if "ordinal" not in points.columns:
            points = points.withColumn("ordinal", F.monotonically_increasing_id())
        missing = [f for f in POINT_SCHEMA if f.name not in points.columns]
        for f in missing:
            points = points.withColumn(f.name, F.lit(None).cast(f.dataType))
        self.replace(name, points.select(*POINT_SCHEMA.names, "ordinal"))

    def delete_where(self, name: str, field: str, values: list) -> None:
        if not values or not self.exists(name):
            return
        with self.locked(name):
            state = self._pointer(name)
            gone = self.spark.createDataFrame([(v,) for v in values], T.StructType([POINT_SCHEMA[field]]))
            hit = self.read(name).select("file_path", field).join(gone, field, "left_semi") if field != "file_path" else gone
            touched = [r[0] for r in hit.select(self._bucket(state).alias("b")).distinct().collect()]
            left = self._read(self._folders(name, state, touched)).join(gone, field, "left_anti")
            self._write(name, left.select(*POINT_SCHEMA.names), state, touched)

    def delete_collection(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def names(self) -> list[str]:
        base = self._path("x").getParent()
        if not self._fs.exists(base):
            return []
        return sorted(n for s in self._fs.listStatus(base) if (n := s.getPath().getName()) != catalog.REGISTRY and self.exists(n))

    def list_collections(self) -> DataFrame:
        names = self.spark.createDataFrame([(n,) for n in self.names()], "collection string")
        return catalog.counts(names, self.points().select("collection")).orderBy("collection")

    def count(self, name: str) -> int:
        return self.read(name).count()

    def distinct_values(self, name: str, field: str) -> DataFrame:
        return catalog.distinct_values(self.read(name), field)

    def scroll_where(self, name: str, field: str, value, limit: int = 10) -> DataFrame:
        return catalog.scroll_where(self.read(name), field, value, limit)

    # ---------------------------------------------------------------- registry

    def meta(self) -> DataFrame:
        state = self._pointer(catalog.REGISTRY)
        if state is None:
            return self.spark.createDataFrame([], META_SCHEMA)
        return self.spark.read.schema(META_SCHEMA).parquet(f"{self.root}/{catalog.REGISTRY}/{state['version']}")

    def read_meta(self, collection: str) -> dict | None:
        row = self.meta().filter(F.col("collection") == collection).first()
        return row and row.asDict()

    def write_meta(self, collection: str, model_id: str, dimensions: int, **more) -> None:
        new = self.spark.createDataFrame([{"collection": collection, "model_id": model_id, "dimensions": dimensions} | more], META_SCHEMA)
        self._register(collection, new)

    def delete_meta(self, collection: str) -> None:
        if self.exists(catalog.REGISTRY):
            self._register(collection, None)

    def _register(self, collection: str, new: DataFrame | None) -> None:
        """The registry without the collection's row, and the new one; a row a collection."""
        with self.locked(catalog.REGISTRY):
            rows, version = self.meta().filter(F.col("collection") != collection), f"v-{uuid.uuid4().hex}"
            rows = rows if new is None else rows.unionByName(new)
            rows.coalesce(1).sortWithinPartitions("collection").write.parquet(f"{self.root}/{catalog.REGISTRY}/{version}")
            self._swap(catalog.REGISTRY, {"version": version})
            self._clean(catalog.REGISTRY, {"version": version})
