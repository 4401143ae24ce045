"""Continuous ingest: documents that arrive as a stream are chunked, embedded and put into a
collection batch by batch. The reference has no stream; this is an extension of its per-file
replacement, with the same result as one ingest of the latest text of every file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gneiss.operators import markdown, reconcile
from gneiss.operators.embed import Provider
from gneiss.operators.ingest import as_points
from gneiss.operators.store import VectorStore


def replace_batch(store: VectorStore, collection: str, provider: Provider, batch: DataFrame, max_chars: int = 4000) -> None:
    """Puts the last text of each file in the batch (file_path, repo_name, text, version) in place."""
    last = reconcile.last_wins(batch, ["file_path"], ["version"]).withColumn("source", F.col("file_path"))
    md = markdown.chunk_markdown(last, ["file_path", "repo_name", "source"], max_chars=max_chars)
    chunks = md.withColumns({"kind": F.lit("markdown"), "def_line": F.lit(None).cast("int"), "symbol_name": F.lit(None).cast("string")}).drop("turn").withColumnRenamed("chunk_text", "text")
    store.replace(collection, as_points(chunks, provider), last.select("file_path"))


def stream_into(store: VectorStore, collection: str, provider: Provider, documents: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the stream; a batch that is run again gives the same table."""
    if not store.exists(collection):
        store.recreate_collection(collection, provider.dimensions())

    def put(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            replace_batch(store, collection, provider, batch)
        finally:
            batch.unpersist()

    return documents.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
