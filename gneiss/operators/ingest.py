"""Ingest: discover, chunk, embed and reconcile one project as one plan and one table swap.

The scan, the chunkers and the embedding map are one lazy plan that runs once, when the store
writes the new points; only the buckets of changed files are rewritten. If any of it fails the
old version stays."""

from __future__ import annotations

import datetime
import json
import os
import subprocess
import tempfile
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.text import point_id
from gneiss.operators import catalog, code, embed, graph, markdown
from gneiss.operators.store import POINT_SCHEMA, VectorStore
from gneiss.sources import corpus
from gneiss.sources.config import Config, Embedding, Graph, Project

POINT_WARNING = 15_000
REPORT_LIMIT = 200_000


class ModelMismatch(Exception):
    pass


@dataclass
class IndexReport:
    files: int = 0
    chunks: int = 0
    removed_files: int = 0
    skipped: Counter = field(default_factory=Counter)
    warnings: list[str] = field(default_factory=list)
    graph: bool | None = None


def provider_of(e: Embedding) -> embed.Provider:
    if e.provider == "openai":
        return embed.build_provider("openai", e.model, e.base_url, e.api_key_env, batch_size=e.batch_size, max_chars=e.max_chars)
    return embed.build_provider(e.provider, e.model, e.ollama_host, max_chars=e.max_chars)


def project_texts(spark: SparkSession, project: Project) -> DataFrame:
    files = corpus.discover(spark, str(project.root), list(project.globs), list(project.path_exclude), list(project.deny), project.max_file_bytes)
    path = corpus.file_path(F.col("resolved"), project.repo_root, str(project.root))
    return corpus.texts(files).withColumn("file_path", path).withColumn("repo_name", F.lit(project.effective_repo_name))


def project_chunks(texts: DataFrame, project: Project) -> DataFrame:
    """Chunks of the readable texts, with one column set for documents and code."""
    readable = texts.filter("skip_reason is null").withColumnRenamed("resolved", "source")
    keep = ["file_path", "repo_name", "source"]
    is_code = F.lit(project.kind == "code") & ~F.col("file_path").endswith(".md")
    names = [*keep, "id", "embed_text", "start_line", "end_line", F.col("chunk_text").alias("text"), "kind", "def_line", "heading", "breadcrumb", "symbol_name", "ord"]
    md = markdown.chunk_markdown(readable.filter(~is_code), keep, max_chars=project.max_chunk_chars)
    md = md.withColumns({"kind": F.lit("markdown"), "def_line": F.lit(None).cast("int"), "symbol_name": F.lit(None).cast("string")}).select(*names)
    if project.kind != "code":
        return md
    made = code.chunk_code(readable.filter(is_code), keep, max_chars=project.max_chunk_chars, window=project.window_lines, overlap=project.window_overlap, templates=list(project.path_labels))
    extra = {"heading": F.lit(None).cast("string"), "breadcrumb": F.lit(None).cast("array<string>"), "ord": F.col("start_line"), "source": F.lit(None).cast("string")}
    return md.unionByName(made.withColumns(extra).select(*names))


def as_points(chunks: DataFrame, provider: embed.Provider, graph_tables=None) -> DataFrame:
    out = chunks
    blank = {"community": F.lit(None).cast("long"), "community_name": F.lit(""), "is_god_node": F.lit(False), "related_symbols": F.array().cast("array<string>")}
    if graph_tables is None:
        out = out.withColumns(blank)
    else:
        nodes, links, gods, most = graph_tables
        out = graph.enrich(out, nodes, links, gods, ["file_path", "id", "start_line", "end_line", "ord"], most)
    out = embed.embed_column(out.withColumn("ordinal", F.struct("file_path", "ord", "start_line", "end_line", "kind").cast("string")), provider)
    out = out.withColumn("id", point_id(F.col("id"))).withColumn("community", F.col("community").cast("long"))
    return out.select(*POINT_SCHEMA.names, "ordinal")


def built_graph(project: Project, folder: str, run=subprocess.run) -> str | None:
    """The graph file that the project's builder writes; none without a builder, or if anything
    about it fails: enrichment is an extra, never a reason not to index."""
    wanted = project.graph
    if project.kind != "code" or wanted is None or not wanted.enabled or not wanted.command:
        return None
    out = os.path.join(folder, "graph.json")
    try:
        done = run([*wanted.command, str(project.root), out], timeout=wanted.timeout_seconds, capture_output=True, check=False)
        with open(out, encoding="utf-8") as f:
            found = json.load(f)
        good = done.returncode == 0 and isinstance(found.get("nodes"), list) and isinstance(found.get("links"), list) and found["nodes"] and found["links"]
    except (OSError, ValueError, AttributeError, subprocess.SubprocessError):
        return None
    return f"file://{out}" if good else None


def index_project(
    spark: SparkSession, store: VectorStore, project: Project, provider: embed.Provider, recreate: bool = False, graph_file: str | None = None,
    now: datetime.datetime | None = None, run=subprocess.run,
) -> IndexReport:
    """Indexes a project; without a ``graph_file`` the project's builder is run for one, on the driver."""
    with tempfile.TemporaryDirectory() as folder:
        graph_file = graph_file or built_graph(project, folder, run)
        tables = _graph_tables(spark, project, graph_file) if project.kind == "code" and graph_file else None
    return _index(spark, store, project, provider, recreate, tables, now)


def _graph_tables(spark: SparkSession, project: Project, graph_file: str):
    """Nodes, links and most connected nodes. The graph is read on the driver, as executors don't
    see its folder; it has the size of one repository."""
    nodes, links = graph.read_graph(spark, graph_file)
    nodes, links = (spark.createDataFrame(x.collect(), x.schema) for x in (nodes, links))
    nodes = graph.placed_nodes(nodes, str(project.root))
    wanted = project.graph or Graph()
    degree = links.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    gods = degree.join(nodes.select("id"), "id", "left_semi").orderBy(F.desc("n"), "id").limit(wanted.god_nodes_top)
    return nodes, links, gods, wanted.related_max


def _index(spark: SparkSession, store: VectorStore, project: Project, provider: embed.Provider, recreate: bool, tables, now) -> IndexReport:
    report = IndexReport()
    texts = project_texts(spark, project)
    counts = {r["skip_reason"]: r["n"] for r in texts.groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    report.skipped = Counter({k: n for k, n in counts.items() if k})
    report.files = counts.get(None, 0) + counts.get("unreadable", 0)
    if not report.files:
        raise corpus.DiscoveryError(f"no file matches in {project.root}")
    name, exists = project.collection, store.exists(project.collection)
    meta = store.read_meta(name)
    if exists and not recreate:
        if meta is None:
            recreate = True
            report.warnings.append(f"{name}: legacy collection without a model record, rebuilt")
        elif meta["model_id"] != provider.model_id:
            raise ModelMismatch(f"{name} was indexed with {meta['model_id']}, the configuration says {provider.model_id}; use --recreate")
    if not exists or recreate:
        store.recreate_collection(name, provider.dimensions())
    god_names, text = None, None
    if tables:
        god_names = [r[0] for r in graph.god_labels(*tables[:3]).collect()]
        text = "\n".join(f"- {g}" for g in god_names)[:REPORT_LIMIT]
    report.graph = bool(tables) if project.kind == "code" else None
    chunks = project_chunks(texts, project)
    indexed = store.read(name).select("file_path").filter("file_path is not null").distinct()
    present = texts.filter("skip_reason is null or skip_reason = 'unreadable'").select("file_path")
    gone = indexed.join(present, "file_path", "left_anti")
    report.removed_files = gone.count()
    done = texts.filter("skip_reason is null").select("file_path").unionByName(gone)
    # Chunks that share an id are counted as they were made; the table keeps the last of them.
    report.chunks = store.replace(name, as_points(chunks, provider, tables), done)
    stamp = (now or datetime.datetime.now(datetime.UTC)).isoformat(timespec="seconds")
    store.write_meta(name, provider.model_id, provider.dimensions(), files=report.files, repo_name=project.effective_repo_name, kind=project.kind, indexed_at=stamp, report=text, god_nodes=god_names)
    if project.max_chunk_chars > provider.max_input_chars:
        report.warnings.append(f"chunks of up to {project.max_chunk_chars} characters exceed the model input of {provider.max_input_chars}")
    if (n := store.count(name)) > POINT_WARNING:
        report.warnings.append(f"{name} has {n} points")
    return report


def stored_orphans(spark: SparkSession, config: Config, store: VectorStore) -> list[str]:
    known = spark.createDataFrame([(p.collection,) for p in config.all_projects()], "collection string")
    prefixes = spark.createDataFrame([(p,) for p in config.prefixes()], "prefix string")
    names = spark.createDataFrame([(n,) for n in store.names()], "collection string")
    return sorted(r[0] for r in catalog.orphans(names, known, prefixes).collect())


def ingest(spark: SparkSession, config: Config, store: VectorStore, name: str | None = None, every: bool = False, recreate: bool = False, prune: bool = False, yes: bool = False, confirm=None, say=print) -> int:
    """Indexes one project or all; a failing one does not stop the others. Pruning needs a run
    over all without failures, and consent."""
    if prune and not every:
        say("--prune needs --all")
        return 2
    chosen = config.all_projects() if every else [config.project(name)]
    failed = False
    for p in chosen:
        try:
            report = index_project(spark, store, p, provider_of(config.embedding_for(p)), recreate)
            say(f"{p.name}: {report.files} files, {report.chunks} chunks, {report.removed_files} removed")
            for reason, n in sorted(report.skipped.items()):
                say(f"  skipped {reason}: {n}")
            for w in report.warnings:
                say(f"  warning: {w}")
        except Exception as e:
            failed = True
            say(f"{p.name}: {e}")
    left = stored_orphans(spark, config, store) if every else []
    if left:
        say("orphans: " + ", ".join(left))
        if prune and failed:
            say("not pruned: a project failed")
        elif prune and (yes or (confirm and confirm(left))):
            for n in left:
                store.delete_collection(n)
                store.delete_meta(n)
                say(f"dropped {n}")
    return int(failed)
