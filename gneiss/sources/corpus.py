"""File discovery as a Python data source and column predicates.

``spark.read.format("corpus").option("root", dir)`` lists every file below a root (or, in a
git work tree, the tracked files and the untracked ones that are not ignored) when it plans;
path rules run there too, on names alone, so that only files that pass are opened. Tasks then
read bytes. Unlike Spark's own file listing it keeps names that start with ``_`` or ``.``."""

from __future__ import annotations

import os
import re
import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gneiss.functions import paths

MAX_FILE_BYTES = 524_288
SNIFF = 8192
FILES_PER_TASK = 200


class DiscoveryError(Exception):
    """The root is no folder, or nothing in it fits."""


def is_git(root: str) -> bool:
    try:
        out = subprocess.run(["git", "rev-parse", "--is-inside-work-tree"], cwd=root, capture_output=True, text=True, timeout=30)
    except (OSError, subprocess.SubprocessError):
        return False
    return out.returncode == 0 and out.stdout.strip() == "true"


def listing(root: str) -> list[str]:
    """Paths below the root, relative and sorted."""
    if is_git(root):
        args = ["git", "ls-files", "-z", "--cached", "--others", "--exclude-standard", "--deduplicate"]
        out = subprocess.run(args, cwd=root, capture_output=True, check=True).stdout
        found = [os.fsdecode(p) for p in out.split(b"\0") if p]
    else:
        found = [os.path.relpath(os.path.join(d, f), root) for d, dirs, names in os.walk(root) for f in [*names, *(x for x in dirs if os.path.islink(os.path.join(d, x)))]]
    return sorted(p.replace(os.sep, "/") for p in found)


def path_reason(rel: str, globs: list[str], exclude: list[str], deny: list[str]) -> str | None:
    """Why a path is passed over by its name: "" for silently, None if it is not."""
    wanted = paths.any_of([paths.glob_regex(p) for g in globs for p in paths.braces(g)])
    if not re.match(wanted, rel, re.DOTALL) or not set(exclude).isdisjoint(rel.split("/")):
        return ""
    return "denylist" if _denied(rel, deny) else None


def _denied(rel: str, deny: list[str]) -> bool:
    rule = re.compile(paths.any_of([paths.name_regex(p.lower()) for p in deny]), re.DOTALL)
    return bool(rule.match(rel.lower()) or rule.match(rel.lower().rsplit("/", 1)[-1]))


class _Part(InputPartition):
    def __init__(self, files):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.realpath(options["root"])
        split = lambda name, default: options[name].split("\n") if name in options else default
        self.globs = split("globs", ["**/*.md"])
        self.exclude = split("exclude", paths.DEFAULT_EXCLUDE)
        self.deny = split("deny", paths.DEFAULT_DENY)
        self.most = int(options.get("maxFileBytes", MAX_FILE_BYTES))

    def partitions(self):
        if not os.path.isdir(self.root):
            raise DiscoveryError(f"{self.root} is not a directory")
        files = [(p, why) for p in listing(self.root) if (why := path_reason(p, self.globs, self.exclude, self.deny)) != ""]
        return [_Part(files[i : i + FILES_PER_TASK]) for i in range(0, len(files), FILES_PER_TASK)] or [_Part([])]

    def read(self, partition):
        for rel, why in partition.files:
            full = os.path.join(self.root, rel)
            if why is None and not os.path.isfile(full):
                continue
            target = os.path.realpath(full)
            inside = target == self.root or target.startswith(self.root + os.sep)
            size, content = None, None
            if why is None:
                if not inside:
                    why = "outside_root"
                elif _denied(os.path.relpath(target, self.root).replace(os.sep, "/"), self.deny):
                    why = "denylist"
            if why is None:
                size = os.path.getsize(full)
                why = "too_large" if size > self.most else None
            if why is None:
                try:
                    with open(full, "rb") as f:
                        content = f.read()
                    why = "binary" if b"\0" in content[:SNIFF] else None
                except OSError:
                    why = "binary"
            yield rel, target, size, content if why is None else None, why


class CorpusSource(DataSource):
    """Options: root, globs, exclude, deny (lists by line), maxFileBytes."""

    @classmethod
    def name(cls):
        return "corpus"

    def schema(self):
        return "rel string, resolved string, length bigint, content binary, skip_reason string"

    def reader(self, schema):
        return _Reader(self.options)


def discover(spark: SparkSession, root: str, globs: list[str], exclude: list[str] | None = None, deny: list[str] | None = None, max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Files below the root, with why each that was not read was passed over."""
    if not os.path.isdir(root):
        raise DiscoveryError(f"{root} is not a directory")
    spark.dataSource.register(CorpusSource)
    read = spark.read.format("corpus").option("root", root).option("globs", "\n".join(globs)).option("maxFileBytes", str(max_file_bytes))
    read = read if exclude is None else read.option("exclude", "\n".join(exclude))
    return (read if deny is None else read.option("deny", "\n".join(deny))).load()


def texts(files: DataFrame) -> DataFrame:
    """Files with their text; what is not UTF-8 is ``unreadable``. Line breaks become newlines
    and a byte order mark stays."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    out = files.withColumn("text", F.regexp_replace(text, "\r\n?", "\n"))
    unreadable = F.col("skip_reason").isNull() & F.col("content").isNotNull() & text.isNull()
    return out.withColumn("skip_reason", F.when(unreadable, "unreadable").otherwise(F.col("skip_reason"))).drop("content")


def skip_counts(files: DataFrame) -> DataFrame:
    return files.filter("skip_reason is not null").groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n")).orderBy("skip_reason")


def file_path(resolved: Column, repo_root: str | None, project_root: str) -> Column:
    """The path relative to the repository, else to the project, else the bare name."""
    out = F.substring_index(resolved, "/", -1)
    for root in [project_root, repo_root]:
        if root:
            base = str(Path(root).resolve()).rstrip("/") + "/"
            out = F.when(resolved.startswith(F.lit(base)), F.substring(resolved, len(base) + 1, 1 << 30)).otherwise(out)
    return out
