"""Command line: ingest, search, collections list|drop, sources, explain."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from gneiss.api import Engine, format_panel
from gneiss.operators.ingest import ModelMismatch, ingest
from gneiss.operators.search import ModelMismatch as MixedModels
from gneiss.operators.store import VectorStore
from gneiss.sources import config as conf


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gneiss", description="Index and search documentation and code.")
    p.add_argument("--config")
    p.add_argument("--store", default="vectors")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("ingest")
    i.add_argument("name", nargs="?")
    for flag in ("all", "recreate", "prune", "yes"):
        i.add_argument(f"--{flag}", action="store_true")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--in", dest="collection")
    s.add_argument("--top-k", type=int, default=5)
    s.add_argument("--min-score", type=float)
    c = sub.add_parser("collections").add_subparsers(dest="action", required=True)
    c.add_parser("list")
    d = c.add_parser("drop")
    d.add_argument("name", nargs="?")
    d.add_argument("--all", action="store_true")
    d.add_argument("--yes", action="store_true")
    sub.add_parser("sources")
    e = sub.add_parser("explain")
    e.add_argument("repo")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, say=print, ask=input) -> int:
    args = parser().parse_args(argv)
    agree = lambda names: ask(f"drop {', '.join(names)}? [y/N] ").strip().lower() == "y"
    try:
        config = conf.load(args.config or conf.find())
        spark = spark or SparkSession.builder.appName("gneiss").getOrCreate()
        store = VectorStore(spark, args.store)
        engine = Engine(spark, config, store)
        if args.command == "ingest":
            if not args.all and not args.name:
                say("name a project or use --all")
                return 2
            return ingest(spark, config, store, args.name, args.all, args.recreate, args.prune, args.yes, agree, say)
        if args.command == "search":
            found = engine.search(args.query, args.collection, args.top_k, args.min_score, None if args.collection else "docs")
            say("\n\n".join(map(format_panel, found)) if found else "Nothing found.")
        elif args.command == "sources":
            say(engine.list_sources())
        elif args.command == "explain":
            say(engine.explain_architecture(args.repo))
        elif args.action == "list":
            for r in store.list_collections().collect():
                say(f"{r['collection']}: {r['points']} points")
        else:
            names = store.names() if args.all else [args.name]
            if not args.all and (not args.name or not store.exists(args.name)):
                say(f"no collection '{args.name}'")
                return 1
            if not names:
                say("nothing to drop")
            elif args.yes or agree(names):
                for n in names:
                    store.delete_collection(n)
                    store.delete_meta(n)
                    say(f"dropped {n}")
        return 0
    except (conf.ConfigError, ModelMismatch, MixedModels) as e:
        say(str(e))
        return 1


if __name__ == "__main__":
    sys.exit(main())
