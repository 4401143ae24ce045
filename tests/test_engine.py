import datetime
import subprocess

import pytest
from pyspark.sql import functions as F

from gneiss.api import Engine, SearchResult, format_results
from gneiss.cli import main
from gneiss.functions import paths
from gneiss.operators import embed, graph, search
from gneiss.operators.ingest import ModelMismatch, index_project, ingest
from gneiss.operators.store import StoreLocked, VectorStore
from gneiss.sources import config as conf
from gneiss.sources import corpus


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


# ---------------------------------------------------------------- paths and discovery


def test_braces_and_globs(spark):
    assert paths.braces("{a,b}/*.{x,y}") == ["a/*.x", "a/*.y", "b/*.x", "b/*.y"]
    df = spark.createDataFrame([("a.md",), ("d/e/b.md",), ("d/c.txt",)], "p string")
    assert rows(df.filter(paths.matches_glob(F.col("p"), ["**/*.md"])), "p") == [("a.md",), ("d/e/b.md",)]
    assert rows(df.filter(paths.matches_glob(F.col("p"), ["*.md"])), "p") == [("a.md",)]


def test_labels_take_the_first_template(spark):
    df = spark.createDataFrame([("env/prod/app.yaml",), ("x/y",), ("z",)], "p string")
    labels = paths.path_labels(F.col("p"), ["env/{stage}/*", "{a}/{b}"])
    got = {r["p"]: [(x["key"], x["value"]) for x in r["l"]] for r in df.select("p", labels.alias("l")).collect()}
    assert got == {"env/prod/app.yaml": [("stage", "prod")], "x/y": [("a", "x"), ("b", "y")], "z": []}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "docs"
    (root / "pkg").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "a.md").write_text("# A\n\nalpha words here\n")
    (root / "pkg" / "__init__.md").write_text("# I\n\nbeta words there\r\n")
    (root / "node_modules" / "x.md").write_text("# X\n\nx\n")
    (root / "SECRET-x.md").write_text("s")
    (root / "big.md").write_text("b" * 5000)
    (root / "bin.md").write_bytes(b"a\0b")
    (root / "latin.md").write_bytes(b"caf\xe9 au lait")
    (tmp_path / "out.md").write_text("o")
    (root / "link.md").symlink_to(tmp_path / "out.md")
    return root


def test_discovery_reasons(spark, tree):
    files = corpus.texts(corpus.discover(spark, str(tree), ["**/*.md"], max_file_bytes=1000))
    reasons = {r["rel"]: r["skip_reason"] for r in files.collect()}
    assert reasons == {"a.md": None, "pkg/__init__.md": None, "SECRET-x.md": "denylist", "big.md": "too_large", "bin.md": "binary", "latin.md": "unreadable", "link.md": "outside_root"}
    assert {r["text"] for r in files.filter("rel = 'pkg/__init__.md'").collect()} == {"# I\n\nbeta words there\n"}
    with pytest.raises(corpus.DiscoveryError):
        corpus.discover(spark, str(tree / "missing"), ["*"])


# ---------------------------------------------------------------- store and ingest


@pytest.fixture
def store(spark, tmp_path):
    return VectorStore(spark, f"file://{tmp_path}/store")


def points(spark, data):
    return spark.createDataFrame(data, "id long, vector array<double>, text string, file_path string, ordinal int")


def test_store_upsert_delete_and_catalog(spark, store):
    store.recreate_collection("c", 2)
    store.upsert("c", points(spark, [(1, [1.0, 0.0], "a", "f", 0), (2, [0.0, 1.0], "b", "g", 1), (1, [1.0, 0.0], "new", "f", 2)]))
    assert rows(store.read("c"), "id", "text") == [(1, "new"), (2, "b")]
    store.recreate_collection("empty", 2)
    assert rows(store.list_collections(), "collection", "points") == [("c", 2), ("empty", 0)]
    assert rows(store.distinct_values("c", "file_path"), "value") == [("f",), ("g",)]
    with pytest.raises(Exception):
        store.upsert("c", points(spark, [(3, [1.0], "x", "h", 0)]))
    store.delete_where("c", "file_path", ["f"])
    assert store.count("c") == 1 and store.scroll_where("c", "file_path", "g").count() == 1
    store.delete_collection("c")
    assert not store.exists("c") and store.count("c") == 0


def test_registry(spark, store):
    store.write_meta("c", "hash:8", 8, files=3)
    store.write_meta("c", "hash:16", 16, files=4)
    assert store.read_meta("c")["model_id"] == "hash:16" and store.meta().count() == 1
    store.delete_meta("c")
    assert store.read_meta("c") is None


def test_ingest_reconciles_and_search_finds(spark, store, tree):
    project = conf.Project("docs", str(tree), "docs", max_file_bytes=1000)
    provider = embed.build_provider("hash", "32")
    when = datetime.datetime(2024, 1, 2, tzinfo=datetime.UTC)
    first = index_project(spark, store, project, provider, now=when)
    assert (first.files, first.chunks, first.removed_files) == (3, 2, 0) and first.skipped["unreadable"] == 1
    assert store.read_meta("docs")["indexed_at"] == "2024-01-02T00:00:00+00:00"
    ids = rows(store.read("docs"), "id")
    assert index_project(spark, store, project, provider).removed_files == 0 and rows(store.read("docs"), "id") == ids
    (tree / "a.md").unlink()
    (tree / "pkg" / "__init__.md").write_text("# I\n\ngamma\n\n# J\n\ndelta\n")
    again = index_project(spark, store, project, provider)
    assert again.removed_files == 1 and rows(store.read("docs"), "text") == [("# I\n\ngamma",), ("# J\n\ndelta",)]
    with pytest.raises(ModelMismatch):
        index_project(spark, store, project, embed.build_provider("hash", "64"))
    engine = Engine(spark, conf.Config(embedding=conf.Embedding("hash", "32"), explicit=[project]), store)
    found = engine.search("delta", kind="docs")
    assert found[0].text == "# J\n\ndelta" and found[0].breadcrumb == ["J"]
    assert "### [docs] pkg/__init__.md:5-7" in engine.search_docs("delta")
    assert engine.search("delta", "nowhere") == [] and engine.search_docs("x", "code.svc").startswith("'code.svc' holds code")
    assert engine.list_sources().startswith("- docs (docs, repo docs): 2 points, model hash:32, 2 files, indexed ")


def test_code_ingest_with_a_graph(spark, store, tmp_path):
    root = tmp_path / "svc"
    root.mkdir()
    (root / "m.py").write_text("def helper():\n    return 1\n\n\ndef run():\n    return helper()\n")
    (tmp_path / "graph.json").write_text('{"nodes": [{"id": "h", "label": "helper()", "source_file": "m.py", "source_location": "L1", "community": 3, "community_name": "core"}, {"id": "r", "label": "run()", "source_file": "m.py", "source_location": "L5", "community": 3, "community_name": "core"}], "links": [{"source": "r", "target": "h", "relation": "calls", "confidence": "EXTRACTED"}]}')
    project = conf.Project("svc", str(root), "code.svc", ("**/*.py",), kind="code", repo_name="svc")
    index_project(spark, store, project, embed.build_provider("hash", "16"), graph_file=str(tmp_path / "graph.json"))
    got = {r["symbol_name"]: (r["community_name"], r["related_symbols"]) for r in store.read("code.svc").collect()}
    assert got == {"helper": ("core", ["run"]), "run": ("core", ["helper"])}


def test_a_builder_gives_the_graph_and_its_failure_nothing(spark, store, tmp_path):
    root = tmp_path / "svc"
    root.mkdir()
    (root / "m.py").write_text("def helper():\n    return 1\n\n\ndef run():\n    return helper()\n")
    made = '{"nodes": [{"id": "h", "label": "helper()", "source_file": "m.py", "source_location": "L1", "community": 3, "community_name": "core"}], "links": [{"source": "r", "target": "h", "relation": "calls", "confidence": "EXTRACTED"}]}'
    project = conf.Project("svc", str(root), "code.svc", ("**/*.py",), kind="code", repo_name="svc", graph=conf.Graph(command=("build", "-q"), timeout_seconds=9))
    called = []

    def builder(command, **options):
        called.append((command[:3], options["timeout"]))
        with open(command[-1], "w") as f:
            f.write(made)
        return subprocess.CompletedProcess(command, 0)

    def slow(command, **options):
        raise subprocess.TimeoutExpired(command, 9)

    provider = embed.build_provider("hash", "16")
    assert index_project(spark, store, project, provider, run=slow).graph is False
    assert index_project(spark, store, project, provider, run=lambda c, **o: subprocess.CompletedProcess(c, 0)).graph is False
    assert index_project(spark, store, project, provider, run=builder).graph is True and called == [(["build", "-q", str(root)], 9)]
    assert {r["community_name"] for r in store.read("code.svc").filter("symbol_name = 'helper'").collect()} == {"core"}
    engine = Engine(spark, conf.Config(embedding=conf.Embedding("hash", "16"), repos=[project]), store)
    assert "- helper" in engine.explain_architecture("svc") and "not a code repository" in engine.explain_architecture("x")


def test_writes_touch_buckets_keep_versions_and_lock(spark, store, monkeypatch):
    store.recreate_collection("c", 2)
    store.upsert("c", points(spark, [(i, [1.0, 0.0], "a", f"f{i}", i) for i in range(40)]))
    before, old = store.read("c"), store._pointer("c")["buckets"]
    store.upsert("c", points(spark, [(1, [0.0, 1.0], "new", "f1", 0)]))
    now = store._pointer("c")["buckets"]
    assert sum(old[k] != now[k] for k in old) == 1 and len(now) == len(old)
    assert before.filter("id = 1").first()["text"] == "a" and store.read("c").filter("id = 1").first()["text"] == "new"
    store.upsert("c", points(spark, [(1, [0.0, 1.0], "moved", "elsewhere", 0)]))
    assert rows(store.read("c").filter("id = 1"), "text", "file_path") == [("moved", "elsewhere")] and store.count("c") == 40
    with store.locked("c"), pytest.raises(StoreLocked):
        store.delete_where("c", "file_path", ["f2"])
    store.keep_seconds = -1
    store.delete_where("c", "text", ["moved"])
    used = {*store._pointer("c")["buckets"].values()}
    assert store.count("c") == 39 and {s.getPath().getName() for s in store._fs.listStatus(store._path("c")) if s.isDirectory()} == used
    assert rows(store.points(["c", "none"]).filter("id = 3"), "collection") == [("c",)]


def test_sources_are_listed_by_their_own_models(spark, store, monkeypatch):
    store.recreate_collection("a", 8)
    store.recreate_collection("b", 8)
    store.write_meta("a", "hash:16", 16)
    store.write_meta("b", "hash:8", 8)
    projects = [conf.Project("a", "/a", "a", embedding=conf.Embedding("hash", "16")), conf.Project("b", "/b", "b", embedding=conf.Embedding("hash", "16")), conf.Project("n", "/n", "n", embedding=conf.Embedding("openai", "m"))]
    lines = Engine(spark, conf.Config(embedding=conf.Embedding("hash", "8"), explicit=projects), store).list_sources().split("\n")
    assert "other model" not in lines[0] and "other model than the configured hash:16: ingest b with --recreate" in lines[1]
    assert "not indexed yet, ingest n (no embedding provider" in lines[2]


@pytest.mark.parametrize("url", ["http://a.example:80@b.example/", "http://a.example\\@b.example", "http://a.example /x", "ftp://a.example", "http://[::2]/", "http://a.example:99999/", "http://é.example/"])
def test_urls_that_programs_read_differently(url):
    with pytest.raises(conf.ConfigError):
        conf.endpoint(url)
    assert conf.endpoint("HTTPS://A.example:8443/v1?x=1") == ("https", "a.example") and conf.endpoint("http://[::1]:11434") == ("http", "::1")


def test_prune_needs_consent_and_no_failure(spark, store, tree):
    base = tree.parent / "ctx"
    (base / "topics" / "auth").mkdir(parents=True)
    (base / "topics" / "auth" / "a.md").write_text("# A\n\nx\n")
    config = conf.Config(embedding=conf.Embedding("hash", "8"), sources=[conf.Source(str(base / "topics"))])
    said = []
    assert ingest(spark, config, store, every=True, say=said.append) == 0
    for name in ("ctx.gone", "code.x", "other.y"):
        store.recreate_collection(name, 8)
    assert ingest(spark, config, store, every=True, prune=True, confirm=lambda _: False, say=said.append) == 0 and store.exists("ctx.gone")
    assert ingest(spark, config, store, every=True, prune=True, yes=True, say=said.append) == 0
    assert store.names() == ["code.x", "ctx.auth", "other.y"]


def test_command_line(spark, tree, tmp_path):
    (tmp_path / "gneiss.toml").write_text(f'[embedding]\nprovider = "hash"\nmodel = "16"\n[[projects]]\nname = "docs"\npath = "{tree}"\ncollection = "docs"\n')
    said = []
    run = lambda *a: main(["--config", str(tmp_path / "gneiss.toml"), "--store", f"file://{tmp_path}/s", *a], spark, said.append)
    assert run("ingest", "docs") == 0 and run("search", "alpha") == 0 and "[docs] a.md:1-3" in "\n".join(said)
    assert run("collections", "list") == 0 and "docs: 4 points" in said
    assert run("collections", "drop", "docs", "--yes") == 0 and run("collections", "drop", "docs") == 1


# ---------------------------------------------------------------- search and graph


def test_threshold_comes_before_the_limit(spark):
    p = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [1.0, 1.0]), ("b", 3, [1.0, 0.0]), ("b", 4, [0.0, 0.0]), ("b", 5, None)], "collection string, id int, vector array<float>")
    assert rows(search.top_k(p, [1.0, 0.0], 5, 0.9), "id") == [(1,), (3,)]
    targets = spark.createDataFrame([("b", 0), ("a", 1), ("none", 2)], "collection string, ordinal int")
    assert [r["id"] for r in search.search(p, [1.0, 0.0], targets, 2).collect()] == [3, 1]
    with pytest.raises(search.ModelMismatch):
        search.single_model(spark.createDataFrame([("a", "x"), ("b", "y")], "collection string, model_id string"))


def test_graph_fixture(spark):
    nodes = [("mod", "mod.py", "src/mod.py", "L1", 3, "core"), ("run", ".run()", "src/mod.py", "L10", 3, "core"), ("svc", "Service", "src/mod.py", "L5", 3, "core"), ("helper", "helper()", "/repo/src/util.py", "L2", 4, "util"), ("ext", "os", "", None, None, None), ("out", "x", "/else/x.py", "L3", 1, "")]
    links = [("svc", "run", "method", "EXTRACTED"), ("run", "helper", "calls", "EXTRACTED"), ("run", "svc", "uses", "INFERRED"), ("mod", "helper", "imports_from", "EXTRACTED"), ("run", "ghost", "calls", "EXTRACTED")]
    n = spark.createDataFrame([(*x, i) for i, x in enumerate(nodes)], "id string, label string, source_file string, source_location string, community int, community_name string, ordinal int")
    e = spark.createDataFrame([(*x, i) for i, x in enumerate(links)], "source string, target string, relation string, confidence string, ordinal int")
    chunks = spark.createDataFrame([(1, "src/mod.py", "method", 10, 9, 12), (2, "src/mod.py", "module", None, 1, 4), (3, "src/util.py", "function", None, 1, 5), (4, "src/mod.py", "window", 10, 1, 60)], "k int, file_path string, kind string, def_line int, start_line int, end_line int")
    gods = spark.createDataFrame([("run",)], "id string")
    placed = graph.placed_nodes(n, "/repo")
    got = {r["k"]: (r["node_id"], r["community"], r["is_god_node"], r["related_symbols"]) for r in graph.enrich(chunks, placed, e, gods, ["k"]).collect()}
    assert got == {1: ("run", 3, True, ["helper"]), 2: ("mod", 3, False, ["helper"]), 3: ("helper", 4, False, ["Service.run"]), 4: (None, None, False, [])}
    assert [r[0] for r in graph.god_labels(placed, e, gods).collect()] == ["Service.run"]


def test_format():
    text = format_results([SearchResult("body", "", "c", "", 0.5, "a.py", "r", 1, 2, [], "f", "function", "core", True, ["g", "h"])])
    assert text == "### [c] a.py:1-2 (score: 0.50)\nrepo: r\nsymbol: f\ncommunity: core\ngod_node: true\nrelated: g, h\nbody\n"
    assert format_results([SearchResult("t", "/x", "c", "", 1.0)]).startswith("### [c] /x (score: 1.00)")


# ---------------------------------------------------------------- providers and configuration


def test_retries_and_order():
    waits, answers = [], [(503, {}, b""), (429, {"Retry-After": "7"}, b""), (200, {}, b'{"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}')]
    p = embed.build_provider("openai", "m", "https://h/v1", "K", send=lambda *a: answers.pop(0), sleep=waits.append)
    assert p.embed_batch(["a", "b"]) == [[1], [2]] and waits == [1.0, 7.0] and p.model_id == "openai:m"
    p = embed.build_provider("openai", "m", "https://h/v1", "K", send=lambda *a: (400, {}, b"secret"), sleep=waits.append)
    with pytest.raises(embed.EmbeddingError, match="status 400"):
        p.embed("x")
    sent = []
    p = embed.build_provider("ollama", "m", send=lambda url, data, *a: (sent.append(len(data)), (200, {}, b'{"embedding": [1, 2]}'))[1])
    assert p.dimensions() == 2 and p.embed("x" * 9999) == [1, 2] and sent[-1] < 1600
    for bad in (("openai", "m"), ("nope", "m")):
        with pytest.raises(embed.EmbeddingError):
            embed.build_provider(*bad)
    resolver = embed.Resolver(("hash", "8"))
    assert resolver.of() is resolver.of(("hash", "8")) is not resolver.of(("hash", "16"))


@pytest.fixture
def home(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    for k in ("BASE_URL", "PROVIDER", "MODEL", "API_KEY_ENV", "BATCH_SIZE"):
        monkeypatch.delenv("GNEISS_EMBEDDING_" + k, raising=False)
    monkeypatch.delenv("GNEISS_TRUSTED_HOSTS", raising=False)
    return tmp_path


def load(folder, text):
    (folder / "gneiss.toml").write_text(text)
    return conf.load(folder / "gneiss.toml")


def test_config_defaults_and_families(home):
    (home / "ctx" / "docs" / "auth").mkdir(parents=True)
    (home / "ctx" / "docs" / "auth" / "x.md").write_text("x")
    (home / "ctx" / "docs" / "void").mkdir()
    c = load(home, f'[[projects]]\nname = "p"\npath = "{home}"\ncollection = "c"\n[[sources]]\nroot = "{home}/ctx/docs"\n[[repos]]\nroot = "{home}/svc"\nglobs = ["**/*.go"]\n')
    assert [(p.name, p.collection, p.kind) for p in c.all_projects()] == [("p", "c", "docs"), ("ctx.auth", "ctx.auth", "docs"), ("svc", "code.svc", "code")]
    assert c.for_collection("svc").globs == ("**/*.go",) and c.prefixes() == {"ctx"} and c.embedding.model == "nomic-embed-text"
    assert conf.find(home) == home / "gneiss.toml"


@pytest.mark.parametrize(
    "table",
    ['provider = "openai"\nbase_url = "https://evil.example"', 'provider = "openai"\nbase_url = "http://localhost\\\\@evil"', 'ollama_host = "http://evil.example"', "batch_size = 0", "batch_size = 33"],
)
def test_local_files_may_not_name_hosts(home, table):
    with pytest.raises(conf.ConfigError):
        load(home, f"[embedding]\n{table}\n")


def test_trusted_hosts(home, monkeypatch):
    monkeypatch.setenv("GNEISS_TRUSTED_HOSTS", "good.example")
    assert load(home, '[embedding]\nprovider = "openai"\nbase_url = "https://good.example/v1"\n').embedding.api_key_env == "GNEISS_EMBEDDING_API_KEY"
    with pytest.raises(conf.ConfigError, match="plain http"):
        load(home, '[embedding]\nprovider = "openai"\nbase_url = "http://good.example/v1"\n')


def test_stream_replaces_files(spark, store, tmp_path):
    from gneiss.streaming.incremental import stream_into

    schema = "file_path string, repo_name string, text string, version long"
    src = tmp_path / "in"
    spark.createDataFrame([("a.md", "r", "# A\n\none\n", 1), ("a.md", "r", "# A\n\ntwo\n", 2)], schema).write.parquet(str(src))
    provider = embed.build_provider("hash", "8")
    run = lambda: stream_into(store, "s", provider, spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "cp")).awaitTermination()
    run()
    assert rows(store.read("s"), "text") == [("# A\n\ntwo",)]
    spark.createDataFrame([("a.md", "r", "# A\n\nthree\n", 3), ("b.md", "r", "b\n", 1)], schema).write.mode("append").parquet(str(src))
    run()
    assert rows(store.read("s"), "text") == [("# A\n\nthree",), ("b",)]
