"""All queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import paths
from gneiss.functions.text import chunk_id, code_text, is_blank, lines_of, point_id
from gneiss.operators import catalog, code, graph, markdown, reconcile, search, windows
from gneiss.operators.embed import hash_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL equivalent."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings as points; their label is the collection."""
    return table(spark, d, "embeddings").select(F.col("label").cast("string").alias("collection"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def first_vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return list(table(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0])


# ---------------------------------------------------------------- vector search

_SCORED = """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
s AS (SELECT label::VARCHAR AS collection, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM embeddings, q)
"""


@query(_SCORED + "SELECT collection, id, score FROM s ORDER BY score DESC, id LIMIT 5")
def vector_topk(spark, d):
    return search.top_k(points(spark, d), first_vector(spark, d), 5).select("collection", "id", "score")


@query(_SCORED + "SELECT collection, id, score FROM s WHERE score >= 0.2 ORDER BY score DESC, id LIMIT 20")
def vector_topk_threshold(spark, d):
    return search.top_k(points(spark, d), first_vector(spark, d), 20, 0.2).select("collection", "id", "score")


@query(_SCORED + "SELECT collection, id, score, row_number() OVER (PARTITION BY collection ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 3")
def vector_topk_per_collection(spark, d):
    hits = search.scored(points(spark, d), first_vector(spark, d))
    return search.ranked(hits, 3).select("collection", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(
    _SCORED
    + """, t AS (SELECT '3' AS collection, 0 AS ordinal UNION ALL SELECT '7', 1 UNION ALL SELECT '1', 2 UNION ALL SELECT '99', 3),
r AS (SELECT collection, id, score, ordinal, row_number() OVER (PARTITION BY collection ORDER BY score DESC, id) AS rank
      FROM s JOIN t USING (collection) WHERE score >= 0.0 QUALIFY rank <= 5)
SELECT collection, id, score FROM r ORDER BY score DESC, ordinal, rank LIMIT 5"""
)
def vector_merge_global(spark, d):
    targets = spark.createDataFrame([("3", 0), ("7", 1), ("1", 2), ("99", 3)], "collection string, ordinal int")
    return search.search(points(spark, d), first_vector(spark, d), targets, 5, 0.0).select("collection", "id", "score")


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM embeddings JOIN q ON vec_id <> query_id)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 3"""
)
def vector_neighbours(spark, d):
    p = points(spark, d)
    return search.neighbours(p.filter("id % 20 = 0"), p, 3).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- lines, windows, ids

_LINES = r"""WITH raw AS (SELECT doc_id, source, lang, string_split_regex(text, '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]') AS parts FROM documents),
d AS (SELECT doc_id, source, lang, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS lines FROM raw)
"""


@query(_LINES + "SELECT doc_id, pos::INT AS line_no, length(lines[pos]) AS n_chars FROM d, generate_series(1, len(lines)) g(pos)")
def splitlines_rows(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("line_no"), F.length("line").cast("long").alias("n_chars"))


@query(_LINES + "SELECT doc_id, len(list_filter(lines, lambda l: length(trim(l)) > 0)) AS solid_lines, len(lines) AS all_lines FROM d")
def nonblank_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", lines_of(F.col("text")).alias("lines"))
    return lines.select("doc_id", F.size(F.filter("lines", lambda x: ~is_blank(x))).cast("long").alias("solid_lines"), F.size("lines").cast("long").alias("all_lines"))


_WINDOWS = (
    _LINES
    + """, s AS (SELECT doc_id, source, lines, len(lines) AS n, st FROM d, generate_series(1, 200000, 8) g(st) WHERE st <= len(lines) AND (st = 1 OR st - 8 + 10 - 1 < len(lines))),
w AS (SELECT doc_id, source, st::INT AS start_line, least(st + 9, n)::INT AS end_line, array_to_string(lines[st:least(st + 9, n)], chr(10)) AS chunk_text,
  row_number() OVER (PARTITION BY doc_id ORDER BY st) - 1 AS ord FROM s WHERE regexp_matches(array_to_string(lines[st:least(st + 9, n)], ''), '\\S')),
i AS (SELECT *, substr(sha256(concat_ws('::', 'corpus', source || '/' || doc_id || '.txt', 'window', start_line, ord)), 1, 16) AS id FROM w)
"""
)


def _windows(spark, d):
    w = windows.line_windows(table(spark, d, "documents").select("doc_id", "source", "text"), "text", 10, 2)
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return w.withColumn("id", chunk_id("corpus", path, "window", F.col("start_line").cast("string"), F.col("ord").cast("string"))).withColumn("path", path)


@query(_WINDOWS + "SELECT doc_id, start_line, end_line, md5(chunk_text) AS text_md5 FROM w")
def line_windows(spark, d):
    w = windows.line_windows(table(spark, d, "documents").select("doc_id", "text"), "text", 10, 2)
    return w.select("doc_id", "start_line", "end_line", F.md5("chunk_text").alias("text_md5"))


@query(_WINDOWS + "SELECT doc_id, start_line, id FROM i")
def window_chunk_ids(spark, d):
    return _windows(spark, d).select("doc_id", "start_line", "id")


@query(_WINDOWS + "SELECT doc_id, start_line, (('0x' || id)::HUGEINT % 9223372036854775808)::BIGINT AS point_id FROM i")
def point_ids(spark, d):
    return _windows(spark, d).select("doc_id", "start_line", point_id(F.col("id")).alias("point_id"))


@query(
    _WINDOWS
    + """SELECT doc_id, start_line, md5('# source=' || source || ' doc=' || doc_id || '.txt' || chr(10) || '# ' || source || '/' || doc_id || '.txt:' || start_line || '-' || end_line
  || chr(10) || chr(10) || chunk_text) AS embed_md5 FROM i"""
)
def code_embed_texts(spark, d):
    w = _windows(spark, d)
    labels = F.transform(paths.path_labels(F.col("path"), ["{a}/{b}/{c}", "{source}/{doc}"]), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return w.select("doc_id", "start_line", F.md5(code_text(labels, F.col("path"), F.col("start_line"), F.col("end_line"), F.lit(""), F.col("chunk_text"))).alias("embed_md5"))


# ---------------------------------------------------------------- Markdown

#: Every ninth line of a document becomes an h1, h2 or h3 heading.
_MARKED = (
    _LINES
    + """, l AS (SELECT doc_id, pos, lines[pos] AS line, CASE pos % 9 WHEN 1 THEN 1 WHEN 4 THEN 2 WHEN 7 THEN 3 ELSE 0 END AS lvl FROM d, generate_series(1, len(lines)) g(pos)),
m AS (SELECT doc_id, pos, CASE WHEN lvl = 0 THEN line ELSE repeat('#', lvl) || ' L' || lvl || ' ' || (pos % 5) END AS line, lvl FROM l),
seg AS (SELECT *, sum(CASE WHEN lvl IN (1, 2) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp,
  max(CASE WHEN lvl = 1 THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS h1 FROM m),
agg AS (SELECT doc_id, grp, min(pos) AS a, min(lvl) FILTER (WHERE lvl IN (1, 2)) AS lv, min(pos) FILTER (WHERE lvl IN (1, 2)) AS hp, min(h1) AS h1,
  max(pos) FILTER (WHERE regexp_matches(line, '\\S')) AS b, count(*) FILTER (WHERE lvl NOT IN (1, 2) AND regexp_matches(line, '\\S')) AS body,
  list(line ORDER BY pos) AS ls FROM seg GROUP BY doc_id, grp),
kept AS (SELECT *, CASE WHEN lv = 1 THEN ['L1 ' || (hp % 5)] ELSE ['L1 ' || (h1 % 5), 'L2 ' || (hp % 5)] END AS crumb FROM agg WHERE body > 0),
num AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS ord, row_number() OVER (PARTITION BY doc_id, crumb ORDER BY grp) - 1 AS turn FROM kept)
"""
)


def _marked(spark, d):
    lines = table(spark, d, "documents").select("doc_id", lines_of(F.col("text")).alias("lines"))
    level = lambda i: F.when(i % 9 == 1, 1).when(i % 9 == 4, 2).when(i % 9 == 7, 3).otherwise(0)
    mark = lambda x, i: F.when(level(i + 1) == 0, x).otherwise(
        F.concat(F.when(level(i + 1) == 1, "# L1 ").when(level(i + 1) == 2, "## L2 ").otherwise("### L3 "), ((i + 1) % 5).cast("string"))
    )
    return lines.select(
        "doc_id", F.array_join(F.transform("lines", mark), "\n").alias("text"),
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), F.lit("corpus").alias("repo_name"), F.lit("s").alias("source"),
    )


def _sections(spark, d, most=0):
    return markdown.chunk_markdown(_marked(spark, d), ["doc_id", "file_path", "repo_name"], max_chars=most)


@query(_MARKED + "SELECT doc_id, ord::INT AS ord, a::INT AS start_line, b::INT AS end_line, crumb[-1] AS heading, array_to_string(crumb, ' > ') AS breadcrumb FROM num")
def markdown_sections(spark, d):
    return _sections(spark, d).select("doc_id", "ord", "start_line", "end_line", "heading", F.array_join("breadcrumb", " > ").alias("breadcrumb"))


@query(
    _MARKED
    + """SELECT doc_id, ord::INT AS ord, substr(sha256('corpus::docs/' || doc_id || '.md::' || array_to_string(crumb, ' > ') || '::' || turn), 1, 16) AS id,
  md5('# ' || array_to_string(crumb, ' > ') || chr(10) || chr(10) || array_to_string(ls[1:b - a + 1], chr(10))) AS embed_md5 FROM num"""
)
def markdown_ids(spark, d):
    return _sections(spark, d).select("doc_id", "ord", "id", F.md5("embed_text").alias("embed_md5"))


@query()
def markdown_budget(spark, d):
    """Sections cut to 600 characters by deeper headings, paragraphs and lines."""
    return _sections(spark, d, 600).select("doc_id", "ord", "start_line", "end_line", "heading", F.length("chunk_text").alias("n_chars"), "id")


# ---------------------------------------------------------------- paths

_URL_PATH = "regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)"


def _paths(spark, d):
    return table(spark, d, "pages").select("page_id", "url", "html", F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1).alias("path"))


@query(
    f"""WITH p AS (SELECT page_id, regexp_replace({_URL_PATH}, '/+$', '') AS path FROM pages)
SELECT page_id, coalesce(CASE WHEN regexp_full_match(path, 'en/[^/]*') THEN 'page=' || regexp_extract(path, 'en/([^/]*)', 1)
  WHEN regexp_full_match(path, '[^/]*/[^/]*') THEN 'lang=' || regexp_extract(path, '([^/]*)/', 1) || ' name=' || regexp_extract(path, '/([^/]*)$', 1) END, '') AS labels FROM p"""
)
def path_labels_urls(spark, d):
    labels = F.transform(paths.path_labels(F.col("path"), ["en/{page}", "{lang}/{name}"]), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return _paths(spark, d).select("page_id", F.array_join(labels, " ").alias("labels"))


@query(f"SELECT page_id FROM (SELECT page_id, {_URL_PATH} AS path FROM pages) WHERE regexp_full_match(path, '(en|de)/[^/]*\\.html|fr/(.*/)?[^/][^/][^/]')")
def glob_filter(spark, d):
    return _paths(spark, d).filter(paths.matches_glob(F.col("path"), ["{en,de}/*.html", "fr/**/???"])).select("page_id")


@query(f"SELECT page_id FROM (SELECT page_id, lower({_URL_PATH}) AS path FROM pages) WHERE regexp_full_match(path, '.*\\.html|es.*') OR regexp_full_match(regexp_extract(path, '[^/]*$'), '9.*')")
def denylist_filter(spark, d):
    return _paths(spark, d).filter(paths.denied(F.col("path"), ["*.HTML", "es*", "9*"])).select("page_id")


@query(
    f"""WITH f AS (SELECT {_URL_PATH} AS path, octet_length(encode(html)) AS n FROM pages), r AS (SELECT CASE WHEN NOT regexp_full_match(path, '(en|de|fr)/.*') THEN NULL
  WHEN list_contains(string_split(path, '/'), 'de') THEN NULL WHEN regexp_full_match(lower(path), '.*\\.html') THEN 'denylist' WHEN n > 3000 THEN 'too_large' ELSE 'read' END AS reason FROM f)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason"""
)
def skip_reason_counts(spark, d):
    path = F.col("path")
    reason = F.when(~paths.matches_glob(path, ["{en,de,fr}/**"]) | paths.has_part(path, ["de"]), None).when(paths.denied(path, ["*.html"]), "denylist")
    reason = reason.when(F.octet_length("html") > 3000, "too_large").otherwise("read")
    return _paths(spark, d).select(reason.alias("reason")).filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- store and catalog


@query("SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) = 1")
def upsert_last_wins(spark, d):
    return reconcile.last_wins(table(spark, d, "conversations"), ["conv_id"], ["turn", "text"]).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def reconcile_removed(spark, d):
    return reconcile.removed(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query(
    """SELECT doc_id, source, 'old' AS version FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT l.doc_id, 'src' || l.quality, 'new' FROM labels l"""
)
def replace_files(spark, d):
    labels = table(spark, d, "labels")
    old = table(spark, d, "documents").select("doc_id", "source", F.lit("old").alias("version"))
    new = labels.select("doc_id", F.concat(F.lit("src"), F.col("quality").cast("string")).alias("source"), F.lit("new").alias("version"))
    return reconcile.replaced(old, new, labels.select("doc_id"), "doc_id")


_COLLECTIONS = "(SELECT DISTINCT source AS collection FROM documents UNION ALL SELECT 'empty')"


def _collections(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("source").alias("collection")).distinct().unionByName(spark.createDataFrame([("empty",)], "collection string"))


def _meta(spark, d):
    """A registry row for every other collection, from the rows of ``labels``."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return docs.groupBy(F.col("source").alias("collection")).agg(F.count(F.lit(1)).alias("files"), F.when(F.max("toxic") == 1, "openai:m").otherwise("hash:64").alias("model_id"))


_META = "(SELECT source AS collection, count(*) AS files, CASE WHEN max(toxic) = 1 THEN 'openai:m' ELSE 'hash:64' END AS model_id FROM documents JOIN labels USING (doc_id) GROUP BY source)"


@query(f"SELECT c.collection, count(d.doc_id) AS points FROM {_COLLECTIONS} c LEFT JOIN documents d ON d.source = c.collection GROUP BY c.collection")
def catalog_counts(spark, d):
    return catalog.counts(_collections(spark, d), table(spark, d, "documents").select(F.col("source").alias("collection")))


@query(
    f"""SELECT c.collection, coalesce(m.model_id, 'ollama:nomic-embed-text') AS model_id, coalesce(m.model_id, 'ollama:nomic-embed-text') <> 'hash:64' AS mismatch
FROM {_COLLECTIONS} c LEFT JOIN {_META} m USING (collection)"""
)
def model_guard(spark, d):
    return catalog.model_check(_collections(spark, d), _meta(spark, d), "hash:64")


@query(
    f"""SELECT c.collection AS name, CASE WHEN n.points IS NULL THEN '- ' || c.collection || ' (docs, repo r): not indexed yet'
  ELSE '- ' || c.collection || ' (docs, repo r): ' || n.points || ' points, model ' || coalesce(m.model_id, 'ollama:nomic-embed-text (legacy, no record)')
  || coalesce(', ' || m.files || ' files', '') END AS line
FROM {_COLLECTIONS} c LEFT JOIN (SELECT source AS collection, count(*) AS points FROM documents GROUP BY source) n USING (collection) LEFT JOIN {_META} m USING (collection)"""
)
def catalog_list_sources(spark, d):
    projects = _collections(spark, d).select(F.col("collection").alias("name"), "collection", F.lit("docs").alias("kind"), F.lit("r").alias("repo_name"))
    counts = table(spark, d, "documents").groupBy(F.col("source").alias("collection")).agg(F.count(F.lit(1)).alias("points"))
    return catalog.source_lines(projects, counts, _meta(spark, d)).select("name", "line")


@query(
    """WITH s AS (SELECT DISTINCT regexp_extract(url, '://([^/]+)', 1) AS collection FROM pages),
k AS (SELECT DISTINCT regexp_extract(url, '://([^/]+)', 1) AS collection FROM pages WHERE page_id % 3 = 0),
p AS (SELECT DISTINCT split_part(collection, '.', 1) AS prefix FROM k)
SELECT collection FROM s WHERE split_part(collection, '.', 1) IN (SELECT prefix FROM p) AND collection NOT IN (SELECT collection FROM k) AND collection NOT LIKE 'code.%'"""
)
def orphans(spark, d):
    hosts = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("collection"))
    known = hosts.filter("page_id % 3 = 0").select("collection").distinct()
    prefixes = known.select(F.substring_index("collection", ".", 1).alias("prefix")).distinct()
    return catalog.orphans(hosts.select("collection").distinct(), known, prefixes)


@query("SELECT DISTINCT label::VARCHAR AS value FROM embeddings WHERE label IS NOT NULL")
def distinct_values(spark, d):
    return catalog.distinct_values(table(spark, d, "embeddings"), "label")


@query("SELECT doc_id, source, lang FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 10")
def scroll_where(spark, d):
    return catalog.scroll_where(table(spark, d, "documents").orderBy("doc_id"), "source", "src3").select("doc_id", "source", "lang")


@query("SELECT lang, source, count(*) AS files, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang, source")
def ingest_totals(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"))


# ---------------------------------------------------------------- code graph

#: A graph over parts and their line items: node = part, file = brand, links by supplier.
_NODES = """nodes AS (SELECT 'n' || p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN p_brand ELSE '.' || replace(p_name, ' ', '_') || '()' END AS label, p_brand AS file_path,
  CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE p_partkey % 400 + 2 END AS line, p_size AS community, p_partkey AS ordinal,
  regexp_replace(regexp_replace(CASE WHEN p_partkey % 11 = 0 THEN p_brand ELSE '.' || replace(p_name, ' ', '_') || '()' END, '\\(\\)$', ''), '^\\.', '') AS plain FROM part)"""
_CHUNKS = """chunks AS (SELECT o_orderkey AS chunk, 'Brand#' || (o_orderkey % 6) AS file_path, (o_orderkey % 380 + 2)::INT AS start_line, (o_orderkey % 380 + 5)::INT AS end_line,
  CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 380 + 2)::INT END AS def_line, CASE o_orderkey % 7 WHEN 0 THEN 'window' WHEN 1 THEN 'module' ELSE 'function' END AS kind FROM orders)"""
_LINKS = """links AS (SELECT 'n' || a.l_partkey AS source, 'n' || ((a.l_partkey * 7 + a.l_suppkey) % 2500) AS target,
  CASE a.l_linenumber % 4 WHEN 0 THEN 'calls' WHEN 1 THEN 'imports' WHEN 2 THEN 'method' ELSE 'inherits' END AS relation,
  CASE WHEN a.l_returnflag = 'A' THEN 'INFERRED' ELSE 'EXTRACTED' END AS confidence, a.l_orderkey * 100 + a.l_linenumber AS ordinal, a.l_partkey FROM lineitem a)"""


def _graph_nodes(spark, d):
    key = F.col("p_partkey")
    raw = table(spark, d, "part").select(
        F.concat(F.lit("n"), key.cast("string")).alias("id"),
        F.when(key % 11 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("()"))).alias("label"),
        F.concat(F.lit("/repo/"), F.col("p_brand")).alias("source_file"),
        F.concat(F.lit("L"), F.when(key % 11 == 0, 1).otherwise(key % 400 + 2).cast("string")).alias("source_location"),
        F.col("p_size").alias("community"), F.lit(None).cast("string").alias("community_name"), key.alias("ordinal"),
    )
    return graph.placed_nodes(raw, "/repo")


def _graph_links(spark, d):
    n = F.col("l_linenumber") % 4
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("source"),
        F.concat(F.lit("n"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 2500).cast("string")).alias("target"),
        F.when(n == 0, "calls").when(n == 1, "imports").when(n == 2, "method").otherwise("inherits").alias("relation"),
        F.when(F.col("l_returnflag") == "A", "INFERRED").otherwise("EXTRACTED").alias("confidence"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ordinal"),
    )


def _graph_chunks(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("chunk"), F.concat(F.lit("Brand#"), (k % 6).cast("string")).alias("file_path"), (k % 380 + 2).cast("int").alias("start_line"), (k % 380 + 5).cast("int").alias("end_line"),
        F.when(k % 2 == 0, (k % 380 + 2).cast("int")).alias("def_line"), F.when(k % 7 == 0, "window").when(k % 7 == 1, "module").otherwise("function").alias("kind"),
    )


_MATCH = f"""WITH {_NODES}, {_CHUNKS},
ex AS (SELECT file_path, line, arg_max(id, ordinal) AS id FROM nodes GROUP BY ALL), fi AS (SELECT file_path, arg_max(id, ordinal) AS id FROM nodes WHERE line = 1 AND label = file_path GROUP BY ALL),
near AS (SELECT chunk, min({{'line': n.line, 'id': n.id}}).id AS id FROM chunks c JOIN nodes n ON n.file_path = c.file_path AND n.line BETWEEN c.start_line AND c.end_line AND n.line > 1 GROUP BY chunk)
SELECT c.chunk, CASE c.kind WHEN 'window' THEN NULL WHEN 'module' THEN fi.id ELSE coalesce(ex.id, near.id) END AS node_id
FROM chunks c LEFT JOIN ex ON ex.file_path = c.file_path AND ex.line = c.def_line LEFT JOIN fi ON fi.file_path = c.file_path LEFT JOIN near ON near.chunk = c.chunk"""


@query(_MATCH)
def graph_match(spark, d):
    return graph.match_chunks(_graph_chunks(spark, d), _graph_nodes(spark, d), ["chunk"]).select("chunk", "node_id")


_QUALIFIED = """own AS (SELECT l.target AS id, max({'o': l.ordinal, 'p': s.plain}).p AS owner FROM links l JOIN nodes s ON s.id = l.source WHERE l.relation = 'method' GROUP BY l.target),
qual AS (SELECT n.id, CASE WHEN o.owner IS NULL THEN n.plain ELSE o.owner || '.' || n.plain END AS qualified FROM nodes n LEFT JOIN own o USING (id))"""


@query(f"WITH {_NODES}, {_LINKS}, {_QUALIFIED} SELECT id, qualified FROM qual")
def graph_qualified(spark, d):
    return graph.qualified_names(_graph_nodes(spark, d), _graph_links(spark, d))


@query(
    f"""WITH {_NODES}, {_LINKS}, {_QUALIFIED},
e AS (SELECT DISTINCT l.source, l.target, l.relation FROM links l JOIN nodes a ON a.id = l.source JOIN nodes b ON b.id = l.target WHERE l.relation IN ('calls', 'imports', 'inherits') AND l.confidence = 'EXTRACTED'),
both_ways AS (SELECT * FROM e UNION SELECT target, source, relation FROM e),
f AS (SELECT b.source AS id, q.qualified, min({{'r': b.relation, 't': b.target}}) AS place FROM both_ways b JOIN qual q ON q.id = b.target WHERE q.qualified <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) AS n FROM f QUALIFY n <= 10)
SELECT id, string_agg(qualified, '|' ORDER BY n) AS related FROM r GROUP BY id"""
)
def graph_related(spark, d):
    found = graph.related(_graph_nodes(spark, d), _graph_links(spark, d), graph.SYMBOL_RELATIONS)
    return found.select("id", F.array_join("related_symbols", "|").alias("related"))


@query(
    f"""WITH {_NODES}, {_LINKS}, {_QUALIFIED}, g AS (SELECT source AS id FROM links WHERE relation <> 'method' GROUP BY source ORDER BY count(*) DESC, source LIMIT 10)
SELECT qualified FROM qual JOIN g USING (id) ORDER BY qualified"""
)
def graph_god_nodes(spark, d):
    links = _graph_links(spark, d)
    gods = links.filter("relation <> 'method'").groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(10)
    return graph.god_labels(_graph_nodes(spark, d), links, gods)


@query(
    """WITH s AS (SELECT l_orderkey, (l_linenumber * 40)::INT AS a, (l_linenumber * 40 + l_quantity)::INT AS b FROM lineitem),
f AS (SELECT *, greatest(coalesce(max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 1), 1) AS c FROM s)
SELECT l_orderkey, c AS gap_start, a - 1 AS gap_end FROM f WHERE a > c
UNION ALL SELECT l_orderkey, max(b) + 1, 300 FROM s GROUP BY l_orderkey HAVING max(b) + 1 <= 300"""
)
def interval_gaps(spark, d):
    end = (F.col("l_linenumber") * 40 + F.col("l_quantity")).cast("int")
    spans = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 40).alias("start"), end.alias("end"), F.lit(1).alias("first"), F.lit(300).alias("last"))
    return windows.gaps(spans, ["l_orderkey"])


# ---------------------------------------------------------------- embedding and code

_HASHED = """WITH w AS (SELECT {key} AS k, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM {table}),
h AS (SELECT k, (('0x' || substr(md5(t), 1, 8))::BIGINT % 64)::INT AS dim, CASE WHEN ('0x' || substr(md5(t), 9, 1))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM w),
v AS (SELECT k, dim, sum(s)::DOUBLE AS x FROM h GROUP BY k, dim)"""


@query(
    _HASHED.format(key="doc_id", table="documents")
    + """, qw AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark WHERE item_id = 0),
q AS (SELECT (('0x' || substr(md5(t), 1, 8))::BIGINT % 64)::INT AS dim, sum(CASE WHEN ('0x' || substr(md5(t), 9, 1))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS y FROM qw GROUP BY 1),
n AS (SELECT k, sum(x * x) AS nx FROM v GROUP BY k)
SELECT n.k AS doc_id, round(coalesce(sum(x * y), 0) / (sqrt(nx) * sqrt((SELECT sum(y * y) FROM q))), 6) AS score FROM n LEFT JOIN (SELECT * FROM v JOIN q USING (dim)) p ON p.k = n.k
WHERE nx > 0 GROUP BY n.k, nx ORDER BY score DESC, doc_id LIMIT 10"""
)
def hash_embed_search(spark, d):
    docs = hash_vectors(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "text", 64)
    text = table(spark, d, "benchmark").filter("item_id = 0").select("text")
    wanted = hash_vectors(text, "text", 64).first()["vector"]
    hits = search.scored(docs.select("id", "vector"), list(wanted))
    return hits.select(F.col("id").alias("doc_id"), "score").orderBy(F.desc("score"), "doc_id").limit(10)


def _derived(spark, d, block, suffix, before="", most=code.MAX_CHARS):
    """A source file for each document, made of a block of code for each of its lines."""
    docs = table(spark, d, "documents").select("doc_id", lines_of(F.col("text")).alias("lines"))
    text = F.concat(F.lit(before) if isinstance(before, str) else before, F.array_join(F.transform("lines", lambda x, i: block(i + 1, F.length(x).cast("string"))), "\n"))
    path = F.concat(F.lit("src/d"), F.col("doc_id").cast("string"), suffix)
    files = docs.filter("size(lines) > 0").select("doc_id", path.alias("file_path"), F.lit("corpus").alias("repo_name"), text.alias("text"))
    out = code.chunk_code(files, ["doc_id", "file_path", "repo_name"], max_chars=most)
    return out.select("doc_id", "start_line", "end_line", "def_line", "symbol_name", "kind", "id")


_ID = "substr(sha256('corpus::src/d' || doc_id || {suffix} || '::' || symbol_name || '::0'), 1, 16) AS id"
_ITEMS = _LINES + ", l AS (SELECT doc_id, pos AS i FROM d, generate_series(1, len(lines)) g(pos))"


@query(
    _ITEMS
    + """, s AS (SELECT doc_id, i, (1 + 3 * (i - 1) + 3 * ((i - 1) // 4))::INT AS a FROM l),
c AS (SELECT doc_id, a AS start_line, a + 1 AS end_line, a AS def_line, 'f' || i AS symbol_name, 'function' AS kind FROM s WHERE i % 4 <> 0
UNION ALL SELECT doc_id, a, a + 2, a, 'C' || i, 'class' FROM s WHERE i % 4 = 0 UNION ALL SELECT doc_id, a + 3, a + 4, a + 3, 'C' || i || '.run', 'method' FROM s WHERE i % 4 = 0)
SELECT *, """
    + _ID.format(suffix="'.py'")
    + " FROM c"
)
def python_chunks(spark, d):
    """A function for each line of a document, and a class with a method for every fourth."""

    def block(i, n):
        name = i.cast("string")
        function = F.concat(F.lit("def f"), name, F.lit("(a):\n    return "), n, F.lit("\n"))
        klass = F.concat(F.lit("class C"), name, F.lit(":\n    size = "), n, F.lit("\n\n    def run(self):\n        return "), n, F.lit("\n"))
        return F.when(i % 4 == 0, klass).otherwise(function)

    return _derived(spark, d, block, F.lit(".py"))


@query(
    _ITEMS
    + """, b AS (SELECT doc_id, i, CASE WHEN i % 3 = 0 THEN 1 ELSE 0 END AS sep, CASE WHEN i % 5 = 0 THEN 2 ELSE 17 END AS n FROM l),
s AS (SELECT *, (1 + coalesce(sum(sep + n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sep)::INT AS a FROM b),
c AS (SELECT doc_id, a AS start_line, a + 16 AS end_line, a + 1 AS def_line, 'key' || i AS symbol_name FROM s WHERE n = 17 UNION ALL SELECT doc_id, a, a + 1, a, 'a' || i || '..b' || i FROM s WHERE n = 2)
SELECT *, 'yaml_key' AS kind, """
    + _ID.format(suffix="'.yaml'")
    + " FROM c"
)
def yaml_chunks(spark, d):
    """For each line a noted key with a long list, for every fifth two small keys that are packed;
    every third begins another YAML document."""

    def block(i, n):
        name = i.cast("string")
        item = F.concat(F.lit("  - "), F.rpad(n, 60, "x"))
        large = F.concat(F.lit("# note "), name, F.lit("\nkey"), name, F.lit(":\n"), F.array_join(F.array_repeat(item, 15), "\n"))
        small = F.concat(F.lit("a"), name, F.lit(": "), n, F.lit("\nb"), name, F.lit(": 2"))
        return F.concat(F.when(i % 3 == 0, "---\n").otherwise(""), F.when(i % 5 == 0, small).otherwise(large))

    return _derived(spark, d, block, F.lit(".yaml"))


@query(
    _ITEMS
    + """, s AS (SELECT doc_id, i, (CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 1 END + 5 * (i - 1))::INT AS a, CASE doc_id % 3 WHEN 0 THEN '.go' WHEN 1 THEN '.js' ELSE '.rs' END AS suffix FROM l),
c AS (SELECT doc_id, a AS start_line, a + 3 AS end_line, a + 1 AS def_line, 'f' || i AS symbol_name, 'function' AS kind, suffix FROM s)
SELECT * EXCLUDE (suffix), """
    + _ID.format(suffix="suffix")
    + " FROM c"
)
def symbol_chunks(spark, d):
    """A documented function for each line: Go, JavaScript or Rust by the document's number."""
    third = F.col("doc_id") % 3

    def block(i, n):
        name = i.cast("string")
        go = F.concat(F.lit("// Says it.\nfunc f"), name, F.lit("(a int) int {\n\treturn "), n, F.lit("\n}\n"))
        js = F.concat(F.lit("/** says it */\nexport function f"), name, F.lit("(a) {\n  return `}` + "), n, F.lit(";\n}\n"))
        rust = F.concat(F.lit("/// Says it.\npub fn f"), name, F.lit("(a: i32) -> i32 {\n    "), n, F.lit("\n}\n"))
        return F.when(third == 0, go).when(third == 1, js).otherwise(rust)

    return _derived(spark, d, block, F.when(third == 0, ".go").when(third == 1, ".js").otherwise(".rs"), F.when(third == 0, "package p\n\n").otherwise(""))


#: As above, but with the h2 of each cycle between two fence lines, where it is no heading.
_FENCED = (
    _LINES
    + """, l AS (SELECT doc_id, pos, lines[pos] AS line, pos % 9 AS m FROM d, generate_series(1, len(lines)) g(pos)),
f AS (SELECT doc_id, pos, m, CASE m WHEN 1 THEN '# L1 ' || (pos % 5) WHEN 3 THEN '```' WHEN 4 THEN '## L2' WHEN 6 THEN '```' ELSE line END AS line FROM l),
seg AS (SELECT *, sum(CASE WHEN m = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM f),
agg AS (SELECT doc_id, grp, min(pos) AS a, max(pos) FILTER (WHERE regexp_matches(line, '\\S')) AS b, count(*) FILTER (WHERE m <> 1 AND regexp_matches(line, '\\S')) AS body FROM seg GROUP BY doc_id, grp),
num AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS ord FROM agg WHERE body > 0)
"""
)


@query(_FENCED + "SELECT doc_id, ord::INT AS ord, a::INT AS start_line, b::INT AS end_line, 'L1 ' || (a % 5) AS heading FROM num")
def markdown_fences(spark, d):
    """Sections of documents in which fences hide a heading; an open fence takes the rest."""
    lines = table(spark, d, "documents").select("doc_id", lines_of(F.col("text")).alias("lines"))
    mark = lambda x, i: F.when((i + 1) % 9 == 1, F.concat(F.lit("# L1 "), ((i + 1) % 5).cast("string"))).when(((i + 1) % 9).isin(3, 6), "```").when((i + 1) % 9 == 4, "## L2").otherwise(x)
    docs = lines.select("doc_id", F.array_join(F.transform("lines", mark), "\n").alias("text"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), F.lit("corpus").alias("repo_name"))
    return markdown.chunk_markdown(docs, ["doc_id", "file_path", "repo_name"], max_chars=0).select("doc_id", "ord", "start_line", "end_line", "heading")


@query(_LINES + "SELECT doc_id FROM d WHERE len(list_filter(lines, lambda l: length(trim(l)) > 0)) > 40")
def store_delete_where(spark, d):
    """What stays of the documents when those with few solid lines are deleted by key."""
    docs = table(spark, d, "documents")
    solid = F.size(F.filter(lines_of(F.col("text")), lambda x: ~is_blank(x)))
    return reconcile.removed(docs.select("doc_id"), docs.filter(solid <= 40), "doc_id")


@query("SELECT source AS collection, doc_id AS id, lang AS value FROM documents WHERE lang IN ('de', 'fr') AND source <> 'src1'")
def scroll_all_where(spark, d):
    """All rows of some collections whose field has one of several values."""
    docs = table(spark, d, "documents").select(F.col("source").alias("collection"), F.col("doc_id").alias("id"), "lang")
    parts = [catalog.scroll_where(docs, "lang", v, limit=None) for v in ("de", "fr")]
    return parts[0].unionByName(parts[1]).filter("collection <> 'src1'").select("collection", "id", F.col("lang").alias("value"))
