"""Code-graph enrichment as joins over two tables.

nodes: id, label, source_file, source_location, community, community_name, ordinal
links: source, target, relation, confidence, ordinal"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Relations that count as related, for a whole module and for a symbol.
MODULE_RELATIONS = ["calls", "imports", "imports_from", "inherits"]
SYMBOL_RELATIONS = ["calls", "imports", "inherits"]
RELATED_MAX = 10
#: Lines of a file that are one key of the range match.
STRETCH = 64
#: Parts that a node's neighbours are ranked in before the best of all parts are.
SALTS = 16


def plain_label(label: Column) -> Column:
    """The label without a trailing ``()`` and one leading dot."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(label, F.lit("")), r"\(\)$", ""), r"^\.", "")


def placed_nodes(nodes: DataFrame, root: str = "") -> DataFrame:
    """Nodes inside the root, with file_path, line, and qualified label; ids last-wins."""
    clean = F.coalesce(F.col("source_file"), F.lit(""))
    base = root.rstrip("/") + "/"
    inside = F.when(clean.startswith("/"), F.when(clean.startswith(F.lit(base)), F.substring(clean, len(base) + 1, 1 << 30)).otherwise("")).otherwise(
        F.regexp_replace(clean, r"^\./", "")
    )
    line = F.regexp_extract(F.coalesce("source_location", F.lit("")), r"^L(\d+)$", 1)
    out = nodes.withColumn("file_path", inside).filter("file_path <> ''").withColumn("line", F.when(line != "", line.cast("int")))
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("ordinal")))
    return out.withColumn("_n", last).filter("_n = 1").drop("_n").withColumn("qualified", plain_label(F.col("label")))


def qualified_names(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, qualified): the label, or Owner.member where a ``method`` link gives an owner (the
    last such link wins, of links with one ordinal the last owner by name)."""
    known = nodes.select("id", "qualified")
    owners = (
        links.filter("relation = 'method'")
        .join(known.select(F.col("id").alias("source"), F.col("qualified").alias("owner")), "source")
        .groupBy("target").agg(F.max(F.struct("ordinal", "owner"))["owner"].alias("owner"))
    )
    return known.join(owners.withColumnRenamed("target", "id"), "id", "left").select(
        "id", F.when(F.col("owner").isNotNull(), F.concat_ws(".", "owner", "qualified")).otherwise(F.col("qualified")).alias("qualified")
    )


def related(nodes: DataFrame, links: DataFrame, relations: list[str], most: int = RELATED_MAX) -> DataFrame:
    """(id, related_symbols): names of extracted neighbours in either direction, by relation and
    neighbour id, each name once, at most ``most``."""
    ids = nodes.select("id")
    edges = (
        links.filter(F.col("relation").isin(relations) & (F.col("confidence") == "EXTRACTED"))
        .join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
        .join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
        .select("source", "target", "relation")
    )
    both = edges.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "relation")).distinct()
    named = both.join(qualified_names(nodes, links).withColumnRenamed("id", "target"), "target").filter("qualified <> ''")
    first = named.groupBy("source", "qualified").agg(F.min(F.struct("relation", "target")).alias("place"))
    # A hub's neighbours are cut to ``most`` in parts first, so that no task ranks them all.
    part = F.row_number().over(Window.partitionBy("source", "_part").orderBy("place"))
    some = first.withColumn("_part", F.pmod(F.xxhash64("qualified"), F.lit(SALTS))).withColumn("_r", part).filter(F.col("_r") <= most).drop("_part")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("place"))
    top = some.withColumn("_r", rank).filter(F.col("_r") <= most)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_r", "qualified"))), lambda x: x["qualified"])
    return top.groupBy("source").agg(ordered.alias("related_symbols")).withColumnRenamed("source", "id")


def match_chunks(chunks: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``chunks`` (file_path, kind, def_line, start_line, end_line, ``keys``) with node_id.

    Windows match nothing, modules their file's node, other kinds the node on their definition
    line, else the first node inside their lines that is not on line 1. The range match joins
    on the file and a stretch of STRETCH lines, so a file with many nodes is not one key."""
    spots = nodes.filter("line is not null")
    exact = spots.groupBy("file_path", F.col("line").alias("def_line")).agg(F.max_by("id", "ordinal").alias("exact_id"))
    base_name = F.substring_index("file_path", "/", -1)
    files = spots.filter((F.col("line") == 1) & (F.col("label") == base_name)).groupBy("file_path").agg(F.max_by("id", "ordinal").alias("file_id"))
    lookup = chunks.join(exact, ["file_path", "def_line"], "left").join(files, "file_path", "left")
    open_ = lookup.filter("exact_id is null and kind not in ('window', 'module')")
    inside = spots.filter("line > 1").select("file_path", "line", F.col("id").alias("_id"), F.floor(F.col("line") / STRETCH).alias("_at"))
    reach = F.sequence(F.floor(F.col("start_line") / STRETCH), F.floor(F.greatest("start_line", "end_line") / STRETCH))
    near = (
        open_.select(*keys, "file_path", "start_line", "end_line", F.explode(reach).alias("_at")).join(inside, ["file_path", "_at"])
        .filter(F.col("line").between(F.col("start_line"), F.col("end_line")))
        .groupBy(*keys).agg(F.min(F.struct("line", "_id"))["_id"].alias("near_id"))
    )
    node = F.when(F.col("kind") == "module", F.col("file_id")).when(F.col("kind") != "window", F.coalesce("exact_id", "near_id"))
    return lookup.join(near, keys, "left").withColumn("node_id", node).drop("exact_id", "file_id", "near_id")


def enrich(chunks: DataFrame, nodes: DataFrame, links: DataFrame, gods: DataFrame, keys: list[str], most: int = RELATED_MAX) -> DataFrame:
    """Chunks with community, community_name, is_god_node and related_symbols."""
    found = match_chunks(chunks, nodes, keys)
    by_symbol = related(nodes, links, SYMBOL_RELATIONS, most).withColumnRenamed("related_symbols", "_s").withColumnRenamed("id", "node_id")
    by_module = related(nodes, links, MODULE_RELATIONS, most).withColumnRenamed("related_symbols", "_m").withColumnRenamed("id", "node_id")
    info = nodes.select(F.col("id").alias("node_id"), "community", F.coalesce("community_name", F.lit("")).alias("community_name"))
    flags = gods.select(F.col("id").alias("node_id")).distinct().withColumn("_god", F.lit(True))
    out = found.join(info, "node_id", "left").join(flags, "node_id", "left").join(by_symbol, "node_id", "left").join(by_module, "node_id", "left")
    names = F.coalesce(F.when(F.col("kind") == "module", F.col("_m")).otherwise(F.col("_s")), F.array().cast("array<string>"))
    return out.withColumn("community_name", F.coalesce("community_name", F.lit(""))).withColumn("is_god_node", F.coalesce("_god", F.lit(False))).withColumn(
        "related_symbols", names
    ).drop("_god", "_s", "_m")


def god_labels(nodes: DataFrame, links: DataFrame, gods: DataFrame) -> DataFrame:
    """Qualified names of the most connected nodes, sorted."""
    return qualified_names(nodes, links).join(gods.select("id").distinct(), "id", "left_semi").select("qualified").orderBy("qualified")


def read_graph(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of a graph file, in file order."""
    graph = spark.read.json(path, multiLine=True)
    nodes = graph.select(F.posexplode("nodes").alias("ordinal", "n")).select("ordinal", "n.*")
    links = graph.select(F.posexplode("links").alias("ordinal", "n")).select("ordinal", "n.*")
    return nodes, links
