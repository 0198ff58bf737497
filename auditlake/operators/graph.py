"""The code graph: nodes and links, neighbourhoods, closures and paths.

Links are a directed multigraph. Nothing here gathers the neighbours of a node into a list: a hub may have a third
of all links, so results are one row per neighbour or an aggregate that combines before rows move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.paths import is_manifest
from auditlake.session import Scratch, filled, trimmed


def clean_links(links: DataFrame) -> DataFrame:
    """Links with trimmed ends and relation in lower case, each link_id once; blank and null ends or relations are left out."""
    ok = links.where(filled("source") & filled("target") & filled("relation"))
    named = ok.withColumns({"source": trimmed("source"), "target": trimmed("target"), "relation": F.lower(trimmed("relation"))})
    return named.drop("ingested_at").dropDuplicates(["link_id"])


def code_graph(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that are no dependency manifests, and the links whose two ends are among them."""
    kept = nodes.where(~is_manifest("source_file"))
    ids = kept.select(F.col("id").alias("__id"))
    inner = links.join(ids, F.col("source") == F.col("__id"), "left_semi").join(ids, F.col("target") == F.col("__id"), "left_semi")
    return kept, inner


def dangling_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Links with an end that is no node, with which end that is."""
    a, b = nodes.select(F.col("id").alias("__a")), nodes.select(F.col("id").alias("__b"))
    d = links.join(a, F.col("source") == F.col("__a"), "left").join(b, F.col("target") == F.col("__b"), "left")
    end = F.when(F.col("__a").isNull() & F.col("__b").isNull(), "both").when(F.col("__a").isNull(), "source").when(F.col("__b").isNull(), "target")
    return d.withColumn("missing", end).where("missing IS NOT NULL").drop("__a", "__b")


def simple_links(links: DataFrame) -> DataFrame:
    """One link per pair of ends: the one observed last, then of the greatest id; with the number of parallel ones."""
    last = F.max(F.struct("observed_at", "link_id", "relation")).alias("l")
    return links.groupBy("source", "target").agg(last, F.count(F.lit(1)).alias("parallel")).select("source", "target", "l.relation", "l.link_id", "parallel")


def incident_links(links: DataFrame) -> DataFrame:
    """Links seen from each end: (node, other, relation, direction). A link to itself is seen once, as incoming."""
    out = links.where("source <> target").select(F.col("source").alias("node"), F.col("target").alias("other"), "relation", F.lit("out").alias("direction"))
    return links.select(F.col("target").alias("node"), F.col("source").alias("other"), "relation", F.lit("in").alias("direction")).unionByName(out)


def degrees(links: DataFrame) -> DataFrame:
    """Per node its links and different neighbours in both directions. Neighbours are made distinct per pair first, so
    that a hub's are counted from spread rows."""
    pairs = incident_links(links).groupBy("node", "direction", "other").agg(F.count(F.lit(1)).alias("n"))
    side = lambda d, c: F.coalesce(F.sum(F.when(F.col("direction") == d, c)), F.lit(0)).cast("bigint")
    return pairs.groupBy("node").agg(side("in", F.col("n")).alias("links_in"), side("out", F.col("n")).alias("links_out"), side("in", F.lit(1)).alias("predecessors"), side("out", F.lit(1)).alias("successors"))


def callers(links: DataFrame, relation: str = "calls") -> DataFrame:
    """(callee, caller, calls): one row per pair."""
    return links.where(F.col("relation") == relation).groupBy(F.col("target").alias("callee"), F.col("source").alias("caller")).agg(F.count(F.lit(1)).alias("calls"))


def communities(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Per community its nodes, the links within it, and those that leave it and enter it."""
    c = nodes.where("community IS NOT NULL").select("id", "community")
    ends = links.select("source", "target").join(c.withColumnsRenamed({"id": "source", "community": "a"}), "source").join(c.withColumnsRenamed({"id": "target", "community": "b"}), "target")
    flows = ends.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    sides = flows.select(F.col("a").alias("community"), F.when(F.col("a") == F.col("b"), F.col("n")).alias("inner"), F.when(F.col("a") != F.col("b"), F.col("n")).alias("out"), F.lit(None).cast("bigint").alias("in"))
    sides = sides.unionByName(flows.where("a <> b").select(F.col("b").alias("community"), F.lit(None).cast("bigint").alias("inner"), F.lit(None).cast("bigint").alias("out"), F.col("n").alias("in")))
    sums = sides.groupBy("community").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(f"links_{x}") for x in ("inner", "out", "in")])
    size = c.groupBy("community").agg(F.count(F.lit(1)).alias("nodes"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).alias(x)
    return size.join(sums, "community", "left").select("community", "nodes", *[zero(f"links_{x}") for x in ("inner", "out", "in")])


def ancestors(links: DataFrame, relation: str, scratch: Scratch, depth: int = 8) -> DataFrame:
    """(node, ancestor, depth): everything that `relation` leads to in up to `depth` steps, with the shortest way. A
    node is not its own ancestor; cycles end, as a pair is followed once, at its least depth."""
    step = scratch.keep(links.where((F.col("relation") == relation) & (F.col("source") != F.col("target"))).select(F.col("source").alias("node"), F.col("target").alias("ancestor")).distinct())
    up = step.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("__next"))
    found = step.withColumn("depth", F.lit(1))
    newest = found
    for k in range(2, depth + 1):
        reached = newest.select("node", "ancestor").join(up, "ancestor").where(F.col("node") != F.col("__next")).select("node", F.col("__next").alias("ancestor")).distinct()
        newest, rows = scratch.keep_rows(reached.join(found.select("node", "ancestor"), ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(k)))
        if not rows:
            break
        found = found.unionByName(newest)
    return found


# Labels of members, and relations of a class to what it takes members from.
MEMBER_LABEL = r"^\.([A-Za-z_]\w*)\(\)$"
CLASS_RELATIONS = ["inherits", "extends", "implements", "mixes_in"]
# End of the fixed values.


def members(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(container, name, member): what `method` links between nodes say of nodes labelled as members. A container without
    that name gets it by the ids: a member of its file whose id is the container's, an underscore and the name. Of several
    members of a name the smallest id counts."""
    named = nodes.select("id", "source_file", F.lower(F.regexp_extract(F.coalesce("label", F.lit("")), MEMBER_LABEL, 1)).alias("name"))
    m = named.where("name <> ''")
    told = links.where("relation = 'method'").select(F.col("source").alias("container"), "target").distinct().join(nodes.select(F.col("id").alias("container")), "container", "left_semi")
    told = told.join(m.select(F.col("id").alias("target"), "name"), "target").select("container", "name", F.lit(False).alias("weak"), F.col("target").alias("member"))
    cut = F.col("id").substr(F.lit(1), F.length("id") - F.length("name") - 1)
    by_id = m.where(F.endswith("id", F.concat(F.lit("_"), F.col("name")))).select(cut.alias("container"), "name", F.lit(True).alias("weak"), F.col("id").alias("member"), "source_file")
    owner = named.where("name = ''").select(F.col("id").alias("container"), F.col("source_file").alias("__file"))
    by_id = by_id.join(owner, "container").where(F.col("source_file").eqNullSafe(F.col("__file"))).drop("source_file", "__file")
    first = F.min(F.struct("weak", "member")).alias("f")
    return told.unionByName(by_id).groupBy("container", "name").agg(first).select("container", "name", "f.member")


def inherited_members(own: DataFrame, parents: DataFrame, scratch: Scratch, depth: int = 8) -> DataFrame:
    """(node, name, member, owner, depth): each name a node has itself (depth 0) or from its nearest ancestor that has it,
    up to `depth` steps away; equally near ancestors stand in order of their ids. `parents` are pairs (source, target).

    Names go down one step a round, and only those that a node hasn't got yet stay; so a name passes each node once,
    however many ancestors have it, and cycles end.
    """
    step = scratch.keep(parents.where("source <> target").select("source", "target").distinct())
    newest = scratch.keep(own.select(F.col("container").alias("node"), "name", "member", F.col("container").alias("owner"), F.lit(0).alias("depth")))
    found = newest
    for k in range(1, depth + 1):
        below = newest.withColumnRenamed("node", "target").join(step, "target").groupBy(F.col("source").alias("node"), "name").agg(F.min(F.struct("owner", "member")).alias("b"))
        below = below.join(found.select("node", "name"), ["node", "name"], "left_anti").select("node", "name", "b.member", "b.owner", F.lit(k).alias("depth"))
        newest, rows = scratch.keep_rows(below)
        if not rows:
            break
        found = found.unionByName(newest)
    return found


def definitions(symbols: DataFrame, asked: DataFrame, scratch: Scratch) -> DataFrame:
    """(symbol, name, file, start_line, end_line, trail): where each symbol asked for is defined: itself, or for `Class::method`
    the same method of the nearest class up the chain of parents; trail names the classes gone up, in order.

    `symbols` have (name, class, parent, file, start_line, end_line); a class's parent is that of its first symbol by
    file and line, also of several symbols of a name the first counts. A chain ends at a class without parent, one
    that has no symbol, or one seen before. Each class that is asked about in a round is looked up once.
    """
    at = F.struct("file", "start_line", "end_line")
    first = scratch.keep(symbols.where("name IS NOT NULL").groupBy("name").agg(F.min(at).alias("at")))
    ups = symbols.where("class IS NOT NULL").groupBy("class").agg(F.min_by(F.struct("parent"), at).alias("p"))
    ups = scratch.keep(ups.select("class", F.col("p.parent").alias("up")).where("up <> ''"))
    rest = asked.select("symbol").where("symbol IS NOT NULL").distinct()
    hit = lambda d: d.join(first, "name").select("symbol", "name", "at.*", "trail")
    none = F.array().cast("array<string>")
    newest = scratch.keep(rest.select("symbol", F.col("symbol").alias("name"), none.alias("trail")))
    out = hit(newest)
    scoped = F.contains("name", F.lit("::"))
    newest = newest.join(first, "name", "left_anti").where(scoped).select("symbol", F.substring_index("name", "::", 1).alias("class"), F.regexp_replace("name", r"(?s)^.*?::", "").alias("method"), "trail")
    while True:
        up = newest.join(ups, "class").where((F.col("up") != F.substring_index("symbol", "::", 1)) & ~F.array_contains("trail", F.col("up")))
        up, rows = scratch.keep_rows(up.select("symbol", F.col("up").alias("class"), "method", F.concat("trail", F.array("up")).alias("trail"), F.concat("up", F.lit("::"), F.col("method")).alias("name")))
        if not rows:
            return out
        out = out.unionByName(hit(up))
        newest = up.join(first, "name", "left_anti").drop("name")


def shortest_hops(links: DataFrame, starts: DataFrame, scratch: Scratch, max_hops: int = 12) -> DataFrame:
    """(start, node, hops) of everything that each start reaches in up to max_hops, the start itself with 0."""
    step = scratch.keep(links.where("source <> target").select(F.col("source").alias("node"), F.col("target").alias("__next")).distinct())
    found = starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct().withColumn("hops", F.lit(0))
    newest = found
    for k in range(1, max_hops + 1):
        reached = newest.select("start", "node").join(step, "node").select("start", F.col("__next").alias("node")).distinct()
        newest, rows = scratch.keep_rows(reached.join(found.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(k)))
        if not rows:
            break
        found = found.unionByName(newest)
    return found


def simple_paths(links: DataFrame, start: str, end: str, max_hops: int = 12, most: int = 50) -> DataFrame:
    """(hops, path): the simple paths between two nodes, the shortest first, then in order of their nodes, at most
    `most` of them. Each round extends paths by one link, and only through nodes that still reach the end in time."""
    spark = links.sparkSession
    step = links.where("source <> target").select("source", "target").distinct()
    # hops to the end: a path of k links is only extended to nodes at most max_hops - k from it
    back = step.select(F.col("target").alias("source"), F.col("source").alias("target"))
    scratch = Scratch(spark)
    step = scratch.keep(step)
    left = shortest_hops(back, spark.createDataFrame([(end,)], "id string"), scratch, max_hops).select(F.col("node").alias("target"), "hops")
    paths = spark.createDataFrame([(start, [start])], "at string, path array<string>")
    done = paths.where(F.col("at") == end) if start == end else None
    for k in range(1, max_hops + 1):
        grown = paths.where(F.col("at") != end).join(step.join(left.where(F.col("hops") <= max_hops - k), "target"), F.col("at") == F.col("source"))
        paths, rows = scratch.keep_rows(grown.where(~F.array_contains("path", F.col("target"))).select(F.col("target").alias("at"), F.concat("path", F.array("target")).alias("path")))
        hit = paths.where(F.col("at") == end)
        done = hit if done is None else done.unionByName(hit)
        if not rows:
            break
    return done.select((F.size("path") - 1).alias("hops"), "path").orderBy("hops", "path").limit(most)


# Edges between communities ---------------------------------------------------------------------------------------

# Relations that cross a boundary, and marks of targets that say little.
DIRECT_RELATIONS = ["calls", "references", "imports"]
LOW_SIGNAL = [
    "exception", "exceptions", "logger", "logfile", "logging", "constant", "constants", "enum", "enums", "interface", "interfaces", "util", "utils", "helper", "helpers",
    "test", "tests", "spec", "fixture", "fixtures", "migration", "migrations", "dto", "dtos",
]
# End of the fixed values.


def cross_community_edges(nodes: DataFrame, links: DataFrame, noted: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Links between code nodes of different communities, at least one end noted: (source, target, relation, both
    labels and files, match_key, source_noted, target_noted), each (source, target, match_key) once, the smallest link first. References to and imports of
    low-signal targets are left out, as are ends in excluded paths."""
    from auditlake.functions.paths import is_excluded

    n = nodes.where((F.col("file_type") == "code") & F.col("community").isNotNull() & ~is_excluded("source_file", list(excluded)))
    ends = lambda side, c: n.select(F.col("id").alias(side), F.col("community").alias(f"{c}_community"), F.col("label").alias(f"{c}_label"), F.col("source_file").alias(f"{c}_file"))
    has = lambda side: noted.select(F.col("node_id").alias(side)).where(f"{side} IS NOT NULL").distinct().withColumn(f"{side}_noted", F.lit(True))
    e = links.where(F.col("relation").isin(DIRECT_RELATIONS)).select("link_id", "source", "target", "relation")
    e = e.join(ends("source", "source"), "source").join(ends("target", "target"), "target").where("source_community <> target_community")
    weak = F.col("relation").isin("references", "imports") & F.lower(F.coalesce("target_label", F.lit(""))).rlike("|".join(LOW_SIGNAL))
    e = e.where(~weak).join(has("source"), "source", "left").join(has("target"), "target", "left")
    e = e.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("source_noted", "target_noted")}).where("source_noted OR target_noted")
    e = e.withColumn("match_key", F.concat(F.lit("community "), F.col("source_community"), F.lit("->"), F.col("target_community"), F.lit(" via "), F.col("relation")))
    return e.drop("source_community", "target_community").groupBy("source", "target", "match_key").agg(
        F.min("link_id").alias("link_id"), *[F.first(c).alias(c) for c in ("relation", "source_label", "target_label", "source_file", "target_file", "source_noted", "target_noted")]
    )


def top_per_category(edges: DataFrame, category: str, cap: int) -> DataFrame:
    """The first `cap` edges of each category: with notes at both ends, then at the source, then by ends and key. The
    rank limit cuts every task's rows before they move."""
    order = [(F.col("source_noted") & F.col("target_noted")).desc(), F.col("source_noted").desc(), F.col("source"), F.col("target"), F.col("match_key")]
    return edges.withColumn("place", F.row_number().over(Window.partitionBy(category).orderBy(*order))).where(F.col("place") <= cap)


def batches(edges: DataFrame, category: str, size: int, most: int) -> DataFrame:
    """Adds `batch`: runs of `size` edges of a category in order of ends and key, categories in order of name, `most`
    batches in all. For capped edges, of which there are few."""
    order = Window.partitionBy(category).orderBy("source", "target", "match_key")
    d = edges.withColumn("__chunk", F.floor((F.row_number().over(order) - 1) / size))
    return d.withColumn("batch", F.dense_rank().over(Window.orderBy(category, "__chunk")).cast("bigint")).where(F.col("batch") <= most).drop("__chunk")
