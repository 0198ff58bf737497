"""Queries over the code graph: nodes, links and the notes about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.functions import paths, text
from auditlake.operators import demands, graph, groups, ordering, stats
from auditlake.session import Scratch, table, trimmed

QUERIES: dict = {}
SQL: dict[str, str] = {}
_WS = r"' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _links(spark: SparkSession, d: str) -> DataFrame:
    return graph.clean_links(table(spark, d, "links"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes")


_L = f"""l AS (SELECT DISTINCT ON (link_id) link_id, trim(source, {_WS}) AS source, trim(target, {_WS}) AS target, lower(trim(relation, {_WS})) AS relation,
  source_file, source_location, observed_at FROM links
  WHERE length(trim(coalesce(source, ''), {_WS})) > 0 AND length(trim(coalesce(target, ''), {_WS})) > 0 AND length(trim(coalesce(relation, ''), {_WS})) > 0)"""
_LIST = ", ".join(f"'{n}'" for n in paths.MANIFEST_NAMES)
_DIRS = ", ".join(f"'{x}'" for x in paths.EXCLUDED_DIRS)
_BASE = "regexp_extract(source_file, '[^/]*$')"
_GLOBS = " OR ".join([*(f"{_BASE} GLOB '{x}'" for x in paths.EXCLUDED_NAME_GLOBS), *(f"len(list_filter(string_split(source_file, '/'), lambda x: x GLOB '{x}')) > 0" for x in paths.EXCLUDED_DIR_GLOBS)])
#: What the expression of `paths.is_excluded` says, by lists and globs.
_EXCLUDED = f"coalesce(source_file <> '' AND (list_has_any(string_split(source_file, '/'), [{_DIRS}]) OR {_GLOBS}), false)"
_ONE_SPACE = lambda c: f"lower(regexp_replace(trim(coalesce({c}, ''), {_WS}), '\\s+', ' ', 'g'))"
_NAME = f"regexp_replace(lower(trim(label, {_WS})), '^\\.|\\(\\)$', '', 'g')"


@query(f"SELECT id, source_file, {_EXCLUDED} AS excluded, coalesce(regexp_extract(rtrim(source_file, '/'), '[^/]*$') IN ({_LIST}), false) AS manifest FROM nodes")
def excluded_paths(spark, d):
    """Which nodes' files a scan leaves out, and which are dependency manifests."""
    return _nodes(spark, d).select("id", "source_file", paths.is_excluded("source_file").alias("excluded"), paths.is_manifest("source_file").alias("manifest"))


@query(f"""
WITH {_L}, k AS (SELECT id FROM nodes WHERE NOT coalesce(regexp_extract(rtrim(source_file, '/'), '[^/]*$') IN ({_LIST}), false))
SELECT relation, count(*) AS links, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets
FROM l WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k) GROUP BY relation
""")
def graph_links(spark, d):
    """Links between nodes that are no manifests, by relation. Ends are made distinct before they are counted."""
    _, links = graph.code_graph(_nodes(spark, d), _links(spark, d))
    one = lambda c, n: links.select("relation", c).distinct().groupBy("relation").agg(F.count(F.lit(1)).alias(n))
    return links.groupBy("relation").agg(F.count(F.lit(1)).alias("links")).join(one("source", "sources"), "relation").join(one("target", "targets"), "relation")


@query(f"""
WITH {_L} SELECT link_id, source, target, relation, CASE WHEN a.id IS NULL AND b.id IS NULL THEN 'both' WHEN a.id IS NULL THEN 'source' ELSE 'target' END AS missing
FROM l LEFT JOIN nodes a ON a.id = source LEFT JOIN nodes b ON b.id = target WHERE a.id IS NULL OR b.id IS NULL
""")
def dangling_links(spark, d):
    """Links with an end that is no node."""
    return graph.dangling_links(_nodes(spark, d), _links(spark, d)).select("link_id", "source", "target", "relation", "missing")


@query(f"""
WITH {_L} SELECT source, target, relation, link_id, count(*) OVER (PARTITION BY source, target) AS parallel FROM l
QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY observed_at DESC NULLS LAST, link_id DESC) = 1
""")
def simple_links(spark, d):
    """One link per pair of nodes, the one observed last."""
    return graph.simple_links(_links(spark, d))


@query(f"""
WITH {_L}, i AS (SELECT target AS node, source AS other, 'in' AS dir FROM l UNION ALL SELECT source, target, 'out' FROM l WHERE source <> target)
SELECT node, count(*) FILTER (dir = 'in') AS links_in, count(*) FILTER (dir = 'out') AS links_out, count(DISTINCT other) FILTER (dir = 'in') AS predecessors,
  count(DISTINCT other) FILTER (dir = 'out') AS successors FROM i GROUP BY node
""")
def node_degrees(spark, d):
    """Links and different neighbours of every node, in both directions."""
    return graph.degrees(_links(spark, d))


@query(f"WITH {_L} SELECT target AS callee, source AS caller, count(*) AS calls FROM l WHERE relation = 'calls' GROUP BY ALL")
def caller_map(spark, d):
    """Who calls what, one row per pair."""
    return graph.callers(_links(spark, d))


@query(f"""
WITH {_L}, c AS (SELECT id, community FROM nodes WHERE community IS NOT NULL),
e AS (SELECT a.community AS a, b.community AS b FROM l JOIN c a ON a.id = source JOIN c b ON b.id = target)
SELECT community, count(*) AS nodes, coalesce((SELECT count(*) FROM e WHERE a = community AND b = community), 0) AS links_inner,
  coalesce((SELECT count(*) FROM e WHERE a = community AND b <> community), 0) AS links_out, coalesce((SELECT count(*) FROM e WHERE b = community AND a <> community), 0) AS links_in
FROM c GROUP BY community
""")
def communities(spark, d):
    """Size of every community and the links within, out of and into it."""
    return graph.communities(_nodes(spark, d), _links(spark, d))


@query(f"""
WITH RECURSIVE {_L}, s AS (SELECT DISTINCT source, target FROM l WHERE relation = 'inherits' AND source <> target),
r(node, ancestor, depth) AS (SELECT source, target, 1 FROM s UNION SELECT node, s.target, depth + 1 FROM r JOIN s ON s.source = r.ancestor WHERE depth < 8)
SELECT node, ancestor, min(depth) AS depth FROM r WHERE node <> ancestor GROUP BY ALL
""")
def ancestors(spark, d):
    """What every node inherits from, up to eight steps away."""
    return graph.ancestors(_links(spark, d), "inherits", Scratch(spark))


def _members_sql(nodes: str) -> str:
    return f"""labelled AS (SELECT id, source_file, lower(regexp_extract(coalesce(label, ''), '^\\.([A-Za-z_]\\w*)\\(\\)$', 1)) AS name FROM {nodes}),
m AS (SELECT source AS container, name, target AS member, false AS weak FROM l JOIN labelled ON id = target WHERE relation = 'method' AND name <> '' AND source IN (SELECT id FROM {nodes})
  UNION ALL SELECT c.id, a.name, a.id, true FROM labelled a JOIN labelled c ON c.id = substr(a.id, 1, length(a.id) - length(a.name) - 1) AND c.source_file IS NOT DISTINCT FROM a.source_file WHERE a.name <> '' AND c.name = '' AND ends_with(a.id, '_' || a.name)),
own AS (SELECT container, name, arg_min(member, (weak, member)) AS member FROM m GROUP BY ALL)"""


@query(f"WITH {_L}, {_members_sql('nodes')} SELECT * FROM own")
def members(spark, d):
    """The members of every container by name."""
    return graph.members(_nodes(spark, d), _links(spark, d))


_FILED = r"""filed AS (SELECT n.id AS old, CASE WHEN regexp_matches(label, '^\.[A-Za-z_]\w*\(\)$') AND c.id IS NOT NULL THEN c.id || '_' || lower(regexp_extract(label, '^\.([A-Za-z_]\w*)\(\)$', 1)) ELSE n.id END AS id, label, n.source_file
  FROM nodes n LEFT JOIN (SELECT source_file, min(id) AS id FROM nodes WHERE NOT regexp_matches(coalesce(label, ''), '^\.[A-Za-z_]\w*\(\)$') GROUP BY source_file) c ON c.source_file = n.source_file)"""


@query(f"WITH l AS (SELECT 'x' AS source, 'x' AS target, 'none' AS relation), {_FILED}, {_members_sql('filed')} SELECT * FROM own")
def members_by_id(spark, d):
    """The same where only ids tell: members named after the first node of their file that is no member."""
    n, member = _nodes(spark, d), F.regexp_extract(F.coalesce("label", F.lit("")), graph.MEMBER_LABEL, 1)
    first = n.where(member == "").where("source_file IS NOT NULL").groupBy("source_file").agg(F.min("id").alias("first"))
    n = n.join(first, "source_file", "left").withColumn("id", F.when((member != "") & F.col("first").isNotNull(), F.concat("first", F.lit("_"), F.lower(member))).otherwise(F.col("id")))
    return graph.members(n, _links(spark, d).where("relation = 'none'"))


@query(f"""
WITH RECURSIVE {_L}, {_members_sql('nodes')}, s AS (SELECT DISTINCT source, target FROM l WHERE relation = 'inherits' AND source <> target),
r(node, ancestor, depth) AS (SELECT source, target, 1 FROM s UNION SELECT node, s.target, depth + 1 FROM r JOIN s ON s.source = r.ancestor WHERE depth < 8),
c AS (SELECT node, ancestor, min(depth) AS depth FROM r WHERE node <> ancestor GROUP BY ALL),
x AS (SELECT container AS node, name, 0 AS depth, container AS owner, member FROM own UNION ALL SELECT node, name, depth, ancestor, member FROM c JOIN own ON container = ancestor)
SELECT node, name, depth, owner, member FROM x QUALIFY row_number() OVER (PARTITION BY node, name ORDER BY depth, owner, member) = 1
""")
def inherited_members(spark, d):
    """Every member that a node has, itself or from its nearest ancestor."""
    links = _links(spark, d)
    return graph.inherited_members(graph.members(_nodes(spark, d), links), links.where("relation = 'inherits'"), Scratch(spark))


_SYMBOLS = f"""up AS (SELECT source AS id, min(target) AS up FROM l WHERE relation = 'inherits' AND source <> target GROUP BY source),
named AS (SELECT id, {_NAME} AS name, source_file, coalesce(try_cast(regexp_replace(trim(source_location, {_WS}), '^[lL]', '') AS INTEGER), 0) AS line FROM nodes WHERE {_NAME} <> ''),
symbols AS (SELECT c.name || '::' || o.name AS name, c.name AS class, p.name AS parent, m.source_file AS file, m.line AS start_line FROM own o JOIN named c ON c.id = o.container JOIN named m ON m.id = o.member LEFT JOIN up ON up.id = c.id LEFT JOIN named p ON p.id = up.up
  UNION ALL SELECT name, NULL, NULL, source_file, line FROM named),
asked AS (SELECT c.name || '::' || o.name AS symbol FROM own o JOIN l ON l.target = o.container AND relation = 'inherits' JOIN named c ON c.id = l.source UNION SELECT name FROM named)"""


@query(f"""
WITH RECURSIVE {_L}, {_members_sql('nodes')}, {_SYMBOLS},
first_of AS (SELECT name, min((file, start_line)) AS place FROM symbols GROUP BY name),
ups AS (SELECT class, arg_min(coalesce(parent, ''), (file, start_line)) AS up FROM symbols WHERE class IS NOT NULL GROUP BY class),
r(symbol, name, class, method, trail) AS (SELECT symbol, symbol, split_part(symbol, '::', 1), substr(symbol, strpos(symbol, '::') + 2), CAST([] AS VARCHAR[]) FROM asked
  UNION ALL SELECT symbol, up || '::' || method, up, method, list_append(trail, up) FROM r JOIN ups USING (class) WHERE contains(symbol, '::') AND up <> '' AND up <> split_part(symbol, '::', 1) AND NOT list_contains(trail, up) AND name NOT IN (SELECT name FROM first_of))
SELECT symbol, r.name, place[1] AS file, place[2] AS start_line, trail FROM r JOIN first_of USING (name)
""")
def definitions(spark, d):
    """Where every name, and every method asked of a class that inherits, is defined, and which classes were gone up."""
    n, links = _nodes(spark, d), _links(spark, d)
    named = n.select("id", text.member_name("label").alias("name"), "source_file", F.coalesce(text.line_number("source_location"), F.lit(0)).alias("line")).where("name <> ''")
    own = graph.members(n, links)
    up = links.where("relation = 'inherits' AND source <> target").groupBy(F.col("source").alias("cid")).agg(F.min("target").alias("pid"))
    is_ = lambda i, c, *more: named.select(F.col("id").alias(i), F.col("name").alias(c), *more)
    of = own.withColumnsRenamed({"container": "cid", "member": "mid", "name": "method"}).join(is_("cid", "class"), "cid")
    scoped = of.join(named.select(F.col("id").alias("mid"), F.col("source_file").alias("file"), F.col("line").alias("start_line")), "mid").join(up, "cid", "left").join(is_("pid", "parent"), "pid", "left")
    symbols = scoped.select(F.concat_ws("::", "class", "method").alias("name"), "class", "parent", "file", "start_line")
    symbols = symbols.unionByName(named.select("name", F.lit(None).cast("string").alias("class"), F.lit(None).cast("string").alias("parent"), F.col("source_file").alias("file"), F.col("line").alias("start_line")))
    heirs = links.where("relation = 'inherits'").select(F.col("source").alias("sid"), F.col("target").alias("cid")).join(is_("sid", "heir"), "sid")
    asked = own.select(F.col("container").alias("cid"), "name").join(heirs, "cid").select(F.concat_ws("::", "heir", "name").alias("symbol")).unionByName(named.select(F.col("name").alias("symbol"))).distinct()
    return graph.definitions(symbols.withColumn("end_line", F.col("start_line")), asked, Scratch(spark)).select("symbol", "name", "file", "start_line", "trail")


@query(f"""
WITH RECURSIVE {_L}, s AS (SELECT DISTINCT source, target FROM l WHERE relation = 'inherits' AND source <> target),
r(start, node, hops) AS (SELECT DISTINCT source, source, 0 FROM s UNION SELECT start, s.target, hops + 1 FROM r JOIN s ON s.source = r.node WHERE hops < 12)
SELECT start, node, min(hops) AS hops FROM r GROUP BY ALL
""")
def inheritance_hops(spark, d):
    """What every node reaches over inheritance, and how far away it is."""
    links = _links(spark, d).where("relation = 'inherits'")
    return graph.shortest_hops(links, links.where("source <> target").select(F.col("source").alias("id")), Scratch(spark))


_LOW = ", ".join(f"'{x}'" for x in graph.LOW_SIGNAL)
_EDGES = f"""n AS (SELECT id, community, label, source_file FROM nodes WHERE file_type = 'code' AND community IS NOT NULL AND NOT {_EXCLUDED}),
noted AS (SELECT DISTINCT node_id FROM notes WHERE node_id IS NOT NULL),
e AS (SELECT source, target, 'community ' || a.community || '->' || b.community || ' via ' || relation AS match_key, link_id, relation, a.label AS source_label, b.label AS target_label,
    a.source_file AS source_file, b.source_file AS target_file, source IN (SELECT node_id FROM noted) AS source_noted, target IN (SELECT node_id FROM noted) AS target_noted
  FROM (SELECT link_id, source, target, relation FROM l) l JOIN n a ON a.id = source JOIN n b ON b.id = target
  WHERE relation IN ('calls', 'references', 'imports') AND a.community <> b.community AND NOT (relation IN ('references', 'imports') AND len(list_filter([{_LOW}], lambda x: contains(lower(coalesce(b.label, '')), x))) > 0)),
edges AS (SELECT * FROM e WHERE source_noted OR target_noted QUALIFY row_number() OVER (PARTITION BY source, target, match_key ORDER BY link_id) = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY (source_noted AND target_noted) DESC, source_noted DESC, source, target, match_key) AS place FROM edges)"""


@query(f"WITH {_L}, {_EDGES} SELECT * FROM edges")
def cross_community_edges(spark, d):
    """Links that cross communities, with what is known of both ends."""
    return graph.cross_community_edges(_nodes(spark, d), _links(spark, d), table(spark, d, "notes"))


@query(f"WITH {_L}, {_EDGES} SELECT relation, source, target, match_key, place FROM top WHERE place <= 150")
def top_edges(spark, d):
    """The 150 first edges of each relation."""
    return graph.top_per_category(cross_community_edges(spark, d), "relation", 150).select("relation", "source", "target", "match_key", "place")


@query(f"""
WITH {_L}, {_EDGES}, c AS (SELECT relation, source, target, match_key, (row_number() OVER (PARTITION BY relation ORDER BY source, target, match_key) - 1) // 8 AS chunk FROM top WHERE place <= 150),
b AS (SELECT *, dense_rank() OVER (ORDER BY relation, chunk) AS batch FROM c)
SELECT relation, source, target, match_key, batch FROM b WHERE batch <= 12
""")
def edge_batches(spark, d):
    """The first twelve batches of eight such edges."""
    return graph.batches(top_edges(spark, d), "relation", 8, 12).select("relation", "source", "target", "match_key", "batch")


@query(f"WITH {_L}, {_EDGES} SELECT relation, count(*) AS edges, count_if(source_noted AND target_noted) AS both_noted FROM edges GROUP BY relation")
def edge_summary(spark, d):
    """Edges per relation."""
    return cross_community_edges(spark, d).groupBy("relation").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("source_noted") & F.col("target_noted")).alias("both_noted"))


@query(f"""
SELECT source_file, count(*) AS nodes, min(try_cast(regexp_replace(trim(source_location, {_WS}), '^[lL]', '') AS INTEGER)) AS first_line,
  max(try_cast(regexp_replace(trim(source_location, {_WS}), '^[lL]', '') AS INTEGER)) AS last_line, count(DISTINCT community) AS communities
FROM nodes WHERE source_file <> '' GROUP BY source_file
""")
def code_files(spark, d):
    """Every file once, with its nodes and the lines they span."""
    line = text.line_number("source_location")
    n = _nodes(spark, d).where("source_file <> ''")
    return n.groupBy("source_file").agg(F.count(F.lit(1)).alias("nodes"), F.min(line).alias("first_line"), F.max(line).alias("last_line"), F.count_distinct("community").alias("communities"))


@query(r"""
SELECT lower(regexp_extract(regexp_extract(rtrim(source_file, '/'), '[^/]*$'), '[^.](\.[^.]+)$', 1)) AS extension, count(*) AS files
FROM (SELECT DISTINCT source_file FROM nodes WHERE source_file <> '') GROUP BY 1
""")
def file_kinds(spark, d):
    """Files by extension."""
    return _nodes(spark, d).where("source_file <> ''").select("source_file").distinct().groupBy(paths.extension("source_file").alias("extension")).agg(F.count(F.lit(1)).alias("files"))


ROLES = {
    "access": ["auth", "guard", "session", "role"],
    "storage": ["store", "mapper", "query", "save"],
    "surface": ["controller", "view", "route", "handler"],
    "jobs": ["job", "worker", "sync", "publish"],
}


def _role_sql() -> str:
    def side(src: str, w: int) -> str:
        flags = ", ".join(f"max(CASE WHEN contains(lower(coalesce(text, '')), '{k}') THEN {w} ELSE 0 END) AS {r}_{i}" for r, ks in ROLES.items() for i, k in enumerate(ks))
        return f"SELECT community, item, {flags} FROM {src} GROUP BY ALL"

    sums = ", ".join(f"sum({' + '.join(f'{r}_{i}' for i in range(len(ks)))}) AS {r}" for r, ks in ROLES.items())
    rows = " UNION ALL ".join(f"SELECT community, '{r}' AS role, {n} AS nth, CAST({r} AS BIGINT) AS score FROM s" for n, r in enumerate(ROLES))
    return f"""
WITH {_L}, own AS (SELECT community, id AS item, concat_ws(' ', label, source_file, id) AS text FROM nodes WHERE community IS NOT NULL),
near AS (SELECT a.community, a.id AS item, b.label AS text FROM (SELECT DISTINCT source, target FROM l) x JOIN nodes a ON a.id = x.source JOIN nodes b ON b.id = x.target WHERE a.community IS NOT NULL),
both_sides AS ({side('own', 2)} UNION ALL {side('near', 1)}), s AS (SELECT community, {sums} FROM both_sides GROUP BY community), r AS ({rows}),
p AS (SELECT *, greatest(2, floor(max(score) OVER (PARTITION BY community) * 0.5)) AS least, row_number() OVER (PARTITION BY community ORDER BY score DESC, nth) AS place FROM r)
SELECT community, role, score, place FROM p WHERE score >= least AND place <= 2
UNION ALL SELECT community, 'general', 0, 1 FROM p WHERE place = 1 AND score < least
"""


@query(_role_sql())
def community_roles(spark, d):
    """The two roles that the words of each community and its neighbours speak for most."""
    nodes = _nodes(spark, d)
    c = nodes.where("community IS NOT NULL").select("community", F.col("id").alias("item"), F.concat_ws(" ", "label", "source_file", "id").alias("text"))
    pairs = _links(spark, d).select("source", "target").distinct()
    near = pairs.join(c.select("community", F.col("item").alias("source")), "source").join(nodes.select(F.col("id").alias("target"), F.col("label").alias("text")), "target")
    return stats.top_roles(stats.role_scores(c, near.select("community", F.col("source").alias("item"), "text"), "community", ROLES), "community", 2, "general")


# Demands: those of the notes, and what each link would ask for, written in every way that a resolution knows. For that some
# functions are nodes once more, as a member and as a function of the same name.

_NAMED = r"""nn AS (SELECT id, label, source_file FROM nodes
  UNION ALL SELECT id || '_m', '.' || label, source_file FROM nodes WHERE regexp_matches(label, '^[a-z_]\w*\(\)$') AND length(id) % 4 = 0
  UNION ALL SELECT id || '_f', label, source_file FROM nodes WHERE regexp_matches(label, '^[a-z_]\w*\(\)$') AND length(id) % 4 = 1)"""
_GRAPH = f"""
homes AS (SELECT member AS node_id, min(container) AS home FROM own GROUP BY member),
up0 AS (SELECT DISTINCT source, target FROM l WHERE relation IN ('inherits', 'extends', 'implements', 'mixes_in') AND source <> target AND source IN (SELECT id FROM nn) AND target IN (SELECT id FROM nn)),
cont AS (SELECT container FROM own UNION SELECT source FROM up0 UNION SELECT target FROM up0),
par AS (SELECT source, target FROM up0 WHERE source NOT IN (SELECT node_id FROM homes)),
walk(node, ancestor, depth) AS (SELECT source, target, 1 FROM par UNION SELECT node, par.target, depth + 1 FROM walk JOIN par ON par.source = walk.ancestor WHERE depth < 8),
clo AS (SELECT node, ancestor, min(depth) AS depth FROM walk WHERE node <> ancestor GROUP BY ALL),
keys AS (SELECT hint, container, min(nth) AS nth FROM (
    SELECT {_NAME} AS hint, id AS container, 0 AS nth FROM nn WHERE id IN (SELECT container FROM cont)
    UNION ALL SELECT lower(regexp_extract(coalesce(source_file, ''), '([^/]+?)(?:\\.[^./]*)?/*$', 1)), id, 1 FROM nn WHERE id IN (SELECT container FROM cont)) WHERE hint <> '' GROUP BY ALL),
lab AS (SELECT id, lower(replace(source_file, '\\', '/')) AS file, lower(coalesce(label, '')) AS label, regexp_replace(lower(coalesce(label, '')), '\\(\\)$', '') AS bare, coalesce({_NAME}, '') AS name FROM nn WHERE source_file <> ''),
home_of AS (SELECT nn.id AS node_id, coalesce(h.home, c.container) AS home FROM nn LEFT JOIN homes h ON h.node_id = nn.id LEFT JOIN cont c ON c.container = nn.id)"""
_LINK_DEMANDS = f"""
first_own AS (SELECT container, min(name) AS name FROM own GROUP BY container),
up_own AS (SELECT node, arg_min(ancestor, (depth, ancestor)) AS ancestor, min(o.name) AS name FROM clo LEFT JOIN first_own o ON o.container = ancestor GROUP BY node),
par_own AS (SELECT source AS node, min(name) AS name FROM par JOIN first_own ON container = target GROUP BY source),
shown AS (SELECT id, coalesce(label, '') AS label, coalesce({_NAME}, '') AS name, coalesce(source_file, '') AS file, regexp_extract(coalesce(source_file, ''), '([^/]+?)(?:\\.[^./]*)?/*$', 1) AS stem FROM nn),
asked_links AS (SELECT link_id, l.node_id, link_id % 12 AS kind, up, t.label, t.name, t.stem, tc.label AS class, hc.label AS own_class, fo.name AS own_name, uo.name AS up_name, ua.label AS up_class, po.name AS par_name
  FROM (SELECT link_id, source AS node_id, target, 0 AS up FROM l WHERE (link_id // 12) % 2 = 0 UNION ALL SELECT min(link_id), target, target, 1 FROM l WHERE (link_id // 12) % 2 = 1 GROUP BY target, link_id % 12) l JOIN shown t ON t.id = l.target JOIN home_of h ON h.node_id = l.node_id LEFT JOIN homes th ON th.node_id = l.target LEFT JOIN shown tc ON tc.id = th.home
  LEFT JOIN shown hc ON hc.id = h.home LEFT JOIN first_own fo ON fo.container = h.home LEFT JOIN up_own uo ON uo.node = h.home LEFT JOIN shown ua ON ua.id = uo.ancestor LEFT JOIN par_own po ON po.node = h.home),
link_demands AS (SELECT -link_id AS note_id, node_id, CASE WHEN up = 1 THEN 'upstream' ELSE 'downstream' END AS direction, 0 AS pos, 'link ' || link_id // 5 AS description, CASE kind
  WHEN 1 THEN coalesce(class, label) || '::' || name || '(a, b)' WHEN 2 THEN stem || '.' || name || '()' WHEN 3 THEN stem || '.' || left(name, greatest(length(name) - 2, 1)) || '(x)' WHEN 4 THEN '$this->' || coalesce(own_name, name) || '()'
  WHEN 5 THEN 'parent::' || coalesce(par_name, name) || '()' WHEN 6 THEN 'Nosuch::' || name || '(1)' WHEN 7 THEN coalesce(own_class, label) || '::zz_' || name || '()' WHEN 8 THEN 'zz_' || name || '()'
  WHEN 9 THEN coalesce(up_class, label) || '::' || coalesce(own_name, name) || '()' WHEN 10 THEN 'self::' || coalesce(up_name, name) || '()' WHEN 11 THEN '($' || name || ')' ELSE name || '(a, b)' END AS target FROM asked_links)"""
_ASKED = f"""
notes1 AS (SELECT DISTINCT ON (note_id) note_id, node_id, upstream, downstream FROM notes WHERE node_id IS NOT NULL),
e0 AS (SELECT note_id, node_id, 'upstream' AS direction, unnest(upstream) AS e, generate_subscripts(upstream, 1) - 1 AS pos FROM notes1
  UNION ALL SELECT note_id, node_id, 'downstream', unnest(downstream), generate_subscripts(downstream, 1) - 1 FROM notes1),
e1 AS (SELECT note_id, node_id, direction, pos, e.description AS description, e.target AS target FROM e0 WHERE length(trim(coalesce(e.target, ''), {_WS})) > 0 UNION ALL SELECT note_id, node_id, direction, pos, description, target FROM link_demands)"""


def _parsed(rows: str) -> str:
    """The module and symbol of the targets in `rows`, as `asked`."""
    return f"""
p1 AS (SELECT *, trim(replace(regexp_replace(target, '\\(.*?\\)', '', 'g'), '`', ''), {_WS}) AS c FROM {rows}),
p2 AS (SELECT *, CASE WHEN contains(c, '::') THEN split_part(c, '::', 1) ELSE '' END AS m0, CASE WHEN contains(c, '::') THEN substr(c, strpos(c, '::') + 2) ELSE c END AS r0 FROM p1),
p3 AS (SELECT *, contains(r0, '->') AS arrow, trim(rtrim(regexp_extract(r0, '(?s)^(.*)->', 1), '()'), {_WS}) AS receiver FROM p2),
p4 AS (SELECT *, trim(CASE WHEN arrow AND m0 = '' AND (NOT starts_with(receiver, '$') OR lower(receiver) = '$this') THEN receiver ELSE m0 END, {_WS}) AS m1, CASE WHEN arrow THEN regexp_extract(r0, '(?s)^.*->(.*)$', 1) ELSE r0 END AS r1 FROM p3),
p5 AS (SELECT *, m1 = '' AND contains(r1, '.') AND NOT starts_with(r1, '.') AS dotted FROM p4),
asked AS (SELECT note_id, node_id, direction, pos, target, description, CASE WHEN dotted THEN regexp_extract(r1, '(?s)^(.*)\\.[^.]*$', 1) ELSE m1 END AS module,
  trim(regexp_replace(CASE WHEN dotted THEN regexp_extract(r1, '(?s)^.*\\.(.*)$', 1) ELSE r1 END, '\\(.*$', ''), {_WS}) AS symbol FROM p5)"""


_RESOLVED = f"""
q1 AS (SELECT DISTINCT node_id, module, symbol, CASE WHEN lower(trim(module, {_WS})) IN ('global', 'none', 'null') THEN '' ELSE lower(trim(module, {_WS})) END AS m0, trim(symbol, {_WS}) AS s0 FROM asked),
q2 AS (SELECT q1.*, h.home, m0 IN ('parent', 'static', 'self', 'this', '$this') AS pronoun, regexp_replace(CASE WHEN contains(s0, '/') THEN trim(split_part(s0, '/', 1), {_WS}) ELSE s0 END, '\\(\\)$', '') AS b FROM q1 LEFT JOIN home_of h USING (node_id)),
q3 AS (SELECT *, CASE WHEN contains(b, '::') THEN split_part(b, '::', 1) WHEN contains(b, '.') THEN split_part(b, '.', 1) ELSE '' END AS cls, CASE WHEN contains(b, '::') THEN substr(b, strpos(b, '::') + 2) WHEN contains(b, '.') THEN substr(b, strpos(b, '.') + 1) ELSE b END AS rest,
  CASE WHEN pronoun OR starts_with(m0, '$') THEN '' ELSE m0 END AS m FROM q2),
q4 AS (SELECT node_id, module, symbol, m0, s0, home, pronoun, lower(rest) AS sym, regexp_replace(lower(trim(rest, {_WS})), '^\\.|\\(\\)$', '', 'g') AS name, regexp_replace(lower(s0), '^\\.|\\(\\)$', '', 'g') AS own_name,
  regexp_extract(translate(m, '.\\', '//'), '[^/]*$') AS base, lower(cls) AS cls FROM q3),
q5 AS (SELECT *, base <> '' AS of_file, CASE WHEN base <> '' THEN base ELSE cls END AS file_hint, CASE WHEN cls <> '' THEN cls ELSE base END AS hint FROM q4),
scope_of AS (SELECT container AS start, container, 0 AS depth FROM cont UNION ALL SELECT node, ancestor, depth FROM clo),
scoped AS (SELECT start, o.name, arg_min(o.member, (depth, s.container)) AS found FROM scope_of s JOIN own o ON o.container = s.container GROUP BY ALL),
above AS (SELECT p.source AS start, o.name, arg_min(o.member, p.target) AS found FROM par p JOIN own o ON o.container = p.target GROUP BY ALL),
files AS (SELECT f.file_hint, f.of_file, f.sym, min(id) FILTER (label = sym OR bare = sym OR ends_with(bare, '::' || sym) OR ends_with(bare, '->' || sym) OR ends_with(bare, '.' || sym)) AS strict, min(id) FILTER (sym <> '') AS loose
  FROM (SELECT DISTINCT file_hint, of_file, sym FROM q5 WHERE file_hint <> '' AND s0 <> '') f JOIN lab ON contains(label, sym) AND (contains(file, file_hint) OR (NOT of_file AND contains(label, file_hint))) GROUP BY ALL),
classes AS (SELECT hint, o.name, arg_min(o.member, (depth, nth, s.container)) AS found FROM keys k JOIN scope_of s ON s.start = k.container AND depth <= 7 JOIN own o ON o.container = s.container WHERE hint IN (SELECT hint FROM q5) GROUP BY ALL),
heirs AS (SELECT DISTINCT node AS home, hint FROM clo JOIN keys ON container = ancestor),
names AS (SELECT name, count(*) AS named, min(id) AS single, count_if(bare = name) AS functions, min(id) FILTER (bare = name) AS fn FROM lab WHERE name <> '' GROUP BY name),
q6 AS (SELECT q5.*, CASE WHEN pronoun THEN CASE WHEN m0 = 'parent' THEN ab.found ELSE sc.found END END AS in_scope, fi.strict, fi.loose, cl.found AS in_class, CASE WHEN he.home IS NOT NULL THEN oc.found END AS in_own, named, single, functions, fn, q5.hint IN (SELECT hint FROM keys) AS known
  FROM q5 LEFT JOIN scoped sc ON sc.start = q5.home AND sc.name = q5.own_name LEFT JOIN above ab ON ab.start = q5.home AND ab.name = q5.own_name
  LEFT JOIN files fi ON fi.file_hint = q5.file_hint AND fi.of_file = q5.of_file AND fi.sym = q5.sym LEFT JOIN classes cl ON cl.hint = q5.hint AND cl.name = q5.name
  LEFT JOIN heirs he ON he.home = q5.home AND he.hint = q5.hint LEFT JOIN scoped oc ON oc.start = q5.home AND oc.name = q5.name LEFT JOIN names na ON na.name = q5.name),
q7 AS (SELECT *, CASE WHEN s0 = '' THEN NULL WHEN in_scope IS NOT NULL THEN 'scope' WHEN file_hint <> '' THEN CASE WHEN strict IS NOT NULL THEN 'file' WHEN loose IS NOT NULL THEN 'part' WHEN in_class IS NOT NULL THEN 'inherited' WHEN in_own IS NOT NULL THEN 'caller' END
  WHEN named = 1 THEN 'name' WHEN functions = 1 THEN 'function' END AS stage FROM q6),
answers AS (SELECT node_id, module, symbol, stage, CASE stage WHEN 'scope' THEN in_scope WHEN 'file' THEN strict WHEN 'part' THEN loose WHEN 'inherited' THEN in_class WHEN 'caller' THEN in_own WHEN 'name' THEN single WHEN 'function' THEN fn END AS resolved,
  CASE WHEN stage IS NULL THEN CASE WHEN s0 = '' THEN 'no-symbol' WHEN file_hint = '' THEN CASE WHEN named IS NOT NULL THEN 'global-ambiguous' ELSE 'global-none' END WHEN known THEN 'method-absent' ELSE 'class-absent' END END AS miss FROM q7),
staged AS (SELECT asked.*, stage, resolved, miss FROM asked JOIN answers USING (node_id, module, symbol))"""
_RESOLVER = f"WITH RECURSIVE {_L}, {_NAMED}, {_members_sql('nn')}, {_GRAPH}, {_LINK_DEMANDS}, {_ASKED}"


def _named_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d).select("id", "label", "source_file")
    function = n.where(F.col("label").rlike(r"^[a-z_]\w*\(\)$"))
    again = lambda rest, mark, label: function.where(F.length("id") % 4 == rest).select(F.concat("id", F.lit(mark)).alias("id"), label.alias("label"), "source_file")
    return n.unionByName(again(0, "_m", F.concat(F.lit("."), "label"))).unionByName(again(1, "_f", F.col("label")))


def _link_demands(r: demands.Resolver, nodes: DataFrame, links: DataFrame) -> DataFrame:
    own = r.members.groupBy("container").agg(F.min("name").alias("name"))
    up = r.closure.join(own.select(F.col("container").alias("ancestor"), F.col("name").alias("up_name")), "ancestor", "left").groupBy(F.col("node").alias("home")).agg(F.min(F.struct("depth", "ancestor")).alias("a"), F.min("up_name").alias("up_name"))
    par = r.parents.join(own.withColumnRenamed("container", "target"), "target").groupBy(F.col("source").alias("home")).agg(F.min("name").alias("par_name"))
    stem = F.regexp_extract(F.coalesce("source_file", F.lit("")), r"([^/]+?)(?:\.[^./]*)?/*$", 1)
    shown = nodes.select("id", F.coalesce("label", F.lit("")).alias("label"), F.coalesce(text.member_name("label"), F.lit("")).alias("name"), stem.alias("stem"))
    titled = lambda i, c: shown.select(F.col("id").alias(i), F.col("label").alias(c))
    # half of them are asked by the node that is called, once in each way
    called = links.where(F.floor(F.col("link_id") / 12) % 2 == 1).groupBy("target", F.col("link_id") % 12).agg(F.min("link_id").alias("link_id")).select("link_id", F.col("target").alias("node_id"), "target", F.lit("upstream").alias("direction"))
    asked = links.where(F.floor(F.col("link_id") / 12) % 2 == 0).select("link_id", F.col("source").alias("node_id"), "target", F.lit("downstream").alias("direction"))
    x = asked.unionByName(called).join(shown.withColumnRenamed("id", "target"), "target").join(nodes.select(F.col("id").alias("node_id")), "node_id")
    x = x.join(r.homes, "node_id", "left").join(r.containers.select(F.col("container").alias("node_id"), F.col("container").alias("__c")), "node_id", "left").withColumn("home", F.coalesce("home", "__c")).drop("__c")
    x = x.join(r.homes.withColumnsRenamed({"node_id": "target", "home": "tid"}), "target", "left").join(titled("tid", "class"), "tid", "left").join(titled("home", "own_class"), "home", "left")
    x = x.join(own.withColumnsRenamed({"container": "home", "name": "own_name"}), "home", "left").join(up.select("home", "up_name", F.col("a.ancestor").alias("aid")), "home", "left").join(titled("aid", "up_class"), "aid", "left").join(par, "home", "left")
    c, name = F.concat, F.col("name")
    ways = {
        1: c(F.coalesce("class", "label"), F.lit("::"), name, F.lit("(a, b)")), 2: c("stem", F.lit("."), name, F.lit("()")), 3: c("stem", F.lit("."), F.substring(name, F.lit(1), F.greatest(F.length(name) - 2, F.lit(1))), F.lit("(x)")),
        4: c(F.lit("$this->"), F.coalesce("own_name", name), F.lit("()")), 5: c(F.lit("parent::"), F.coalesce("par_name", name), F.lit("()")), 6: c(F.lit("Nosuch::"), name, F.lit("(1)")),
        7: c(F.coalesce("own_class", "label"), F.lit("::zz_"), name, F.lit("()")), 8: c(F.lit("zz_"), name, F.lit("()")), 9: c(F.coalesce("up_class", "label"), F.lit("::"), F.coalesce("own_name", name), F.lit("()")),
        10: c(F.lit("self::"), F.coalesce("up_name", name), F.lit("()")), 11: c(F.lit("($"), name, F.lit(")")),
    }
    target = c(name, F.lit("(a, b)"))
    for k, way in ways.items():
        target = F.when(F.col("link_id") % 12 == k, way).otherwise(target)
    module, symbol = text.call_target("target")
    x = x.select((-F.col("link_id")).alias("note_id"), "node_id", "direction", F.lit(0).alias("pos"), target.alias("target"), F.concat(F.lit("link "), F.floor(F.col("link_id") / 5)).alias("description"))
    return x.withColumns({"module": module, "symbol": symbol})


def _asked(spark: SparkSession, d: str) -> tuple[demands.Resolver, DataFrame, DataFrame, DataFrame]:
    """The resolver, its nodes, the links, and all demands, kept."""
    scratch, links = Scratch(spark), _links(spark, d)
    links, nodes = scratch.keep(links.select("link_id", "source", "target", "relation")), _named_nodes(spark, d)
    r = demands.Resolver(nodes, links, scratch)
    asked = demands.note_demands(table(spark, d, "notes")).unionByName(_link_demands(r, nodes, links))
    return r, nodes, links, scratch.keep(asked)


@query(f"""
{_RESOLVER}, {_parsed('e1')}, {_RESOLVED}
SELECT note_id, direction, CAST(pos AS INTEGER) AS pos, module, symbol, stage, resolved, miss FROM staged
""")
def note_targets(spark, d):
    """What the targets of notes, and those that links would ask for, resolve to."""
    r, _, _, asked = _asked(spark, d)
    return r.resolve(asked).select("note_id", "direction", "pos", "module", "symbol", "stage", "resolved", "miss")


_DOWN = f"""
down AS (SELECT resolved AS target_node, node_id AS source, description, {_ONE_SPACE("description")} AS norm FROM staged WHERE direction = 'downstream' AND resolved IS NOT NULL AND resolved <> node_id),
merged AS (SELECT target_node, min((source, description)) AS f, count(*) AS merged FROM down GROUP BY target_node, norm),
numbered AS (SELECT target_node, f[1] AS source, f[2] AS description, merged, row_number() OVER (PARTITION BY target_node ORDER BY f[1], f[2]) - 1 AS rn FROM merged)"""


@query(f"""
{_RESOLVER}, {_parsed('e1')}, {_RESOLVED}, {_DOWN}
SELECT target_node, source, description, merged, 'D' || rn AS demand_id, rn // 15 AS slice FROM numbered
""")
def downstream_demands(spark, d):
    """What is asked of the nodes that targets name, exact repeats merged and numbered per node, in slices of 15."""
    r, _, _, asked = _asked(spark, d)
    merged = demands.distinct_demands(demands.route_downstream(r.resolve(asked)), upstream=False)
    n = ordering.with_row_numbers(merged, ["target_node"], ["source", "description"], Scratch(spark))
    return n.select("target_node", "source", "description", "merged", F.concat(F.lit("D"), F.col("rn") - 1).alias("demand_id"), F.floor((F.col("rn") - 1) / 15).alias("slice"))


_SHAPED = f"""
s1 AS (SELECT *, trim(list_extract(string_split(trim(replace(target, '`', ''), {_WS}), '->'), -1), {_WS}) AS head FROM e1 WHERE direction = 'upstream'),
s2 AS (SELECT *, trim(split_part(head, '(', 1), {_WS}) AS before FROM s1),
s3 AS (SELECT *, contains(before, '::') AS scoped, contains(head, '(') AS called, contains(before, '.') AS dotted FROM s2),
s4 AS (SELECT *, trim(split_part(trim(CASE WHEN scoped THEN substr(head, strpos(head, '::') + 2) WHEN called AND dotted THEN regexp_extract(before, '[^.]*$') WHEN called THEN before ELSE '' END, {_WS}), '(', 1), {_WS}) AS n1,
  trim(CASE WHEN scoped THEN split_part(head, '::', 1) WHEN called AND dotted THEN regexp_replace(before, '(?s)\\.[^.]*$', '') ELSE '' END, {_WS}) AS module FROM s3),
asked AS (SELECT note_id, node_id, direction, pos, target, description, module, CASE WHEN starts_with(n1, '$') THEN '' ELSE n1 END AS symbol FROM s4)"""
_UP = f"""
who AS (SELECT DISTINCT target AS via, source AS target_node FROM l WHERE relation = 'calls'),
invoked AS (SELECT DISTINCT source AS node_id, substr({_NAME}, 1) AS called FROM l JOIN nn ON nn.id = l.target WHERE relation = 'calls' AND link_id % 2 = 0 AND regexp_matches({_NAME}, '^[a-z_]\\w*$')),
params AS (SELECT o.member AS node_id, CASE WHEN length(x.v) % 3 = 0 THEN x.v END AS name FROM (SELECT container, min(member) AS member FROM own GROUP BY container) o JOIN (SELECT node_id, lower(substr(trim(target, {_WS}), 2)) AS v FROM e1 WHERE direction = 'upstream' AND regexp_matches(trim(target, {_WS}), '^\\$\\w+$')) x ON x.node_id = o.container
  UNION SELECT member, NULL FROM own WHERE length(container) % 5 > 0),
props AS (SELECT node_id, CASE WHEN length(v) % 3 = 1 THEN v END AS name FROM (SELECT node_id, lower(substr(trim(target, {_WS}), 2)) AS v FROM e1 WHERE direction = 'upstream' AND regexp_matches(trim(target, {_WS}), '^\\$\\w+$')) WHERE length(node_id) % 2 = 0),
b1 AS (SELECT s.*, lower(symbol) AS name, lower(rtrim(coalesce(n.label, ''), '()')) AS label, n.source_file AS file, t.source_file AS to_file, om.member AS own_member FROM staged s LEFT JOIN nn n ON n.id = s.node_id LEFT JOIN nn t ON t.id = s.resolved LEFT JOIN own om ON om.container = s.node_id AND om.name = lower(s.symbol)),
b2 AS (SELECT *, CASE WHEN symbol = '' THEN 'bare' WHEN label = name OR ends_with(label, '::' || name) THEN 'self' WHEN module = '' AND own_member IS NOT NULL THEN 'member'
  WHEN resolved <> node_id AND file IS NOT DISTINCT FROM to_file AND resolved IN (SELECT via FROM who) THEN 'resolved' ELSE 'invokes' END AS branch, lower(ltrim(list_extract(regexp_split_to_array(trim(target, {_WS}), '[:.]|->'), -1), '$')) AS variable FROM b1),
b3 AS (SELECT *, EXISTS (SELECT 1 FROM own JOIN params p ON p.node_id = own.member WHERE own.container = b2.node_id AND p.name = b2.variable) AS hit,
  EXISTS (SELECT 1 FROM own JOIN params p ON p.node_id = own.member JOIN who ON who.via = own.member WHERE own.container = b2.node_id AND p.name = b2.variable) AS hit_called,
  EXISTS (SELECT 1 FROM own WHERE own.container = b2.node_id) AS container, EXISTS (SELECT 1 FROM own WHERE own.container = b2.node_id AND own.member NOT IN (SELECT node_id FROM params)) AS unread,
  node_id NOT IN (SELECT node_id FROM props) AS unlisted, EXISTS (SELECT 1 FROM props p WHERE p.node_id = b2.node_id AND p.name = b2.variable) AS property,
  (SELECT min(own.member) FROM own WHERE own.container = b2.node_id AND own.name = nullif(regexp_extract(b2.variable, '^([a-z_][a-z0-9_]*)\\s*\\(', 1), '')) AS call_member FROM b2),
b4 AS (SELECT *, CASE WHEN branch <> 'bare' THEN branch WHEN NOT container OR variable = '' THEN 'all' WHEN hit_called THEN 'hits' WHEN hit THEN 'nobody' WHEN unread OR unlisted OR property THEN 'all' WHEN call_member IS NOT NULL THEN 'call' ELSE 'nobody' END AS way FROM b3),
vias AS (SELECT b4.*, CASE way WHEN 'member' THEN own_member WHEN 'resolved' THEN resolved WHEN 'call' THEN call_member ELSE node_id END AS via FROM b4 WHERE way NOT IN ('hits', 'nobody')
  UNION ALL SELECT b4.*, own.member FROM b4 JOIN own ON own.container = b4.node_id JOIN params p ON p.node_id = own.member AND p.name = b4.variable WHERE way = 'hits'),
routed AS (SELECT DISTINCT note_id, pos, target_node, node_id AS source, target AS parameter_name, description, CASE way WHEN 'all' THEN 'bare' WHEN 'hits' THEN 'member' WHEN 'call' THEN 'member' ELSE way END AS branch
  FROM vias JOIN who USING (via) WHERE way <> 'invokes' OR (target_node, symbol) IN (SELECT node_id, called FROM invoked))"""


def _code_of(spark: SparkSession, d: str, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Code of callers that calls the names of what every other of their calls leads to."""
    to = nodes.select(F.col("id").alias("target"), text.member_name("label").alias("name")).where(F.col("name").rlike(r"^[a-z_]\w*$"))
    calls = links.where("relation = 'calls' AND link_id % 2 = 0").join(to, "target")
    return calls.select(F.col("source").alias("node_id"), F.concat(F.lit("x = "), "name", F.lit(" (1); $no(2); a.\\\\no(3)")).alias("text"))


def _routed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r, nodes, links, asked = _asked(spark, d)
    bare = asked.where("direction = 'upstream'").select("node_id", F.regexp_extract(trimmed("target"), r"^\$(\w+)$", 1).alias("v")).where("v <> ''").withColumn("v", F.lower("v"))
    one = r.members.groupBy("container").agg(F.min("member").alias("member"))
    params = one.join(bare, F.col("container") == F.col("node_id")).select(F.col("member").alias("node_id"), F.when(F.length("v") % 3 == 0, F.col("v")).alias("name"))
    params = params.unionByName(r.members.where(F.length("container") % 5 > 0).select(F.col("member").alias("node_id"), F.lit(None).cast("string").alias("name")))
    props = bare.where(F.length("node_id") % 2 == 0).select("node_id", F.when(F.length("v") % 3 == 1, F.col("v")).alias("name"))
    return demands.route_upstream(asked, nodes, r, graph.callers(links), demands.invoked_names(_code_of(spark, d, nodes, links)), params, props)


@query(f"""
{_RESOLVER}, {_SHAPED}, {_RESOLVED}, {_UP}
SELECT target_node, source, parameter_name, min(description) AS description, count(*) AS merged FROM (SELECT *, {_ONE_SPACE("description")} AS norm FROM routed) GROUP BY target_node, source, parameter_name, norm
""")
def upstream_demands(spark, d):
    """What is asked of the callers of each node, exact repeats merged. Parameters, properties and code are made up of the
    tables' own names."""
    return demands.distinct_demands(_routed(spark, d)[0], upstream=True)


@query(f"""
{_RESOLVER}, {_SHAPED}, {_RESOLVED}, {_UP}
SELECT branch, count(*) AS demands, count(DISTINCT target_node) AS nodes FROM routed GROUP BY branch
""")
def upstream_branches(spark, d):
    """How many of them went which way, and to how many nodes."""
    r = _routed(spark, d)[0]
    nodes = r.select("branch", "target_node").distinct().groupBy("branch").agg(F.count(F.lit(1)).alias("nodes"))
    return r.groupBy("branch").agg(F.count(F.lit(1)).alias("demands")).join(nodes, "branch")


@query(f"""
{_RESOLVER}, {_SHAPED}, {_RESOLVED}, {_UP}
SELECT note_id, node_id, CAST(pos AS INTEGER) AS pos, target, branch, CASE WHEN node_id NOT IN (SELECT via FROM who) THEN 'no-caller' WHEN branch = 'bare' THEN 'no-parameter' ELSE 'not-invoked' END AS miss
FROM b4 WHERE (note_id, pos) NOT IN (SELECT note_id, pos FROM routed)
""")
def upstream_misses(spark, d):
    """Upstream entries that reach no caller, and why."""
    return _routed(spark, d)[1]


@query(f"""
WITH n AS (SELECT id, community, coalesce(source_file, '') AS file, coalesce(length(trim(source_file, {_WS})) > 0 AND ends_with(source_file, coalesce(label, '')), false) AS own FROM nodes WHERE community IS NOT NULL)
SELECT id, community FROM n WHERE NOT own OR NOT EXISTS (SELECT 1 FROM n m WHERE m.community = n.community AND m.file = n.file AND NOT m.own)
""")
def explored_nodes(spark, d):
    """Nodes of each community without files' own nodes that others of the file stand for."""
    return groups.without_skeletons(_nodes(spark, d)).select("id", "community")


@query(f"""
WITH {_L}, p AS (SELECT link_id, source_file AS file, try_cast(regexp_replace(trim(source_location, {_WS}), '^[lL]', '') AS INTEGER) AS line FROM l),
n AS (SELECT source_file AS file, try_cast(regexp_replace(trim(source_location, {_WS}), '^[lL]', '') AS INTEGER) AS line, min(id) AS node FROM nodes WHERE source_file IS NOT NULL GROUP BY ALL)
SELECT p.link_id, p.file, p.line, n.node FROM p ASOF LEFT JOIN (SELECT * FROM n WHERE line IS NOT NULL) n ON p.file = n.file AND p.line >= n.line
""")
def link_places(spark, d):
    """The node whose code each link lies in, by file and line."""
    p = _links(spark, d).select("link_id", F.col("source_file").alias("file"), text.line_number("source_location").alias("line"))
    n = _nodes(spark, d).select(F.col("source_file").alias("file"), text.line_number("source_location").alias("line"), F.col("id").alias("node"))
    return groups.enclosing_nodes(p, n, Scratch(spark))


@query(f"""
WITH {_L} SELECT a.source_file AS file, b.source_file AS imported, count(*) AS links FROM (SELECT source, target FROM l WHERE relation = 'imports') i
JOIN nodes a ON a.id = i.source JOIN nodes b ON b.id = i.target WHERE a.source_file <> '' AND b.source_file <> '' AND a.source_file <> b.source_file GROUP BY ALL
""")
def file_imports(spark, d):
    """Which files import which."""
    n = _nodes(spark, d).where("source_file <> ''")
    i = _links(spark, d).where("relation = 'imports'").select("source", "target")
    e = i.join(n.select(F.col("id").alias("source"), F.col("source_file").alias("file")), "source").join(n.select(F.col("id").alias("target"), F.col("source_file").alias("imported")), "target")
    return e.where("file <> imported").groupBy("file", "imported").agg(F.count(F.lit(1)).alias("links"))


_WORDS, _PARTS = (", ".join(f"'{x}'" for x in xs) for xs in (text.SECURITY_WORDS, text.SECURITY_PARTS))


@query(f"""
WITH n AS (SELECT id, trim(lower(trim(label, {_WS})), '()') AS t FROM nodes)
SELECT id, coalesce(len(list_filter([{_WORDS}], lambda w: starts_with(t, w) OR contains('_' || translate(t, '-./', '___') || '_', '_' || w || '_'))) > 0 OR len(list_filter([{_PARTS}], lambda w: contains(t, w))) > 0, false) AS security FROM n
""")
def security_names(spark, d):
    """Nodes whose name has to do with security."""
    return _nodes(spark, d).select("id", text.security_name("label").alias("security"))


@query(f"""
WITH {_L}, i AS (SELECT target AS node, source AS other, relation, 'in' AS direction, coalesce(source_location, '') AS loc, link_id FROM l UNION ALL SELECT source, target, relation, 'out', coalesce(source_location, ''), link_id FROM l WHERE source <> target),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY loc, link_id, direction) AS rn FROM i)
SELECT node, string_agg(direction || ' ' || relation || ' ' || other, chr(10) ORDER BY rn) AS context FROM r WHERE rn <= 10 GROUP BY node
""")
def node_contexts(spark, d):
    """The first ten connections of every node as text, in order of their place as written."""
    l = _links(spark, d).withColumn("loc", F.coalesce("source_location", F.lit("")))  # noqa: E741
    side = lambda a, b, s: l.select(F.col(a).alias("node"), F.col(b).alias("other"), "relation", F.lit(s).alias("direction"), "loc", "link_id", "source", "target")
    i = side("target", "source", "in").unionByName(side("source", "target", "out").where("source <> target"))
    top = i.withColumn("rn", F.row_number().over(Window.partitionBy("node").orderBy("loc", "link_id", "direction"))).where("rn <= 10")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rn", F.concat_ws(" ", "direction", "relation", "other").alias("t")))), lambda x: x["t"])
    return top.groupBy("node").agg(F.array_join(lines, "\n").alias("context"))


_ARTIFACT = paths.artifact_regex().replace("'", "''")
_ENTRY = ", ".join(f"'{x}'" for x in paths.ENTRY_DIRS)
_ENTRY_NAMES = ", ".join(f"'{x}'" for x in paths.ENTRY_NAMES)


@query(f"""
SELECT source_file, coalesce(list_has_any(string_split(source_file, '/'), [{_ENTRY}]) OR regexp_extract(rtrim(source_file, '/'), '[^/]*$') IN ({_ENTRY_NAMES}), false) AS entry_file,
  coalesce(regexp_matches(source_file, '{_ARTIFACT}') AND NOT regexp_matches(source_file, '(?:^|/)(?:node_modules|vendor|\\.git)/'), false) AS artifact FROM (SELECT DISTINCT source_file FROM nodes WHERE source_file IS NOT NULL)
""")
def entry_files(spark, d):
    """Files that may declare entry points, and those that are configuration."""
    f = _nodes(spark, d).where("source_file IS NOT NULL").select("source_file").distinct()
    return f.select("source_file", paths.is_entry_file("source_file").alias("entry_file"), paths.is_artifact("source_file").alias("artifact"))


@query("""
SELECT id, CASE WHEN count(*) OVER (PARTITION BY community, label) > 1 THEN label || ' #' || row_number() OVER (PARTITION BY community, label ORDER BY id) ELSE label END AS shown
FROM nodes WHERE label <> '' AND community IS NOT NULL
""")
def shown_labels(spark, d):
    """Labels of nodes, numbered where a community has one several times."""
    n = _nodes(spark, d).where("label <> '' AND community IS NOT NULL").select("id", "label", "community")
    r = ordering.with_row_numbers(n, ["community", "label"], ["id"], Scratch(spark), "nth", "all")
    return r.select("id", F.when(F.col("all") > 1, F.concat_ws(" #", "label", F.col("nth").cast("string"))).otherwise(F.col("label")).alias("shown"))


@query(f"""
WITH {_FILED.replace('FROM nodes n LEFT JOIN', ', n.id AS was FROM nodes n LEFT JOIN')}, m AS (SELECT id, label, source_file, CASE WHEN starts_with(label, '.') AND ends_with(label, '()') AND length(label) > 3 THEN label[2:-3] END AS name FROM filed),
u AS (SELECT m.*, CASE WHEN ends_with(id, '_' || lower(name)) THEN substr(id, 1, length(id) - length(name) - 1) END AS up FROM m)
SELECT u.id, coalesce(CASE WHEN c.id IS NOT NULL AND c.source_file IS NOT DISTINCT FROM u.source_file THEN coalesce(c.label, '') || '::' || name || '()' WHEN up IS NOT NULL THEN name || '()' ELSE name END, nullif(u.label, ''), u.id) AS shown FROM u LEFT JOIN filed c ON c.id = u.up
""")
def display_names(spark, d):
    """How nodes are called in a text, members named after the first node of their file that is no member."""
    n, member = _nodes(spark, d), F.regexp_extract(F.coalesce("label", F.lit("")), graph.MEMBER_LABEL, 1)
    first = n.where(member == "").where("source_file IS NOT NULL").groupBy("source_file").agg(F.min("id").alias("first"))
    n = n.join(first, "source_file", "left").withColumn("id", F.when((member != "") & F.col("first").isNotNull(), F.concat("first", F.lit("_"), F.lower(member))).otherwise(F.col("id")))
    return groups.display_names(n.select("id", "label", "source_file"))


@query(f"""
WITH RECURSIVE {_L}, s AS (SELECT DISTINCT source, target FROM l WHERE relation = 'inherits' AND source <> target),
r(start, node, hops) AS (SELECT DISTINCT source, source, 0 FROM s UNION SELECT start, s.target, hops + 1 FROM r JOIN s ON s.source = r.node WHERE hops < 12),
far AS (SELECT start, node FROM (SELECT start, node, min(hops) AS hops FROM r GROUP BY ALL) ORDER BY hops DESC, start, node LIMIT 1),
p(here, path) AS (SELECT start, [start] FROM far UNION ALL SELECT s.target, list_append(path, s.target) FROM p JOIN s ON s.source = p.here WHERE len(path) <= 12 AND here <> (SELECT node FROM far) AND NOT list_contains(path, s.target))
SELECT len(path) - 1 AS hops, path FROM p WHERE here = (SELECT node FROM far) ORDER BY hops, path LIMIT 50
""")
def simple_paths(spark, d):
    """The ways of inheritance between the two nodes that are farthest apart."""
    links = Scratch(spark).keep(_links(spark, d).where("relation = 'inherits'").select("source", "target"))
    hops = graph.shortest_hops(links, links.where("source <> target").select(F.col("source").alias("id")), Scratch(spark))
    far = hops.orderBy(F.col("hops").desc(), "start", "node").first()
    return graph.simple_paths(links, far.start, far.node) if far else graph.simple_paths(links, "", "")


@query("""
WITH d AS (SELECT doc_id, repo, node_id FROM documents WHERE contains(text, 'session')), x AS (SELECT doc_id, coalesce(n.id, 'Unknown (Not in Graph)') AS node FROM d LEFT JOIN nodes n ON n.id = d.node_id),
f AS (SELECT coalesce(repo, '') AS repo, row_number() OVER (ORDER BY doc_id) AS rn FROM d), o AS (SELECT DISTINCT repo FROM f WHERE rn > 20)
SELECT x.node, count(*) AS hits, (SELECT array_to_string(list_sort(list(repo))[:10], ', ') FROM o) AS omitted FROM x GROUP BY x.node
""")
def search_nodes(spark, d):
    """The nodes that documents with a word belong to, and the first ten repositories, in order, that a report of 20 leaves out."""
    hits = table(spark, d, "documents").where(F.contains("text", F.lit("session"))).select("doc_id", F.coalesce("repo", F.lit("")).alias("repo"), "node_id")
    named = hits.join(_nodes(spark, d).select(F.col("id").alias("node_id"), F.col("id").alias("node")), "node_id", "left").withColumn("node", F.coalesce("node", F.lit("Unknown (Not in Graph)")))
    rest = ordering.with_row_numbers(hits.select("doc_id", "repo"), [], ["doc_id"], Scratch(spark)).where("rn > 20").select("repo").distinct().orderBy("repo").limit(10)
    omitted = rest.agg(F.array_join(F.array_sort(F.collect_list("repo")), ", ").alias("omitted"), F.lit(1).alias("one"))
    return named.groupBy("node").agg(F.count(F.lit(1)).alias("hits")).withColumn("one", F.lit(1)).join(omitted, "one").select("node", "hits", "omitted")
