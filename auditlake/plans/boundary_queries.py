"""Queries over the edges that no link shows, over calls bound anew, CVE demands and failed demands.

The test tables hold no code; so texts that declare and call are made up of the names of nodes and their links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import text
from auditlake.operators import boundaries, code, demands, graph, search
from auditlake.plans import graph_queries as g
from auditlake.plans.graph_queries import _L, _NAME, _links, _members_sql, _nodes
from auditlake.session import Scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STEM = r"([^/]+?)(?:\.[^./]*)?/*$"


def _functions(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that are called by a plain name, labelled with it."""
    n = _nodes(spark, d).where("source_file <> ''").select("id", text.member_name("label").alias("label"), "source_file", F.regexp_extract("source_file", _STEM, 1).alias("stem"))
    return n.where(F.col("label").rlike(r"^[a-z_]\w*$"))


def _declared(spark: SparkSession, d: str, kinds: list[str]) -> DataFrame:
    n = _functions(spark, d)
    declared = F.concat(F.lit("@app.task(name='"), "label", F.lit("')\n@app.get('/"), "stem", F.lit("/{id}/"), "label", F.lit("')\n@app.get('/')\ndef "), "label", F.lit("(x):\n    pass\n"))
    found = search.declared_functions(n.select(F.col("source_file").alias("file"), declared.alias("body")), ["file"], "body", kinds)
    return boundaries.anchored(found, n)


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """What every calling node's code sends and requests, by one call."""
    to = _functions(spark, d).withColumnRenamed("id", "target")
    c = _links(spark, d).where("relation = 'calls'").join(to.select("target", "label", "stem"), "target")
    body = F.when(F.col("link_id") % 4 == 1, F.concat(F.lit("requests.get('http://svc/"), "stem", F.lit("/7/"), "label", F.lit("?q=1')"))).when(F.col("link_id") % 4 == 2, F.concat(F.lit("queue.enqueue('"), "label", F.lit("')"))).when(F.col("link_id") % 4 == 3, F.concat(F.col("label"), F.lit(".delay(1)")))
    return search.declarations(c.select(F.col("source").alias("node"), body.alias("body")), ["node"], "body", search.SENT + search.REQUESTS)


def _configs(spark: SparkSession, d: str) -> DataFrame:
    n = _functions(spark, d).groupBy("stem").agg(F.min("label").alias("label"))
    body = F.concat(F.lit("server { location /"), "stem", F.lit("/9 {\n  proxy_pass http://app:80/"), "stem", F.lit("/7/"), "label", F.lit(";\n} }"))
    files = n.select(F.concat(F.lit("etc/nginx-"), "stem", F.lit(".conf")).alias("path"), body.alias("text")).unionByName(n.select(F.concat(F.lit("etc/"), "stem", F.lit(".cfg")).alias("path"), body.alias("text")))
    return boundaries.proxy_directives(boundaries.proxy_files(files))


def _families(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    scratch = Scratch(spark)
    entries = scratch.keep(_declared(spark, d, search.ROUTES + search.WORKERS))
    calls = scratch.keep(_calls(spark, d))
    routes = entries.where(F.col("kind").isin(search.ROUTES)).select("node", F.col("name").alias("route"))
    return {
        boundaries.ASYNC: boundaries.queue_edges(calls.where(F.col("kind").isin(search.SENT)), entries.where(F.col("kind").isin(search.WORKERS))),
        boundaries.NETWORK: boundaries.request_edges(calls.where(F.col("kind").isin(search.REQUESTS)).select("node", F.col("name").alias("path")), routes),
        boundaries.INFRA: boundaries.proxy_edges(_configs(spark, d), routes),
    }


_FAMILIES = f"""fn AS (SELECT id, {_NAME} AS name, source_file AS file, regexp_extract(source_file, '([^/]+?)(?:\\.[^./]*)?/*$', 1) AS stem FROM nodes WHERE source_file <> '' AND regexp_matches({_NAME}, '^[a-z_]\\w*$')),
anchor AS (SELECT file, stem, name, min(id) AS node FROM fn GROUP BY ALL),
calls AS (SELECT link_id % 4 AS kind, l.source, fn.stem, fn.name FROM l JOIN fn ON fn.id = l.target WHERE relation = 'calls'),
families AS (
  SELECT DISTINCT 'async_messaging' AS boundary_type, source, node AS target, 'event/task ''' || c.name || '''' AS match_key FROM calls c JOIN anchor a ON a.name = c.name WHERE kind IN (2, 3) AND source <> node
  UNION ALL SELECT DISTINCT 'network_ipc', source, node, 'HTTP http://svc/' || c.stem || '/7/' || c.name || '?q=1 -> route /' || c.stem || '/{{id}}/' || c.name FROM calls c JOIN anchor a ON a.name = c.name AND a.stem = c.stem WHERE kind = 1 AND source <> node
  UNION ALL SELECT DISTINCT 'infra', 'infra:etc_nginx-' || p.stem || '.conf#/' || p.stem || '/9', node, 'proxy /' || p.stem || '/9 -> route /' || p.stem || '/{{id}}/' || p.name FROM (SELECT stem, min(name) AS name FROM fn GROUP BY stem) p JOIN anchor a ON a.name = p.name AND a.stem = p.stem)"""


@query(f"""
WITH {_L}, {_FAMILIES} SELECT f.*, CASE WHEN a.id IS NOT NULL THEN coalesce(a.label, '') END AS source_label, CASE WHEN a.id IS NOT NULL THEN coalesce(a.source_file, '') END AS source_file, coalesce(b.label, '') AS target_label, coalesce(b.source_file, '') AS target_file
FROM families f LEFT JOIN nodes a ON a.id = f.source JOIN nodes b ON b.id = f.target
""")
def boundary_edges(spark, d):
    """Edges over queues, requests and proxies, with what is known of both ends."""
    return boundaries.boundary_edges(_families(spark, d), _nodes(spark, d))


@query(f"WITH {_L}, {_FAMILIES} SELECT boundary_type, count(*) AS edges, count(DISTINCT source) AS sources FROM families GROUP BY boundary_type")
def boundary_summary(spark, d):
    """Such edges by kind."""
    e = boundaries.boundary_edges(_families(spark, d), _nodes(spark, d))
    sources = e.select("boundary_type", "source").distinct().groupBy("boundary_type").agg(F.count(F.lit(1)).alias("sources"))
    return e.groupBy("boundary_type").agg(F.count(F.lit(1)).alias("edges")).join(sources, "boundary_type")


@query(r"""
WITH p AS (SELECT DISTINCT split_part(source_file, '/', 1) AS root, string_split(source_file, '/') AS parts, source_file AS path FROM nodes WHERE source_file <> ''),
q AS (SELECT root, array_to_string(parts[:-2], '/') || CASE length(path) % 5 WHEN 0 THEN '/Dockerfile' WHEN 1 THEN '/Dockerfile.dev' WHEN 2 THEN '/vendor/Dockerfile' WHEN 3 THEN '/x.dockerfile' ELSE '/compose.yml' END AS path FROM p),
k AS (SELECT DISTINCT root, path, path LIKE '%/compose.yml' AS compose FROM q WHERE path NOT LIKE '%/vendor/%' AND (root <> 'src' OR path NOT LIKE '%/compose.yml'))
SELECT root, 'compose' AS kind, min(path) AS path FROM k WHERE compose GROUP BY root UNION ALL SELECT root, 'dockerfile', path FROM k WHERE root NOT IN (SELECT root FROM k WHERE compose)
""")
def build_definitions(spark, d):
    """What the containers of each top folder are built from, by definitions made up beside its files."""
    p = _nodes(spark, d).where("source_file <> ''").select("source_file", F.substring_index("source_file", "/", 1).alias("top")).distinct()
    name = F.element_at(F.array(*map(F.lit, ("/Dockerfile", "/Dockerfile.dev", "/vendor/Dockerfile", "/x.dockerfile", "/compose.yml"))), F.length("source_file") % 5 + 1)
    parts = F.split("source_file", "/")
    files = p.select("top", F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/"), name).alias("path"))
    return boundaries.build_files(files.where("top <> 'src' OR NOT endswith(path, 'compose.yml')"), "top")


@query(f"""
WITH {_L}, {_members_sql('nodes')}, c AS (SELECT link_id, l.source AS container, l.target AS source, coalesce(n.label, '') AS label, name FROM l JOIN labelled a ON a.id = l.target JOIN nodes n ON n.id = l.source WHERE relation = 'method' AND name <> ''),
f AS (SELECT container, min(name) AS name FROM own GROUP BY container),
hit AS (SELECT link_id, source, container, name FROM c WHERE regexp_matches(label, '^[A-Za-z_]\\w*$') UNION SELECT link_id, source, c.container, f.name FROM c JOIN f ON f.container = c.container)
SELECT source, member AS target, min(link_id) AS link_id, arg_min(container, link_id) AS repaired_from FROM hit JOIN own USING (container, name)
WHERE (source, member) NOT IN (SELECT source, target FROM l WHERE relation = 'calls') GROUP BY source, member
""")
def repaired_calls(spark, d):
    """Calls of containers, bound to the members that their line calls; lines are made up of the containers' and members' names."""
    links, nodes = _links(spark, d), _nodes(spark, d)
    own = graph.members(nodes, links)
    to = nodes.select(F.col("id").alias("target"), F.lower(F.regexp_extract(F.coalesce("label", F.lit("")), graph.MEMBER_LABEL, 1)).alias("called")).where("called <> ''")
    c = links.where("relation = 'method'").select("link_id", F.col("source").alias("container"), "target").join(to, "target").join(nodes.select(F.col("id").alias("container"), F.coalesce("label", F.lit("")).alias("label")), "container")
    c = c.join(own.groupBy("container").agg(F.min("name").alias("first")), "container", "left")
    line = F.concat(F.col("label"), F.lit("::"), F.col("called"), F.lit("(a) + self::"), F.coalesce("first", F.lit("none")), F.lit("() + $this->nope()"))
    return boundaries.repair_calls(c.select("link_id", F.col("target").alias("source"), "container", "label", line.alias("line")), own, links.where("relation = 'calls'"))


_USES = f"""fs AS (SELECT id, regexp_extract(source_file, '([^/]+?)(?:\\.[^./]*)?/*$', 1) AS namespace FROM nodes WHERE source_file <> ''),
imp AS (SELECT DISTINCT l.source AS node_id, namespace FROM l JOIN fs ON fs.id = l.target WHERE relation = 'imports'), used AS (SELECT DISTINCT l.source AS node_id, namespace FROM l JOIN fs ON fs.id = l.target WHERE relation IN ('calls', 'uses')),
f AS (SELECT DISTINCT ON (finding_id) * EXCLUDE (arrived_at) FROM findings), rec AS (SELECT source_cve, min(namespace) AS namespace, min(description) AS description FROM f JOIN fs ON fs.id = affected_nodes[1] WHERE source_cve <> '' GROUP BY source_cve
  UNION ALL SELECT 'all of ' || namespace, namespace, 'd' FROM imp GROUP BY namespace),
matched AS (SELECT node_id, namespace FROM imp JOIN used USING (node_id, namespace))"""


def _cve_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from auditlake.plans.record_queries import _findings

    stems = _nodes(spark, d).where("source_file <> ''").select("id", F.regexp_extract("source_file", _STEM, 1).alias("namespace"))
    links = _links(spark, d)
    by = lambda *kinds: links.where(F.col("relation").isin(*kinds)).join(stems.withColumnRenamed("id", "target"), "target").select(F.col("source").alias("node_id"), "namespace")
    imports, uses = by("imports"), by("calls", "uses")
    f = _findings(spark, d).where("source_cve <> ''").select("source_cve", "description", F.get("affected_nodes", F.lit(0)).alias("id")).join(stems, "id")
    records = f.groupBy("source_cve").agg(F.min("namespace").alias("namespace"), F.min("description").alias("description"))
    records = records.unionByName(imports.groupBy("namespace").agg(F.lit("d").alias("description")).withColumn("source_cve", F.concat(F.lit("all of "), "namespace")))
    return records, imports, uses


@query(f"WITH {_L}, {_USES} SELECT node_id AS target_node, source_cve AS source, description FROM rec JOIN matched USING (namespace)")
def cve_demands(spark, d):
    """What CVEs ask of the nodes that import and use what they affect; for every namespace imported one record is added."""
    return demands.cve_demands(*_cve_tables(spark, d))


@query(f"""
WITH {_L}, {_USES}, r AS (SELECT namespace, node_id, row_number() OVER (PARTITION BY namespace ORDER BY node_id) AS rn, count(*) OVER (PARTITION BY namespace) AS n FROM matched),
h AS (SELECT namespace, string_agg(node_id, ', ' ORDER BY node_id) || CASE WHEN max(n) > 5 THEN ' (+' || max(n) - 5 || ' more)' ELSE '' END AS hint FROM r WHERE rn <= 5 GROUP BY namespace)
SELECT source_cve, hint FROM rec LEFT JOIN h USING (namespace)
""")
def usage_hints(spark, d):
    """The first five of those nodes for each CVE, and how many more there are."""
    return demands.usage_hints(*_cve_tables(spark, d)).select("source_cve", "hint")


@query(f"""
{g._RESOLVER}, {g._parsed('e1')}, {g._RESOLVED}, {g._DOWN},
ev AS (SELECT target_node, 'D' || rn AS demand_id, 'seen ' || rn AS evidence FROM numbered WHERE rn % 3 = 0 UNION ALL SELECT DISTINCT target_node, 'D9999', NULL FROM numbered),
lb AS (SELECT target_node, 'D' || rn AS demand_id, CASE WHEN count(*) OVER (PARTITION BY target_node, source) > 1 THEN source || '#' || rn ELSE source END AS shown, description FROM numbered)
SELECT target_node, demand_id, coalesce(shown, demand_id) AS label, 'Fails to satisfy demand: ''' || CASE WHEN shown IS NULL THEN 'No description found.' ELSE coalesce(description, 'None') END || '''. Evidence: ' || coalesce(evidence, 'None') AS description FROM ev LEFT JOIN lb USING (target_node, demand_id)
""")
def failed_demands(spark, d):
    """What failed of the downstream demands, were every third one not met and one asked that nobody knows."""
    asked = Scratch(spark).keep(g.downstream_demands(spark, d))
    place = F.substring("demand_id", 2, 20).cast("bigint")
    e = asked.select("target_node", "demand_id", F.when(place % 3 == 0, "FAILED").otherwise("MET").alias("status"), F.concat(F.lit("seen "), place).alias("evidence"))
    e = e.unionByName(asked.select("target_node", F.lit("D9999").alias("demand_id"), F.lit("FAILED").alias("status"), F.lit(None).cast("string").alias("evidence")).distinct())
    return demands.failed_demands(e, asked.withColumn("parameter_name", F.lit(None).cast("string")))


@query(f"""
WITH n AS (SELECT id, {_NAME} AS name, lower(regexp_extract(source_file, '([^/]+?)(?:\\.[^./]*)?/*$', 1)) AS stem, length(id) % 3 AS k FROM nodes WHERE source_file <> '' AND regexp_matches({_NAME}, '^[a-z_]\\w*$'))
SELECT id, CASE WHEN k < 2 THEN list_sort(list_distinct([name, stem])) END AS parameters, CASE WHEN k = 0 THEN list_sort(list_distinct([name, stem, 'third'])) WHEN k = 1 THEN [] END AS properties FROM n
""")
def code_names(spark, d):
    """Parameters and properties that made-up code of every function's name declares; of a third of the nodes there is none."""
    n = _functions(spark, d).withColumn("k", F.length("id") % 3)
    function = F.concat(F.lit("public function f(int $"), "label", F.lit(",\n  $"), F.upper("stem"), F.lit(" = 1,\n  $"), "label", F.lit(") {\n  return $none; }"))
    body = F.concat(F.lit("class K {\n  public static $"), "label", F.lit(" = $x;\n  protected int $"), F.upper("stem"), F.lit(";\n  private $Third; var $"), "label", F.lit(";\n  function f() { private $late; }\n"))
    none = F.lit(None).cast("string")
    n = n.select("id", F.when(F.col("k") < 2, function).otherwise(none).alias("f"), F.when(F.col("k") == 0, body).when(F.col("k") == 1, "class K { function g(public $z) {} }").otherwise(none).alias("c"))
    return n.select("id", F.array_sort(code.signature_names(F.col("f"))).alias("parameters"), F.array_sort(code.property_names(F.col("c"))).alias("properties"))
