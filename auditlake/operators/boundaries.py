"""Edges that no link shows: over queues, over requests, and through proxies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.paths import base_name, glob_regex
from auditlake.operators.search import match_requests

# How proxies name a place and where it leads, which files are theirs and builds', and names of kinds of edges.
LOCATION = r"(?s)location\s+([^\s{]+)\s*\{(.*?)\}"
SECTION = r"(?s)<Location\s*\"?([^\">]+)\"?>(.*?)</Location>"
PASS = r"proxy_pass\s+https?://[^/]+([^;\s]*);"
APACHE_PASS = r"ProxyPass\s+([^\s]+)\s+([^\s]+)"
PROXY_FILES = ["nginx.conf", "nginx*.conf", "*.vhost", "httpd.conf", "apache2.conf", ".htaccess", "Caddyfile", "traefik.yml", "traefik.yaml", "traefik.toml", "haproxy.cfg", "site.conf"]
PROXY_CHARACTERS = 200_000
COMPOSE_FILES = ["compose.yaml", "compose.yml", "docker-compose.yaml", "docker-compose.yml"]
BUILD_FILES = ["Dockerfile", "Dockerfile.*", "*.dockerfile"]
BUILD_IGNORED = [".git", "node_modules", "vendor", ".cache", ".next", "graphify-out"]
ASYNC, NETWORK, INFRA = "async_messaging", "network_ipc", "infra"
# End of the fixed values.


def proxy_files(files: DataFrame) -> DataFrame:
    """(name, text) of those files (path, text) whose name is a proxy's configuration, with as much of the text as is read."""
    named = base_name("path").rlike("^(?:" + "|".join(map(glob_regex, PROXY_FILES)) + ")$")
    return files.where(named & (F.col("text") != "")).select(F.col("path").alias("name"), F.substring("text", 1, PROXY_CHARACTERS).alias("text"))


def build_files(files: DataFrame, root: str) -> DataFrame:
    """(root, kind, path): what the containers of each root are built from: its first compose file in order of paths, else all
    its single definitions. Files below dependency and cache folders are none."""
    c = files.where("path IS NOT NULL").select(F.col(root).alias("root"), "path").distinct()
    c = c.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, BUILD_IGNORED))))
    single = base_name("path").rlike("^(?:" + "|".join(map(glob_regex, BUILD_FILES)) + ")$")
    c = c.withColumn("kind", F.when(base_name("path").isin(COMPOSE_FILES), "compose").when(single, "dockerfile")).where("kind IS NOT NULL")
    compose = c.where("kind = 'compose'").groupBy("root").agg(F.min("path").alias("path")).select("root", F.lit("compose").alias("kind"), "path")
    rest = c.where("kind = 'dockerfile'").alias("a").join(compose.alias("b"), F.col("a.root").eqNullSafe(F.col("b.root")), "left_anti")
    return compose.unionByName(rest.select("root", "kind", "path"))


def anchored(declared: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds `node` to declarations (file, function): the file's node of that name, or whose label ends in it; else the one
    named after the file; else the file's first; null where the file has no node. Of several the smallest id counts."""
    n = nodes.where("source_file <> ''").select(F.col("id"), F.col("source_file").alias("file"), F.lower(F.coalesce("label", F.lit(""))).alias("low"), F.coalesce("label", F.lit("")).alias("label"))
    by_name = n.groupBy("file", F.regexp_replace("low", r"(?s)^.*(?:::|->|\.)", "").alias("__f")).agg(F.min("id").alias("__by_name"))
    by_file = n.groupBy("file").agg(F.min(F.when(F.col("label") == base_name("file"), F.col("id"))).alias("__own"), F.min("id").alias("__first"))
    d = declared.withColumn("__f", F.lower("function")).join(by_name, ["file", "__f"], "left").join(by_file, "file", "left")
    return d.select(*declared.columns, F.coalesce(F.when(F.col("__f") != "", F.col("__by_name")), "__own", "__first").alias("node"))


def boundary_edges(families: dict[str, DataFrame], nodes: DataFrame) -> DataFrame:
    """(boundary_type, source, target, match_key, and label and file of both ends) of all families of edges, each once. Ends
    that are no nodes, such as proxies, have null labels and files."""
    out = None
    for kind, e in families.items():
        part = e.select(F.lit(kind).alias("boundary_type"), "source", "target", "match_key")
        out = part if out is None else out.unionByName(part)
    end = lambda side: nodes.select(F.col("id").alias(side), F.coalesce("label", F.lit("")).alias(f"{side}_label"), F.coalesce("source_file", F.lit("")).alias(f"{side}_file"))
    return out.distinct().join(end("source"), "source", "left").join(end("target"), "target", "left")


def queue_edges(sent: DataFrame, handled: DataFrame) -> DataFrame:
    """(source, target, match_key) of nodes that send to a name and those that handle it: (node, name) on both sides. A
    node is not joined to itself; repeated names count once."""
    s = sent.select(F.col("node").alias("source"), "name").where("name <> ''").distinct()
    h = handled.select(F.col("node").alias("target"), "name").distinct()
    return s.join(h, "name").where("source <> target").select("source", "target", F.concat(F.lit("event/task '"), F.col("name"), F.lit("'")).alias("match_key"))


def request_edges(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """(source, target, match_key) of nodes that request a path (node, path) and those whose route serves it (node, route)."""
    return _served(requests.select("node", "path", F.concat(F.lit("HTTP "), "path").alias("shown")), routes)


def _served(requests: DataFrame, routes: DataFrame) -> DataFrame:
    served = match_requests(requests, routes)
    bare = F.rtrim("route", F.lit("/"))
    r = routes.select(F.col("node").alias("target"), F.when(bare == "", F.lit("/")).otherwise(bare).alias("route")).distinct()
    q = requests.select(F.col("node").alias("source"), "path", "shown").distinct()
    return q.join(served, "path").join(r, "route").where("source <> target").select("source", "target", F.concat("shown", F.lit(" -> route "), F.col("route")).alias("match_key")).distinct()


def proxy_directives(configs: DataFrame) -> DataFrame:
    """(name, prefix, body, upstream) of each place that a proxy's configuration (name, text) names; upstream is the
    path it leads to, null where that is none."""
    found = None
    for rx in (LOCATION, SECTION):
        pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(rx), 1).alias("p"), F.regexp_extract_all("text", F.lit(rx), 2).alias("b"))
        part = configs.where(F.col("text").rlike(rx)).select("name", F.explode(pairs).alias("x")).select("name", F.trim("x.p").alias("prefix"), F.trim(F.regexp_replace("x.b", r"\s+", " ")).alias("body"))
        found = part if found is None else found.unionByName(part)
    return found.where("prefix <> '' AND body <> ''").withColumn("upstream", upstream_path(F.col("prefix"), F.col("body")))


def upstream_path(prefix: Column, body: Column) -> Column:
    nginx = F.regexp_extract(body, PASS, 1)
    return (
        F.when(body.rlike(PASS), F.when(nginx.startswith("/"), nginx).otherwise("/"))
        .when(body.rlike(APACHE_PASS), F.regexp_extract(body, APACHE_PASS, 1))
        .when(prefix.startswith("/"), prefix)
    )


def proxy_edges(directives: DataFrame, routes: DataFrame) -> DataFrame:
    """(source, target, match_key) of proxies and the nodes whose route serves a directive's prefix or upstream."""
    both = directives.select("name", "prefix", F.explode(F.array_distinct(F.array_compact(F.array("prefix", "upstream")))).alias("path"))
    q = both.select(F.concat(F.lit("infra:"), F.regexp_replace("name", "[^A-Za-z0-9_.-]+", "_"), F.lit("#"), F.col("prefix")).alias("node"), "path", F.concat(F.lit("proxy "), "prefix").alias("shown"))
    return _served(q, routes)


# Fixed value: a call on one line: what it is called on, how, and what is called.
CALL = r"(\$?[A-Za-z_]\w*)\s*(::|->|\.)\s*([A-Za-z_]\w*)\s*\("
# End of the fixed value.


def repair_calls(calls: DataFrame, members: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Calls bound to a container, bound to the member that their line calls: calls are (link_id, source, container,
    label, line), members (container, name, member). Several members called on the line fan out; pairs that
    another call already has stay with the first link, those of `known` (source, target) are left out; calls that
    name no member are not in the result."""
    rx = F.lit(CALL)
    sites = F.arrays_zip(*[F.regexp_extract_all("line", rx, i).alias(n) for i, n in ((1, "recv"), (2, "op"), (3, "meth"))])
    c = calls.select("link_id", "source", "container", F.lower("label").alias("label"), F.explode(sites).alias("s"))
    recv, op = F.lower(F.ltrim(F.col("s.recv"), F.lit("$"))), F.col("s.op")
    own = (recv == F.col("label")) | ((op == "::") & recv.isin("self", "static", "parent")) | ((op == "->") & recv.isin("this", "self"))
    hit = c.where(own).withColumn("name", F.lower("s.meth")).join(members, ["container", "name"]).withColumnRenamed("member", "target")
    if known is not None:
        hit = hit.join(known.select("source", "target").distinct(), ["source", "target"], "left_anti")
    return hit.groupBy("source", "target").agg(F.min_by("container", "link_id").alias("repaired_from"), F.min("link_id").alias("link_id"))


def own_lines(spans: DataFrame) -> DataFrame:
    """(file, node, own): the lines of each span (file, node, first, last) that no span within it covers. Spans of a file
    are one stream in order; those that cross another's end are taken as within it up to there."""
    from auditlake.operators.folds import ordered_fold

    def close(stack, before):
        out = []
        while stack and (before is None or stack[-1]["last"] < before):
            s = stack.pop()
            out.append({"file": s["file"], "node": s["node"], "own": s["own"]})
        return out

    def step(stack, row):
        stack = stack or []
        out = close(stack, row["first"])
        last = min(row["last"], stack[-1]["last"]) if stack else row["last"]
        if stack:
            stack[-1]["own"] -= last - row["first"] + 1
        stack.append({"file": row["file"], "node": row["node"], "last": last, "own": last - row["first"] + 1})
        return stack, out

    ok = spans.where("first <= last").select("file", "node", "first", "last")
    return ordered_fold(ok, ["file"], ["first", F.col("last").desc(), "node"], step, lambda stack: close(stack, None), "file string, node string, own int")
