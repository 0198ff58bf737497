"""Demands of analysis notes, resolved to the nodes they speak about and routed to those who have to meet them.

Every stage of a resolution is a look-up table of one row per question, made for the questions asked and joined to
them; so no join multiplies demands, and a name that a million demands ask for is looked up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import call_target, member_name, one_space
from auditlake.operators import graph
from auditlake.session import Scratch, filled, trimmed

# Modules that mean the asking class, and those that mean none.
PRONOUNS = ["parent", "static", "self", "this", "$this"]
NO_MODULE = ["global", "none", "null"]
# End of the fixed values.


def note_demands(notes: DataFrame) -> DataFrame:
    """One row per upstream or downstream entry with a target: (note_id, node_id, direction, pos, target, description,
    module, symbol). Notes sent again count once; entries without a target ask nobody."""
    side = lambda c: notes.where("node_id IS NOT NULL").select("note_id", "node_id", F.lit(c).alias("direction"), F.posexplode(c).alias("pos", "e"))
    d = side("upstream").unionByName(side("downstream")).select("note_id", "node_id", "direction", "pos", "e.target", "e.description")
    module, symbol = call_target("target")
    return d.where(filled("target")).dropDuplicates(["note_id", "direction", "pos"]).withColumns({"module": module, "symbol": symbol})


class Resolver:
    """The look-up tables of one graph: members, containers with their ancestors, and the names they go by. Nodes without
    a file are found by nobody. Of several nodes that fit equally the smallest id counts."""

    def __init__(self, nodes: DataFrame, links: DataFrame, scratch: Scratch):
        self.scratch = scratch
        self.members = scratch.keep(graph.members(nodes, links))
        self.homes = self.members.groupBy(F.col("member").alias("node_id")).agg(F.min("container").alias("home"))
        ids = nodes.select("id")
        pairs = links.where(F.col("relation").isin(graph.CLASS_RELATIONS) & (F.col("source") != F.col("target"))).select("source", "target").distinct()
        pairs = pairs.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
        ends = pairs.select(F.explode(F.array("source", "target")).alias("container"))
        self.containers = self.members.select("container").unionByName(ends).distinct()
        self.parents = scratch.keep(pairs.join(self.homes.withColumnRenamed("node_id", "source"), "source", "left_anti"))
        self.closure = scratch.keep(graph.ancestors(self.parents.withColumn("relation", F.lit("up")), "up", scratch))
        named = nodes.join(self.containers.withColumnRenamed("container", "id"), "id", "left_semi")
        stem = F.lower(F.regexp_extract(F.coalesce("source_file", F.lit("")), r"([^/]+?)(?:\.[^./]*)?/*$", 1))
        label = member_name(F.coalesce("label", F.lit("")))
        # a container goes by its label and by its file's name
        keys = named.select(F.col("id").alias("container"), F.explode(F.array(F.struct(label.alias("k"), F.lit(0).alias("by")), F.struct(stem.alias("k"), F.lit(1).alias("by")))).alias("x"))
        self.keys = scratch.keep(keys.where("x.k <> ''").groupBy(F.col("x.k").alias("hint"), "container").agg(F.min("x.by").alias("by")))
        self.labels = scratch.keep(nodes.where("source_file <> ''").select("id", F.lower(F.replace("source_file", F.lit("\\"), F.lit("/"))).alias("file"), F.lower(F.coalesce("label", F.lit(""))).alias("label"), label.alias("name")))

    def in_scope(self, asked: DataFrame, start: str, starts: DataFrame, depth: int) -> DataFrame:
        """(start, name, found): for each pair of a start and a name the member of that name of the nearest of its
        containers or their ancestors, up to `depth` steps away. `starts` are (start, container, by)."""
        near = starts.join(self.closure.withColumnRenamed("node", "container"), "container").where(F.col("depth") <= depth).select(start, F.col("ancestor").alias("container"), "depth", "by")
        scope = starts.select(start, "container", F.lit(0).alias("depth"), "by").unionByName(near)
        hit = asked.join(scope, start).join(self.members, ["container", "name"])
        return hit.groupBy(start, "name").agg(F.min(F.struct("depth", "by", "container", "member")).alias("b")).select(start, "name", F.col("b.member").alias("found"))

    def by_file(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(strict, loose), each (hint, of_file, symbol, found): nodes whose file holds the hint, or whose file or label does
        where the hint is no module's, and whose label is the symbol or ends in it; else whose label holds it.

        Labels are looked up by their last name, and the loose ones by the rarest three characters of the symbol.
        """
        tail = lambda c: F.regexp_replace(F.regexp_replace(c, r"\(\)$", ""), r"(?s)^.*(?:::|->|\.)", "")
        n = self.labels
        fits = F.contains("file", F.col("hint")) | (~F.col("of_file") & F.contains("label", F.col("hint")))
        bare = F.regexp_replace("label", r"\(\)$", "")
        ends = lambda mark: F.endswith(bare, F.concat(F.lit(mark), F.col("symbol")))
        strict_label = (F.col("label") == F.col("symbol")) | (bare == F.col("symbol")) | ends("::") | ends("->") | ends(".")
        keys = ["hint", "of_file", "symbol"]
        first = F.min("id").alias("found")
        strict = self.scratch.keep(asked.withColumn("__t", tail(F.col("symbol"))).join(n.withColumn("__t", tail(F.col("label"))), "__t").where(fits & strict_label).groupBy(*keys).agg(first))
        rest = asked.where("symbol <> ''").join(strict.select(*keys), keys, "left_anti")
        grams = lambda c, sizes: F.array_distinct(F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1))), lambda i: F.substring(c, i, k)))))
        held = n.select("id", "file", "label", F.explode(grams(F.col("label"), F.array(F.lit(1), F.lit(2), F.lit(3)))).alias("__g"))
        often = held.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))
        marks = rest.select(*keys, F.explode(grams(F.col("symbol"), F.array(F.least(F.length("symbol"), F.lit(3))))).alias("__g"))
        marks = marks.join(often, "__g").groupBy(*keys).agg(F.min(F.struct("__n", "__g")).alias("m")).select(*keys, F.col("m.__g").alias("__g"))
        loose = marks.join(held, "__g").where(fits & F.contains("label", F.col("symbol"))).groupBy(*keys).agg(first)
        return strict, loose

    def by_name(self) -> DataFrame:
        """(name, named, only, functions, function): how many nodes have a name, and how many of them as a function."""
        function = F.regexp_replace("label", r"\(\)$", "") == F.col("name")
        return self.labels.where("name <> ''").groupBy("name").agg(
            F.count(F.lit(1)).alias("named"), F.min("id").alias("only"), F.count_if(function).alias("functions"), F.min(F.when(function, F.col("id"))).alias("function")
        )

    def resolve(self, demands: DataFrame) -> DataFrame:
        """Adds `resolved`, the node that a demand's module and symbol name, `stage`, how it was found, and `miss` where it
        wasn't. The stages, in order:

        * `scope`: a pronoun's member, in the asking node's container or its ancestors; for `parent` in the direct parents.
        * `file`, `part`: with a module or class, a label that is the symbol, or holds it, in a file that the hint is part of.
        * `inherited`: a member of that name of the class the hint names, or of its nearest ancestor.
        * `caller`: the same of the asking node's own class, where the hint names an ancestor of it.
        * `name`, `function`: without a hint the only node of that name, or of several the only function.

        A pronoun that leads nowhere is dropped, a variable is no hint. The misses: no-symbol, global-none, global-ambiguous,
        class-absent, method-absent. Null and blank modules are none.
        """
        module = F.lower(trimmed(F.coalesce("module", F.lit(""))))
        module = F.when(module.isin(NO_MODULE), F.lit("")).otherwise(module)
        symbol = trimmed(F.coalesce("symbol", F.lit("")))
        q = demands.select("node_id", "module", "symbol").distinct().select("*", module.alias("m0"), symbol.alias("s0"))
        q = q.join(self.homes, "node_id", "left").join(self.containers.select(F.col("container").alias("node_id"), F.col("container").alias("__self")), "node_id", "left")
        q = q.withColumn("home", F.coalesce("home", "__self")).drop("__self")
        first = trimmed(F.substring_index("s0", "/", 1))
        q = q.withColumn("__b", F.regexp_replace(F.when(F.contains("s0", F.lit("/")), first).otherwise(F.col("s0")), r"\(\)$", ""))
        scoped, dotted = F.contains("__b", F.lit("::")), F.contains("__b", F.lit("."))
        cls = F.when(scoped, F.substring_index("__b", "::", 1)).when(dotted, F.substring_index("__b", ".", 1)).otherwise("")
        rest = F.when(scoped, F.regexp_replace("__b", r"(?s)^.*?::", "")).when(dotted, F.regexp_replace("__b", r"(?s)^.*?\.", "")).otherwise(F.col("__b"))
        pronoun = F.col("m0").isin(PRONOUNS)
        q = q.withColumns({"sym": F.lower(rest), "name": member_name(rest), "__c": F.lower(cls), "own": member_name("s0"), "pronoun": pronoun, "__m": F.when(pronoun | F.col("m0").startswith("$"), F.lit("")).otherwise(F.col("m0"))})
        base = F.substring_index(F.translate("__m", ".\\", "//"), "/", -1)
        q = q.withColumns({"of_file": base != "", "file_hint": F.when(base != "", base).otherwise(F.col("__c")), "hint": F.when(F.col("__c") != "", F.col("__c")).otherwise(base)})
        q = kept = self.scratch.keep(q.drop("__b", "__c", "__m"))

        home = q.where("home IS NOT NULL")
        mine = home.select("home", F.col("home").alias("container"), F.lit(0).alias("by")).distinct()
        pro = home.where("pronoun").select("home", F.col("own").alias("name"), (F.col("m0") == "parent").alias("up")).distinct()
        above = mine.join(self.parents.withColumnsRenamed({"source": "container", "target": "__p"}), "container").select("home", F.col("__p").alias("container"), "by")
        scope = self.in_scope(pro.where("NOT up").drop("up"), "home", mine, 8).withColumn("up", F.lit(False))
        scope = scope.unionByName(self.in_scope(pro.where("up").drop("up"), "home", above, 0).withColumn("up", F.lit(True)))
        q = q.withColumn("up", F.col("m0") == "parent").join(scope.select("home", F.col("name").alias("own"), "up", F.col("found").alias("in_scope")), ["home", "own", "up"], "left")
        hinted = kept.where("s0 <> '' AND file_hint <> ''")
        q = q.withColumn("in_scope", F.when(F.col("pronoun"), F.col("in_scope"))).drop("up")

        strict, loose = self.by_file(hinted.select(F.col("file_hint").alias("hint"), "of_file", F.col("sym").alias("symbol")).distinct())
        named = hinted.select("hint", "name").where("name <> ''").distinct()
        starts = self.keys.join(named.select("hint").distinct(), "hint", "left_semi")
        inherited = self.in_scope(named, "hint", starts, 7)
        # the hint names an ancestor of the asking node's class
        above = hinted.where("home IS NOT NULL").select("home", "hint").distinct().join(self.closure.withColumnsRenamed({"node": "home", "ancestor": "container"}), "home").join(self.keys, ["hint", "container"], "left_semi").select("home", "hint").distinct()
        own = self.in_scope(hinted.where("home IS NOT NULL AND name <> ''").select("home", "name").distinct(), "home", mine, 8).join(above, "home")
        files = lambda d, c: d.select(F.col("hint").alias("file_hint"), "of_file", F.col("symbol").alias("sym"), F.col("found").alias(c))
        q = q.join(files(strict, "in_file"), ["file_hint", "of_file", "sym"], "left").join(files(loose, "in_part"), ["file_hint", "of_file", "sym"], "left")
        q = q.join(inherited.withColumnRenamed("found", "in_class"), ["hint", "name"], "left").join(own.withColumnRenamed("found", "in_own"), ["home", "hint", "name"], "left")
        q = q.join(self.by_name(), "name", "left").join(self.keys.select("hint", F.lit(True).alias("known")).distinct(), "hint", "left")
        hint = F.col("file_hint") != ""
        found = {
            "scope": F.col("in_scope"), "file": F.when(hint, F.col("in_file")), "part": F.when(hint, F.col("in_part")), "inherited": F.when(hint, F.col("in_class")), "caller": F.when(hint, F.col("in_own")),
            "name": F.when(~hint & (F.col("named") == 1), F.col("only")), "function": F.when(~hint & (F.col("functions") == 1), F.col("function")),
        }
        some = F.col("s0") != ""
        stage = F.coalesce(*[F.when(some & c.isNotNull(), F.lit(n)) for n, c in found.items()])
        miss = (
            F.when(~some, "no-symbol").when(~hint & F.col("named").isNotNull(), "global-ambiguous").when(~hint, "global-none").when(F.col("known"), "method-absent").otherwise("class-absent")
        )
        q = q.select("node_id", "module", "symbol", stage.alias("stage"), F.when(some, F.coalesce(*found.values())).alias("resolved"), F.when(stage.isNull(), miss).alias("miss"))
        a, b = demands.alias("a"), self.scratch.keep(q).alias("b")
        on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("node_id", "module", "symbol")]
        return a.join(b, on[0] & on[1] & on[2], "left").select("a.*", "b.stage", "b.resolved", "b.miss")


def route_downstream(resolved: DataFrame) -> DataFrame:
    """Demands on callees: (target_node, source, description); a demand on the asking node itself is dropped."""
    return resolved.where("direction = 'downstream' AND resolved IS NOT NULL AND resolved <> node_id").select(F.col("resolved").alias("target_node"), F.col("node_id").alias("source"), "description")


def call_shape(target: Column | str) -> tuple[Column, Column]:
    """(module, called) of a target as it was written, brackets and all: what is called, and on what. `called` is '' for
    targets that call nothing: bare names and variables."""
    t = F.col(target) if isinstance(target, str) else target
    head = trimmed(F.substring_index(trimmed(F.replace(F.coalesce(t, F.lit("")), F.lit("`"), F.lit(""))), "->", -1))
    before = trimmed(F.substring_index(head, "(", 1))
    scoped, called = F.contains(before, F.lit("::")), F.contains(head, F.lit("("))
    dotted = F.contains(before, F.lit("."))
    name = F.when(scoped, F.regexp_replace(head, r"(?s)^.*?::", "")).when(called & dotted, F.substring_index(before, ".", -1)).when(called, before).otherwise("")
    name = trimmed(F.substring_index(trimmed(name), "(", 1))
    module = F.when(scoped, F.substring_index(head, "::", 1)).when(called & dotted, F.regexp_replace(before, r"(?s)\.[^.]*$", "")).otherwise("")
    return trimmed(module), F.when(name.startswith("$"), F.lit("")).otherwise(name)


#: A plain name that is called, after nothing that would make it part of another.
INVOKED = r"(?<![\w$\\])([A-Za-z_]\w*)\s*\("


def invoked_names(code: DataFrame) -> DataFrame:
    """(node_id, called): the names that the code (node_id, text) of a node calls. A look-up by these says for every caller
    at once what an expression made of each name would say."""
    return code.where(F.col("text").rlike(INVOKED)).select("node_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(INVOKED), 1))).alias("called")).distinct()


def route_upstream(demands: DataFrame, nodes: DataFrame, resolver: Resolver, callers: DataFrame, invoked: DataFrame | None = None, parameters: DataFrame | None = None, properties: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(routed, missed): demands on callers, one row per caller, (note_id, pos, target_node, source, parameter_name,
    description, branch); and the demands that nobody gets, with `miss`. The branches:

    * `bare`: a target that calls nothing goes to all callers of the node. Asked by a container, `member` callers of those
      members that have a parameter of that name, where `parameters` (node_id, name) are known of all its members; all
      callers again if no member has it, but a property (`properties`, node_id, name) does or those are unknown; else nobody.
    * `self`: a target that names the node itself goes to all its callers.
    * `member`: a call without a module that names a member of the asking container goes to that member's callers.
    * `resolved`: one that resolves to another node of the same file goes to that node's callers.
    * `invokes`: else it goes to those callers whose code calls the name (`invoked`, node_id, called).

    A node's parameters or properties are known where it has a row, be it with a null name. As many rows as callers times
    demands, by definition. Repeated rows of the look-up tables change nothing.
    """
    spark = nodes.sparkSession
    scratch = resolver.scratch
    empty = lambda schema: spark.createDataFrame([], schema)
    invoked = empty("node_id string, called string") if invoked is None else invoked.select("node_id", "called").distinct()
    parameters = empty("node_id string, name string") if parameters is None else parameters.select("node_id", F.lower("name").alias("name")).distinct()
    properties = empty("node_id string, name string") if properties is None else properties.select("node_id", F.lower("name").alias("name")).distinct()
    module, called = call_shape("target")
    d = demands.where("direction = 'upstream'").select("note_id", "node_id", "pos", "target", "description").withColumns({"module": module, "symbol": called})
    d = resolver.resolve(d).withColumn("name", F.lower("symbol"))
    about = nodes.select(F.col("id").alias("node_id"), F.lower(F.rtrim(F.coalesce("label", F.lit("")), F.lit("()"))).alias("label"), F.col("source_file").alias("file"))
    d = d.join(about, "node_id", "left").join(nodes.select(F.col("id").alias("resolved"), F.col("source_file").alias("to_file")), "resolved", "left")
    own = resolver.members.select(F.col("container").alias("node_id"), "name", F.col("member").alias("own_member"))
    d = d.join(own, ["node_id", "name"], "left")
    has = callers.select(F.col("callee").alias("resolved"), F.lit(True).alias("is_called")).distinct()
    d = d.join(has, "resolved", "left")
    itself = (F.col("label") == F.col("name")) | F.endswith("label", F.concat(F.lit("::"), F.col("name")))
    near = F.col("resolved").isNotNull() & (F.col("resolved") != F.col("node_id")) & F.col("file").eqNullSafe(F.col("to_file")) & F.col("is_called")
    branch = (
        F.when(F.col("symbol") == "", "bare").when(F.coalesce(itself, F.lit(False)), "self").when((F.col("module") == "") & F.col("own_member").isNotNull(), "member").when(F.coalesce(near, F.lit(False)), "resolved").otherwise("invokes")
    )
    d = scratch.keep(d.withColumns({"branch": branch, "resolved": F.col("resolved")}).select("note_id", "node_id", "pos", "target", "description", "symbol", "branch", "own_member", "resolved"))

    # bare targets of containers: by the parameters of their members
    variable = F.lower(F.ltrim(F.element_at(F.split(trimmed("target"), r"[:.]|->"), -1), F.lit("$")))
    sizes = resolver.members.groupBy(F.col("container").alias("node_id")).agg(F.count(F.lit(1)).alias("members"))
    bare = d.where("branch = 'bare'").withColumn("variable", variable).join(sizes, "node_id", "left")
    whole, asked = bare.where("members IS NULL OR variable = ''"), bare.where("members IS NOT NULL AND variable <> ''")
    known = resolver.members.select(F.col("container").alias("node_id"), F.col("member").alias("__m"))
    read = known.join(parameters.select(F.col("node_id").alias("__m")).distinct(), "__m").groupBy("node_id").agg(F.count_distinct("__m").alias("read"))
    distinct_members = known.groupBy("node_id").agg(F.count_distinct("__m").alias("all_members"))
    with_name = known.join(parameters.where("name IS NOT NULL").withColumnsRenamed({"node_id": "__m", "name": "variable"}), "__m").distinct()
    hits = asked.join(with_name, ["node_id", "variable"]).select("note_id", "pos", "node_id", "__m").distinct()
    called_hits = hits.join(callers.select(F.col("callee").alias("__m")).distinct(), "__m", "left_semi")
    state = lambda x, c: x.select("note_id", "pos", F.lit(True).alias(c)).distinct()
    asked = asked.join(state(hits, "hit"), ["note_id", "pos"], "left").join(state(called_hits, "hit_called"), ["note_id", "pos"], "left")
    asked = asked.join(read, "node_id", "left").join(distinct_members, "node_id", "left")
    asked = asked.join(properties.select("node_id", F.lit(True).alias("listed")).distinct(), "node_id", "left").join(properties.withColumnsRenamed({"name": "variable"}).withColumn("property", F.lit(True)), ["node_id", "variable"], "left")
    call_like = F.regexp_extract("variable", r"^([a-z_][a-z0-9_]*)\s*\(", 1)
    named_calls = own.select(F.col("node_id").alias("__n"), F.col("name").alias("__call"), "own_member")
    asked = asked.drop("own_member").join(named_calls, (F.col("node_id") == F.col("__n")) & (call_like == F.col("__call")), "left").drop("__n", "__call")
    scope = (
        F.when(F.col("hit_called"), "hits").when(F.col("hit"), "nobody").when(F.coalesce("read", F.lit(0)) < F.col("all_members"), "all").when(F.col("listed").isNull() | F.col("property"), "all").when(F.col("own_member").isNotNull(), "member").otherwise("nobody")
    )
    asked = scratch.keep(asked.withColumn("scope", scope).select(*d.columns, "scope"))
    via = lambda x, c, b: x.select("note_id", "pos", "node_id", "target", "description", "symbol", F.col(c).alias("via"), F.lit(b).alias("branch"))
    some = via(whole, "node_id", "bare").unionByName(via(asked.where("scope = 'all'"), "node_id", "bare")).unionByName(via(asked.where("scope = 'member'"), "own_member", "member"))
    some = some.unionByName(via(asked.where("scope = 'hits'").join(called_hits.select("note_id", "pos", "__m"), ["note_id", "pos"]), "__m", "member"))
    for b, c in (("self", "node_id"), ("member", "own_member"), ("resolved", "resolved")):
        some = some.unionByName(via(d.where(F.col("branch") == b), c, b))
    who = callers.select(F.col("callee").alias("via"), F.col("caller").alias("target_node")).distinct()
    routed = some.join(who, "via")
    text = via(d.where("branch = 'invokes'"), "node_id", "invokes").join(who, "via").join(invoked.withColumnsRenamed({"node_id": "target_node", "called": "symbol"}), ["target_node", "symbol"], "left_semi")
    routed = routed.unionByName(text).select("note_id", "pos", "target_node", F.col("node_id").alias("source"), F.col("target").alias("parameter_name"), "description", "branch").distinct()
    routed = scratch.keep(routed)
    got = routed.select("note_id", "pos").distinct()
    called_nodes = callers.select(F.col("callee").alias("node_id"), F.lit(True).alias("called")).distinct()
    missed = d.join(got, ["note_id", "pos"], "left_anti").join(called_nodes, "node_id", "left")
    miss = F.when(F.col("called").isNull(), "no-caller").when(F.col("branch") == "bare", "no-parameter").otherwise("not-invoked")
    return routed, missed.select("note_id", "node_id", "pos", "target", "branch", miss.alias("miss"))


def distinct_demands(demands: DataFrame, upstream: bool) -> DataFrame:
    """Exact repeats of a target's demands merged: upstream ones by source, parameter and text, others by text, case
    and white space aside. Adds `merged`, how many one stands for; the first by source and text stays."""
    d = demands.withColumn("norm", one_space(F.coalesce("description", F.lit(""))))
    keys = ["target_node", "source", "parameter_name", "norm"] if upstream else ["target_node", "norm"]
    first = F.min(F.struct(*[c for c in ("source", "description") if c not in keys])).alias("f")
    g = d.groupBy(*keys).agg(first, F.count(F.lit(1)).alias("merged"))
    return g.select("target_node", "source", "parameter_name", F.col("f.description").alias("description"), "merged") if upstream else g.select("target_node", "f.source", "f.description", "merged")


def cve_demands(records: DataFrame, imports: DataFrame, uses: DataFrame) -> DataFrame:
    """(target_node, source, description): what a CVE's record (source_cve, namespace, description) asks of every node that
    imports its namespace and uses it: `imports` and `uses` are (node_id, namespace), repeated rows count once."""
    at = imports.select("node_id", "namespace").distinct().join(uses.select("node_id", "namespace").distinct(), ["node_id", "namespace"], "left_semi")
    return records.select("namespace", F.col("source_cve").alias("source"), "description").join(at, "namespace").select(F.col("node_id").alias("target_node"), "source", "description")


def usage_hints(records: DataFrame, imports: DataFrame, uses: DataFrame, shown: int = 5) -> DataFrame:
    """Adds to CVE records `hint`: the first nodes that import and use the namespace, in order, and how many more there
    are; null where there is none. Only the first few of a namespace are put into one row."""
    at = imports.select("node_id", "namespace").distinct().join(uses.select("node_id", "namespace").distinct(), ["node_id", "namespace"], "left_semi")
    from pyspark.sql import Window

    n = at.groupBy("namespace").agg(F.count(F.lit(1)).alias("__all"))
    top = at.withColumn("__r", F.row_number().over(Window.partitionBy("namespace").orderBy("node_id"))).where(F.col("__r") <= shown)
    names = top.groupBy("namespace").agg(F.array_join(F.array_sort(F.collect_list("node_id")), ", ").alias("__names")).join(n, "namespace")
    more = F.when(F.col("__all") > shown, F.concat(F.lit(" (+"), F.col("__all") - shown, F.lit(" more)"))).otherwise("")
    return records.join(names, "namespace", "left").withColumn("hint", F.concat("__names", more)).drop("__names", "__all")


def failed_demands(evaluations: DataFrame, demands: DataFrame) -> DataFrame:
    """Evaluations (target_node, demand_id, status, evidence) that failed, with what was asked: demands are (target_node,
    demand_id, source, parameter_name, description), their ids positional. The label is the parameter's or source's name,
    with the place where the node has it several times; of an id that no demand has it is the id, and the text says so."""
    label = F.coalesce(F.nullif("parameter_name", F.lit("")), F.nullif("source", F.lit("")), F.lit("unknown"))
    d = demands.withColumn("__label", label)
    n = d.groupBy("target_node", "__label").agg(F.count(F.lit(1)).alias("__n"))
    d = d.join(n, ["target_node", "__label"]).select("target_node", "demand_id", F.when(F.col("__n") > 1, F.concat("__label", F.lit("#"), F.substring("demand_id", 2, 20))).otherwise(F.col("__label")).alias("__shown"), F.col("description").alias("__text"))
    e = evaluations.where("status = 'FAILED'").join(d.withColumn("__known", F.lit(True)), ["target_node", "demand_id"], "left")
    asked = F.when(F.col("__known"), F.coalesce("__text", F.lit("None"))).otherwise("No description found.")
    text = F.concat(F.lit("Fails to satisfy demand: '"), asked, F.lit("'. Evidence: "), F.coalesce("evidence", F.lit("None")))
    return e.select("target_node", "demand_id", F.coalesce("__shown", "demand_id").alias("label"), text.alias("description"))
