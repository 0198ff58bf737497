"""Queries of the training-data operators, each with its SQL where SQL can say it on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import components, mixing, near_duplicates, packing, reading, survivors, tokens
from auditlake.session import Scratch, filled, table, trimmed

QUERIES: dict = {}
SQL: dict[str, str] = {}
_WS = r"' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def query(f):
    QUERIES[f.__name__] = f
    return f


# 1: near-duplicates --------------------------------------------------------------------------------------------


def _near_findings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = table(spark, d, "findings").where(filled("description") & F.col("finding_id").isNotNull())
    f = f.withColumn("cwe", F.when(filled("cwe_id"), F.upper(trimmed("cwe_id"))))
    return near_duplicates.near_duplicates(f, "finding_id", ["description", "vulnerable_component"], 0.7, ["cwe"])


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of findings that write down one defect in slightly different words, copies among them, as its definition
    has it. `p1_classes` and `p1_links` say the same by representatives."""
    pairs, members, kept = _near_findings(spark, d)
    found = near_duplicates.member_pairs(pairs, members, "finding_id", "cwe").select(F.col("a").alias("finding_a"), F.col("b").alias("finding_b"))
    return near_duplicates.release_with(found, kept)


SQL["p1_found"] = f"""
WITH f AS (
  SELECT DISTINCT ON (finding_id) finding_id AS id, nullif(upper(trim(coalesce(cwe_id, ''), {_WS})), '') AS cwe,
    list_distinct(regexp_extract_all(lower(description || ' ' || coalesce(vulnerable_component, '')), '[a-z0-9]+')) AS words
  FROM findings WHERE length(trim(coalesce(description, ''), {_WS})) > 0),
w AS (SELECT id, unnest(words) AS word FROM f),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM w a JOIN w b ON a.word = b.word AND a.id < b.id GROUP BY ALL)
SELECT a AS finding_a, b AS finding_b FROM c JOIN f x ON x.id = a JOIN f y ON y.id = b
WHERE n * 10 >= 7 * (len(x.words) + len(y.words) - n) AND (x.cwe IS NULL OR y.cwe IS NULL OR x.cwe = y.cwe)
"""


def _class_names(members: DataFrame) -> DataFrame:
    return members.groupBy("sig").agg(F.min("finding_id").alias("class_id"))


@query
def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every finding with words: its class of equal word sets, named by its smallest finding, and how many other
    classes are alike to it. The form for collections with large groups of copies, which are never paired."""
    pairs, members, kept = _near_findings(spark, d)
    ends = pairs.select(F.explode(F.array("sig_a", "sig_b")).alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    out = members.select("sig", "finding_id").distinct().join(_class_names(members), "sig").join(ends, "sig", "left").select("finding_id", "class_id", F.coalesce("n", F.lit(0)).alias("links"))
    return near_duplicates.release_with(out, kept)


@query
def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of alike classes by their names, the smaller first, with the words of each and those in common. Together with
    the members in `p1_classes` it holds every link between different texts."""
    pairs, members, kept = _near_findings(spark, d)
    name = lambda x: _class_names(members).select(F.col("sig").alias(f"sig_{x}"), F.col("class_id").alias(f"c_{x}"))
    p = pairs.join(name("a"), "sig_a").join(name("b"), "sig_b")
    first = F.col("c_a") < F.col("c_b")
    words = lambda x, y: F.when(first, F.col(f"size_{x}")).otherwise(F.col(f"size_{y}"))
    out = p.select(F.least("c_a", "c_b").alias("class_a"), F.greatest("c_a", "c_b").alias("class_b"), words("a", "b").alias("words_a"), words("b", "a").alias("words_b"), "common")
    return near_duplicates.release_with(out, kept)


@query
def p1_matrix(spark: SparkSession, d: str) -> DataFrame:
    """How the matrix works on these tables: sets, their groups, sets that share a group, the pairs of a set and a group that
    tokens, sizes and places leave, and how many of those the bound lets be opened."""
    f = table(spark, d, "findings").where(filled("description") & F.col("finding_id").isNotNull())
    counts, rows, tokens = near_duplicates.token_counts(f, ["description", "vulnerable_component"])
    words = near_duplicates.matrix_words(rows, tokens)
    kept = near_duplicates.classes(f, "finding_id", ["description", "vulnerable_component"], counts, rows, words, []).persist()
    sets = kept.where("tokens IS NOT NULL")
    one = F.lit(1).alias("one")
    size = sets.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).agg(one, F.sum("n").alias("sets"), F.count(F.lit(1)).alias("groups"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("in_shared_groups"))
    pairs = lambda bounded, name: near_duplicates.met_groups(sets, 0.7, words, bounded).agg(one, F.count(F.lit(1)).alias(name))
    return near_duplicates.release_with(size.join(pairs(False, "met"), "one").join(pairs(True, "opened"), "one").select(F.lit(64 * words).alias("columns"), "sets", "groups", "in_shared_groups", "met", "opened"), kept)


_CLASSES = f"""f AS (
  SELECT DISTINCT ON (finding_id) finding_id AS id, list_sort(list_distinct(regexp_extract_all(lower(description || ' ' || coalesce(vulnerable_component, '')), '[a-z0-9]+'))) AS words
  FROM findings WHERE finding_id IS NOT NULL AND length(trim(coalesce(description, ''), {_WS})) > 0),
c AS (SELECT words, min(id) AS class_id FROM f WHERE len(words) > 0 GROUP BY words),
w AS (SELECT class_id, len(words) AS n, unnest(words) AS word FROM c),
x AS (SELECT a.class_id AS class_a, b.class_id AS class_b, a.n AS words_a, b.n AS words_b, count(*) AS common FROM w a JOIN w b ON a.word = b.word AND a.class_id < b.class_id GROUP BY ALL),
alike AS (SELECT * FROM x WHERE common * 10 >= 7 * (words_a + words_b - common))"""
SQL["p1_links"] = f"WITH {_CLASSES} SELECT class_a, class_b, CAST(words_a AS INTEGER) AS words_a, CAST(words_b AS INTEGER) AS words_b, CAST(common AS INTEGER) AS common FROM alike"
SQL["p1_classes"] = f"""
WITH {_CLASSES}, e AS (SELECT class_id, count(*) AS n FROM (SELECT class_a AS class_id FROM alike UNION ALL SELECT class_b FROM alike) GROUP BY class_id)
SELECT f.id AS finding_id, c.class_id, coalesce(e.n, 0) AS links FROM f JOIN c ON c.words = f.words LEFT JOIN e ON e.class_id = c.class_id
"""


# 2: best representative ----------------------------------------------------------------------------------------

#: Statuses from low to high; the last two stand equal, others and null stand with the first.
LADDER = [["hypothesis"], ["review_error"], ["confirmed"], ["chained"], ["insufficient_context"], ["exploitable"], ["false_positive", "unchainable"]]


def status_rank(status) -> F.Column:
    norm = F.lower(trimmed(status))
    out = F.lit(0)
    for rank, names in enumerate(LADDER):
        out = F.when(norm.isin(names), rank).otherwise(out)
    return out


def node_count(nodes: str):
    return F.size(F.array_distinct(F.filter(F.transform(F.coalesce(nodes, F.array().cast("array<string>")), trimmed), lambda x: x.isNotNull() & (F.length(x) > 0))))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """For each vuln_id with two records or more, the records that status, nodes and text come from."""
    at = F.col("updated_at")
    out = survivors.pick_by_preference(
        table(spark, d, "finding_updates"), F.lower(trimmed("vuln_id")), "update_id",
        {"status_from": ([status_rank("status"), at], None), "nodes_from": ([node_count("affected_nodes"), at], None), "text_from": ([at], filled("description"))},
    )
    return out.withColumnRenamed("key", "vuln_id")


SQL["p2_found"] = f"""
WITH u AS (
  SELECT DISTINCT ON (update_id) lower(trim(vuln_id, {_WS})) AS vuln_id, update_id, updated_at,
    CASE lower(trim(status, {_WS})) WHEN 'review_error' THEN 1 WHEN 'confirmed' THEN 2 WHEN 'chained' THEN 3 WHEN 'insufficient_context' THEN 4
      WHEN 'exploitable' THEN 5 WHEN 'false_positive' THEN 6 WHEN 'unchainable' THEN 6 ELSE 0 END AS rank,
    len(list_distinct(list_filter(list_transform(coalesce(affected_nodes, []), lambda x: trim(x, {_WS})), lambda x: x IS NOT NULL AND x <> ''))) AS nodes,
    length(trim(coalesce(description, ''), {_WS})) > 0 AS has_text
  FROM finding_updates WHERE vuln_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY vuln_id ORDER BY rank DESC, updated_at DESC NULLS LAST, update_id DESC) AS rs,
  row_number() OVER (PARTITION BY vuln_id ORDER BY nodes DESC, updated_at DESC NULLS LAST, update_id DESC) AS rn,
  row_number() OVER (PARTITION BY vuln_id ORDER BY has_text DESC, updated_at DESC NULLS LAST, update_id DESC) AS rt FROM u)
SELECT vuln_id, max(update_id) FILTER (rs = 1) AS status_from, max(update_id) FILTER (rn = 1) AS nodes_from, max(update_id) FILTER (rt = 1 AND has_text) AS text_from
FROM r GROUP BY vuln_id HAVING count(*) >= 2
"""


def update_claims(spark: SparkSession, d: str) -> DataFrame:
    """What each agent states about status and nodes of each vuln_id. A null list states nothing at all; an empty one, or one of blanks, states that there are none."""
    u = table(spark, d, "finding_updates").select(F.lower(trimmed("vuln_id")).alias("key"), F.lower(trimmed("emitted_by")).alias("source"), "status", "affected_nodes")
    status = F.lower(trimmed("status"))
    a = u.where(filled("status")).select(F.lit("status").alias("field"), "key", "source", status.alias("value"))
    nodes = F.filter(F.transform("affected_nodes", trimmed), lambda x: x.isNotNull() & (F.length(x) > 0))
    b = u.where(F.col("affected_nodes").isNotNull()).select(F.lit("affected_nodes").alias("field"), "key", "source", F.explode_outer(nodes).alias("value"))
    return a.unionByName(b)


@query
def p2_merged(spark: SparkSession, d: str) -> DataFrame:
    """For each vuln_id the likeliest status and every node judged true by the latent model of its agents' quality.
    Where no node reaches even odds the likeliest one stays, the first by name among equals."""
    judged = survivors.judge_values(update_claims(spark, d), Scratch(spark)).facts
    kept = judged.groupBy("key").agg(
        F.max(F.when(F.col("field") == "status", F.struct(F.round("truth", 9).alias("t"), "value"))).alias("s"),
        F.array_sort(F.collect_set(F.when((F.col("field") == "affected_nodes") & (F.round("truth", 9) >= 0.5), F.col("value")))).alias("nodes"),
        F.max(F.when(F.col("field") == "affected_nodes", F.struct(F.round("truth", 9).alias("t"), "value"))).alias("n"),
    )
    return kept.select(F.col("key").alias("vuln_id"), F.col("s.value").alias("status"), F.when((F.size("nodes") > 0) | F.col("n").isNull(), F.col("nodes")).otherwise(F.array("n.value")).alias("affected_nodes"))


@query
def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """Every status and node that agents stated of a vuln_id, how many of them stated it, and how likely it is true."""
    judged = survivors.judge_values(update_claims(spark, d), Scratch(spark)).facts
    return judged.select(F.col("key").alias("vuln_id"), "field", "value", "agents", F.round("truth", 9).alias("truth"))


@query
def p2_sources(spark: SparkSession, d: str) -> DataFrame:
    """What the model holds of each agent: how often it states a value that is true and leaves out one that isn't, after how
    many rounds, and by how much the last one moved any of them."""
    j = survivors.judge_values(update_claims(spark, d), Scratch(spark))
    return j.sources.select("field", "source", "sensitivity", "specificity", F.lit(j.rounds).alias("rounds"), F.lit(float(j.last_change)).alias("last_change"))


@query
def p2_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How far the model's records agree with those that the ladder and the counts pick in `p2_found`: vuln_ids, those of the
    same status, of the same nodes, and of nodes that hold all those of the record picked."""
    u = table(spark, d, "finding_updates").where("update_id IS NOT NULL")
    picked, merged = p2_found(spark, d), p2_merged(spark, d)
    nodes = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("affected_nodes", F.array().cast("array<string>")), trimmed), lambda x: x.isNotNull() & (F.length(x) > 0))))
    one = u.groupBy("update_id").agg(F.first(F.lower(trimmed("status"))).alias("s"), F.first(nodes).alias("n"))  # rows sent again are alike
    a = picked.join(one.select(F.col("update_id").alias("status_from"), "s"), "status_from").join(one.select(F.col("update_id").alias("nodes_from"), "n"), "nodes_from")
    b = merged.select("vuln_id", F.col("status").alias("ms"), F.array_sort(F.coalesce("affected_nodes", F.array().cast("array<string>"))).alias("mn"))
    j = a.join(b, "vuln_id")
    return j.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("s").eqNullSafe(F.col("ms"))).alias("same_status"), F.count_if(F.col("n") == F.col("mn")).alias("same_nodes"), F.count_if(F.size(F.array_except("n", "mn")) == 0).alias("all_nodes"))


# 5: groups from overlapping lists ------------------------------------------------------------------------------


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every vuln_id that proposals tie to another, with the smallest vuln_id of its group."""
    names = table(spark, d, "findings").where(filled("vuln_id")).groupBy(F.lower(trimmed("vuln_id")).alias("vuln_id")).agg(F.min("finding_id").alias("id"))
    scratch = Scratch(spark)
    names = scratch.keep(names.where(F.col("id").isNotNull()))
    members = table(spark, d, "clusters").select("proposal_id", F.explode("member_vuln_ids").alias("m")).select("proposal_id", F.lower(trimmed("m")).alias("vuln_id"))
    members = members.where(F.col("proposal_id").isNotNull()).join(names, "vuln_id").select("proposal_id", "id").distinct()
    labels = components.components(components.star_edges(members, "proposal_id", "id"), "a", "b", scratch)
    named = labels.join(names, "id").select("vuln_id", "root")
    groups = named.groupBy("root").agg(F.min("vuln_id").alias("group_id"))
    return named.join(groups, "root").select("vuln_id", "group_id")


SQL["p5_found"] = f"""
WITH RECURSIVE f AS (SELECT DISTINCT lower(trim(vuln_id, {_WS})) AS v FROM findings WHERE vuln_id IS NOT NULL),
m AS (SELECT DISTINCT proposal_id AS p, v FROM (SELECT proposal_id, lower(trim(unnest(member_vuln_ids), {_WS})) AS v FROM clusters) JOIN f USING (v) WHERE v <> ''),
reach(a, b) AS (SELECT v, v FROM m UNION SELECT r.a, m2.v FROM reach r JOIN m m1 ON m1.v = r.b JOIN m m2 ON m2.p = m1.p)
SELECT a AS vuln_id, min(b) AS group_id FROM reach GROUP BY a HAVING count(*) > 1
"""


# 6 and 7: packing and mixing -----------------------------------------------------------------------------------


def token_table(spark: SparkSession, d: str, scratch: Scratch, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of every document, counted once and kept."""
    docs = table(spark, d, "documents").withColumn("source", mixing.normal_source("source"))
    return scratch.keep(tokens.with_token_counts(docs, ["doc_id", "source"], "text", vocabulary))


def source_totals(counted: DataFrame, named: list[str]) -> tuple[dict, int]:
    """Tokens of each named source and, under None, of all others; and the number of documents."""
    one = F.when(F.col("source").isin(named), F.col("source"))
    rows = counted.groupBy(one.alias("source")).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    return {r.source: r.t or 0 for r in rows}, sum(r.n for r in rows)


def _windows(spark: SparkSession, d: str, scratch: Scratch):
    limits = packing.read_limits(table(spark, d, "pack_limits"))
    counted = token_table(spark, d, scratch)
    targets = mixing.read_targets(table(spark, d, "mix_targets"))
    totals, n = source_totals(counted, [t.source for t in targets])
    all_queues = packing.queues(targets, totals)
    size = packing.WINDOW_CONTAINERS * max((c for _, c in limits), default=1)
    return counted, limits, all_queues, size, packing.with_windows(counted, all_queues, size, n)


@query
def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document's pieces in containers of each capacity. A document without tokens is in none: its slot is null."""
    scratch = Scratch(spark)
    counted, limits, _, _, windowed = _windows(spark, d, scratch)
    packed = packing.pack(windowed, limits)
    names = F.array(*[F.lit(n) for n, _ in limits]) if limits else F.array().cast("array<string>")
    none = counted.where("tokens = 0").select(F.explode(names).alias("limit_name"), F.lit(None).cast("bigint").alias("window"), F.lit(None).cast("int").alias("slot"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("first_token"), F.lit(0).cast("bigint").alias("tokens"))
    return packed.unionByName(none)


@query
def p6_whole(spark: SparkSession, d: str) -> DataFrame:
    """Of every document and capacity: whether its pieces hold all its tokens, one after the other, whether it is split only
    if it alone exceeds the capacity, and whether no container it is in holds more than the capacity."""
    scratch = Scratch(spark)
    counted, limits, _, _, windowed = _windows(spark, d, scratch)
    packed = scratch.keep(packing.pack(windowed, limits))
    capacity = F.lit(None).cast("bigint")
    for n, c in limits:
        capacity = F.when(F.col("limit_name") == n, F.lit(c)).otherwise(capacity)
    load = packed.groupBy("limit_name", "window", "slot").agg(F.sum("tokens").alias("load"))
    p = packed.join(load, ["limit_name", "window", "slot"]).withColumn("capacity", capacity)
    per = p.groupBy("limit_name", "doc_id").agg(
        F.sum("tokens").alias("held"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("first_token") + F.col("tokens")).alias("end"), F.count_distinct("piece").alias("numbers"), F.max("piece").alias("last"), F.min(F.col("load") <= F.col("capacity")).alias("fits")
    )
    names = F.array(*[F.struct(F.lit(n).alias("limit_name"), F.lit(c).alias("capacity")) for n, c in limits]) if limits else F.array().cast("array<struct<limit_name:string,capacity:int>>")
    every = counted.select("doc_id", F.col("tokens").alias("size"), F.explode(names).alias("x")).select("doc_id", "size", "x.*").join(per, ["limit_name", "doc_id"], "left")
    none = F.coalesce("pieces", F.lit(0)) == 0
    whole = F.when(none, F.col("size") == 0).otherwise((F.col("held") == F.col("size")) & (F.col("end") == F.col("size")) & (F.col("pieces") == F.col("numbers")) & (F.col("last") + 1 == F.col("pieces")))
    return every.select("limit_name", "doc_id", whole.alias("whole"), (none | (F.col("pieces") == 1) | (F.col("size") > F.col("capacity"))).alias("split_if_larger"), F.coalesce("fits", none).alias("fits"))


SQL["p6_whole"] = "SELECT limit_name, doc_id, true AS whole, true AS split_if_larger, true AS fits FROM documents, pack_limits"


@query
def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each capacity are."""
    packed = p6_packed(spark, d).where("slot IS NOT NULL").groupBy("limit_name", "window", "slot").agg(F.sum("tokens").alias("tokens"))
    limits = table(spark, d, "pack_limits")
    per = packed.groupBy("limit_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return per.join(limits, "limit_name").select("limit_name", "capacity_tokens", "containers", "tokens", "fullest", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"))


@query
def p6_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each queue in each window, and its share of a round."""
    _, _, all_queues, _, windowed = _windows(spark, d, Scratch(spark))
    share = F.lit(None).cast("double")
    for n, (p, _) in all_queues.items():
        share = F.when(F.col("source") == n, F.lit(float(p))).otherwise(share)
    return windowed.groupBy("window", "source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")).withColumn("share", share)


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, float]]:
    scratch = Scratch(spark)
    counted = token_table(spark, d, scratch)
    targets = mixing.read_targets(table(spark, d, "mix_targets"))
    totals, n = source_totals(counted, [t.source for t in targets])
    p = mixing.plan(targets, totals)
    return mixing.sample(counted.where("tokens > 0"), p.copies, n, seed=7), p.shares


@query
def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """One row per copy of each document in the mixture of the largest total that reaches every target."""
    used, _ = _mixture(spark, d)
    return used.where("copies > 0").select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))


@query
def p7_copies(spark: SparkSession, d: str) -> DataFrame:
    """Every document of a source with a target that has tokens: whether it is used at most as often as it may be."""
    used, _ = _mixture(spark, d)
    most = F.lit(None).cast("int")
    for t in mixing.read_targets(table(spark, d, "mix_targets")):
        most = F.when(F.col("source") == t.source, F.lit(t.max_repeat)).otherwise(most)
    return used.select("doc_id", "source", F.col("copies").between(0, most).alias("within"))


SQL["p7_copies"] = f"SELECT doc_id, m.source, true AS within FROM documents d JOIN mix_targets m ON m.source = lower(trim(d.source, {_WS})) WHERE d.text <> ''"


@query
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    used, shares = _mixture(spark, d)
    return mixing.report(used, table(spark, d, "mix_targets"), shares)


# 8: reading level ----------------------------------------------------------------------------------------------


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The level of every English document with running prose."""
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "level_labels"), Scratch(spark)).select("doc_id", "level")


@query
def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents, mean share of unfamiliar words and mean sentence length of each level."""
    r = reading.reading_levels(table(spark, d, "documents"), table(spark, d, "level_labels"), Scratch(spark))
    return r.groupBy("level").agg(F.count(F.lit(1)).alias("documents"), F.avg("unfamiliar_share").alias("unfamiliar_share"), F.avg("sentence_length").alias("sentence_length"))


@query
def p8_formula(spark: SparkSession, d: str) -> DataFrame:
    """The level of every such document by the formula alone, with its score and the two parts."""
    return reading.formula_reading(table(spark, d, "documents"), table(spark, d, "level_labels"), Scratch(spark)).select("doc_id", "unfamiliar_share", "sentence_length", "score", "level")


@query
def p8_held_out(spark: SparkSession, d: str) -> DataFrame:
    """How many held-out documents the grid of `p8_found` and the formula of `p8_formula` put where their graders did."""
    return reading.held_out(table(spark, d, "documents"), table(spark, d, "level_labels"), Scratch(spark))
