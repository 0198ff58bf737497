"""Queries over findings, their updates, documents and the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.functions import cvss, paths, text
from auditlake.operators import code, groups, histories, linkage, merge, ordering, search, stats
from auditlake.session import Scratch, filled, table, trimmed
from auditlake.sources.graphs import advisory_records, fresh

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


def _findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings, each id once; rows sent again differ in their arrival only."""
    return table(spark, d, "findings").drop("arrived_at").dropDuplicates(["finding_id"])


_ONE = lambda c: f"regexp_replace(lower(trim({c}, {_WS})), '\\s+', ' ', 'g')"
_BOTH = "list_filter(list_concat(coalesce({0}, []), coalesce({1}, [])), lambda x: x IS NOT NULL AND x <> '')"
_UNION = lambda x, y: f"list_filter({_BOTH.format(x, y)}, lambda x, i: list_position({_BOTH.format(x, y)}, x) = i)"
_F = "f AS (SELECT DISTINCT ON (finding_id) * EXCLUDE (arrived_at) FROM findings)"
_U = f"u AS (SELECT DISTINCT ON (update_id) * EXCLUDE (arrived_at), lower(trim(vuln_id, {_WS})) AS key FROM finding_updates WHERE vuln_id IS NOT NULL)"


def _updates(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "finding_updates").where("vuln_id IS NOT NULL")
    return u.withColumn("key", F.lower(trimmed("vuln_id"))).drop("arrived_at").dropDuplicates(["update_id"])


# Identity ------------------------------------------------------------------------------------------------------


def _sig(c: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace(coalesce({c}, ''), '[`''\"]', '', 'g')), '[^a-z0-9]+', '_', 'g'), '_')"


_CWES = ", ".join(f"'{c}'" for c in text.CWES)
_SYSTEMIC = ", ".join(f"'{c}'" for c in text.SYSTEMIC_CWES)
_RECORD_IDS = f"""
WITH {_F}, g AS (SELECT finding_id, CASE WHEN upper(trim(cwe_id, {_WS})) IN ({_CWES}) THEN upper(trim(cwe_id, {_WS})) ELSE 'OTHER_UNCATEGORIZED' END AS cwe,
  coalesce(nullif({_sig('vulnerable_component')}, ''), nullif({_sig('source_cve')}, ''), nullif({_sig('description')}, ''), '') AS raw_sig,
  coalesce(affected_nodes[1], 'general') AS primary_node, vulnerability_type AS kind, nullif(source_cve, '') AS cve, vulnerable_component AS component FROM f),
h AS (SELECT *, CASE WHEN length(raw_sig) - length(replace(raw_sig, '_', '')) + 1 > 6 OR length(raw_sig) > 60 THEN '' ELSE raw_sig END AS sig FROM g)
SELECT finding_id, cwe, CASE
  WHEN cwe IN ({_SYSTEMIC}) AND cve IS NULL AND NOT coalesce(kind IN ('Known Dependency Vulnerability', 'Dependency Mitigation Vulnerability'), false) THEN concat_ws(':', 'systemic', cwe, nullif(sig, ''))
  WHEN coalesce(kind = 'Known Dependency Vulnerability', false) THEN concat_ws(':', primary_node, cwe, coalesce(cve, 'unknown-cve'))
  ELSE concat_ws(':', primary_node, cwe, CASE WHEN component <> '' THEN lower(trim(component, {_WS})) ELSE 'general' END) END AS record_id
FROM h
"""


@query(_RECORD_IDS)
def record_ids(spark, d):
    """The identity every finding gets from its fields."""
    cwe = text.cwe_key("cwe_id")
    rid = text.record_id(F.col("cwe"), F.col("vulnerability_type"), F.col("affected_nodes"), F.col("vulnerable_component"), F.lit(None).cast("string"), F.col("source_cve"), F.col("description"))
    return _findings(spark, d).withColumn("cwe", cwe).select("finding_id", "cwe", rid.alias("record_id"))


_TOKENS = rf"list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(lower(trim(coalesce(vulnerable_component, ''), {_WS})), '\s+', ' ', 'g'), '[^a-z0-9$_%.''\"\[\] ]+', ' ', 'g'), {_WS}), '\s+'), lambda x: x <> ''))"


@query(f"""
WITH {_F}, t AS (SELECT finding_id, {_TOKENS} AS tokens, regexp_replace(lower(trim(coalesce(vulnerable_component, ''), {_WS})), '\\s+', ' ', 'g') AS raw, lower(coalesce(description, '')) AS body FROM f)
SELECT finding_id, len(tokens) AS tokens, raw = '' OR (NOT regexp_matches(raw, '[^\\w$\\s]') AND len(tokens) < 3) AS degenerate, len(list_filter(tokens, lambda x: contains(body, x))) AS named FROM t
""")
def anchors(spark, d):
    """How well each finding's component tells nodes apart, and how many of its tokens the description names."""
    tokens = text.component_tokens("vulnerable_component")
    body = F.lower(F.coalesce("description", F.lit("")))
    named = F.size(F.filter(F.col("t"), lambda x: F.contains(F.col("body"), x)))
    return _findings(spark, d).withColumns({"t": tokens, "body": body}).select("finding_id", F.size("t").alias("tokens"), text.degenerate_anchor("vulnerable_component").alias("degenerate"), named.alias("named"))


@query(f"""
WITH {_F}, k AS (SELECT finding_id, coalesce(vuln_id, '') AS v, coalesce(nullif(vulnerability_type, ''), 'Code Defect') AS kind, coalesce(cwe_id, '') AS cwe,
  array_to_string(list_sort(list_distinct(list_filter(coalesce(affected_nodes, []), lambda x: x IS NOT NULL AND x <> ''))), chr(31)) AS nodes,
  regexp_replace(lower(trim(coalesce(nullif(vulnerable_component, ''), description, ''), {_WS})), '\\s+', ' ', 'g') AS anchor,
  CASE WHEN coalesce(source_cve, '') <> '' THEN finding_id END AS alone FROM f)
SELECT kind, cwe, anchor, arg_min(finding_id, (v, finding_id)) AS first_id, count(*) AS records FROM k GROUP BY alone, kind, nodes, cwe, anchor
""")
def exact_findings(spark, d):
    """Findings that are the same by kind, nodes, class and anchor."""
    f = _findings(spark, d).withColumn("v", F.coalesce("vuln_id", F.lit("")))
    return linkage.exact_groups(f, ["v"])


@query(f"SELECT t AS norm_text, lang, count(*) AS copies, min(doc_id) AS first_id FROM (SELECT doc_id, lower(trim(lang, {_WS})) AS lang, md5(regexp_replace(lower(trim(text, {_WS})), '\\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL) GROUP BY ALL")
def exact_documents(spark, d):
    """Documents with the same text, case and white space aside, by digest."""
    n = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.lower(trimmed("lang")).alias("lang"), F.md5(text.one_space("text")).alias("norm_text"))
    return n.groupBy("norm_text", "lang").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))


@query(f"""
WITH RECURSIVE {_F}, k AS (SELECT {_ONE("vulnerable_component")} AS component, CASE WHEN upper(trim(cwe_id, {_WS})) IN ({_CWES}) THEN upper(trim(cwe_id, {_WS})) ELSE 'OTHER_UNCATEGORIZED' END AS cwe, coalesce(vuln_id, '') AS v, finding_id, coalesce(description, '') AS t, affected_nodes AS ns
  FROM f WHERE length(trim(coalesce(vulnerable_component, ''), {_WS})) > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY component, cwe ORDER BY v, finding_id) AS rn FROM k),
r AS (SELECT component, cwe, rn, finding_id AS first_id, t AS text, {_UNION("ns", "[]")} AS nodes FROM n WHERE rn = 1
  UNION ALL SELECT n.component, n.cwe, n.rn, first_id, CASE WHEN t <> '' AND NOT contains(text, t) THEN text || chr(10) || chr(10) || 'Additional context: ' || t ELSE text END, {_UNION("nodes", "ns")} FROM r JOIN n ON n.component = r.component AND n.cwe = r.cwe AND n.rn = r.rn + 1)
SELECT component, cwe, first_id, text, nodes, rn AS records FROM r QUALIFY row_number() OVER (PARTITION BY component, cwe ORDER BY rn DESC) = 1
""")
def merged_texts(spark, d):
    """Findings of one component and class as one, the later texts and nodes added to the first's."""
    f = _findings(spark, d).where(filled("vulnerable_component")).select(text.one_space("vulnerable_component").alias("component"), text.cwe_key("cwe_id").alias("cwe"), F.coalesce("vuln_id", F.lit("")).alias("v"), "finding_id", "description", "affected_nodes")
    return linkage.merge_texts(f, ["component", "cwe"], ["v"], "description", "affected_nodes", "finding_id")


@query(f"""
WITH RECURSIVE {_F}, d AS (SELECT DISTINCT source_cve AS key, description AS text FROM f WHERE length(trim(coalesce(source_cve, ''), {_WS})) > 0 AND description <> ''),
n AS (SELECT *, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS plain, row_number() OVER (PARTITION BY key ORDER BY length(text) DESC, text) AS rn FROM d),
r AS (SELECT key, rn, text, true AS kept, [plain] AS plains FROM n WHERE rn = 1
  UNION ALL SELECT n.key, n.rn, n.text, new, CASE WHEN new THEN list_append(plains, n.plain) ELSE plains END FROM (SELECT n.*, r.plains, len(r.plains) < 3 AND len(list_filter(r.plains, lambda x: contains(x, n.plain))) = 0 AS new FROM r JOIN n ON n.key = r.key AND n.rn = r.rn + 1) n)
SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY rn) AS INTEGER) AS place, text FROM r WHERE kept
""")
def cve_descriptions(spark, d):
    """Up to three descriptions of each CVE, none contained in another."""
    return linkage.distinct_descriptions(_findings(spark, d).where(filled("source_cve")), "source_cve", "description")


@query(f"WITH {_F} SELECT finding_id, CASE WHEN octet_length(encode(replace(replace(vuln_id, '/', '_'), '\\', '_'))) <= 240 THEN replace(replace(vuln_id, '/', '_'), '\\', '_') END AS file_name, md5(concat_ws(chr(31), coalesce(vuln_id, ''), coalesce(description, ''), coalesce(vulnerable_component, ''))) AS content_key FROM f")
def cache_keys(spark, d):
    """A safe file name and a digest of the content of each finding."""
    key = F.md5(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in ("vuln_id", "description", "vulnerable_component")]))
    return _findings(spark, d).select("finding_id", text.file_name("vuln_id").alias("file_name"), key.alias("content_key"))


@query()
def redacted(spark, d):
    """Descriptions without version numbers."""
    return _findings(spark, d).select("finding_id", text.without_versions("description").alias("description"))


# Merging updates -----------------------------------------------------------------------------------------------

_RANK = "CASE lower(trim(status, " + _WS + ")) " + " ".join(f"WHEN '{s}' THEN {r}" for s, r in merge.RANKS.items()) + " ELSE 0 END"


@query(f"""
WITH {_U}, r AS (SELECT key, update_id, {_RANK} AS rank, updated_at FROM u),
b AS (SELECT *, max(rank) OVER (PARTITION BY key ORDER BY updated_at NULLS FIRST, update_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
SELECT key, update_id, rank, before IS NULL OR rank > before AS replaces FROM b WHERE before IS NULL OR rank >= before
""")
def ladder_updates(spark, d):
    """The updates that a plain status ladder keeps."""
    order = [F.col("updated_at").asc_nulls_first(), F.col("update_id")]
    return merge.surviving_updates(_updates(spark, d), "key", order, "status", Scratch(spark)).select("key", "update_id", "rank", "replaces")


def merge_input(u: DataFrame) -> DataFrame:
    """Updates as the reducer takes them; CVE, patch state and reset are null where the table lacks them."""
    given = lambda c, kind: F.col(c) if c in u.columns else F.lit(None).cast(kind)
    return u.select("key", F.col("updated_at").alias("seq"), F.col("update_id").alias("id"), "status", "description", "affected_nodes", given("cve", "string").alias("source_cve"), given("patch", "string").alias("patch_state"), F.coalesce(given("reset", "boolean"), F.lit(False)).alias("force_reset"))


_ANSWERS = ", ".join(f"'{s}'" for s in sorted(merge.ANSWERS))


@query(f"""
WITH RECURSIVE {_U}, n AS (SELECT key, update_id, coalesce(nullif(lower(trim(status, {_WS})), ''), 'hypothesis') AS s, {_RANK} AS rank, description, affected_nodes, row_number() OVER (PARTITION BY key ORDER BY updated_at NULLS FIRST, update_id) AS rn FROM u),
r AS (SELECT key, rn, s, rank, description, affected_nodes AS nodes, update_id AS seed FROM n WHERE rn = 1
  UNION ALL SELECT key, rn, CASE WHEN take THEN new_s ELSE s END, CASE WHEN take THEN new_rank ELSE rank END,
    CASE WHEN take THEN new_text WHEN same AND coalesce(new_text, '') <> '' AND NOT contains(coalesce(description, ''), new_text) THEN coalesce(description, '') || chr(10) || chr(10) || 'Additional context: ' || new_text ELSE description END,
    CASE WHEN take THEN {_UNION("new_nodes", "nodes")} WHEN same THEN {_UNION("nodes", "new_nodes")} ELSE nodes END, CASE WHEN take THEN new_id ELSE seed END
  FROM (SELECT n.key, n.rn, r.s, r.rank, r.description, r.nodes, r.seed, n.s AS new_s, n.rank AS new_rank, n.description AS new_text, n.affected_nodes AS new_nodes, n.update_id AS new_id,
      (r.s = 'insufficient_context' AND n.s IN ({_ANSWERS})) OR n.rank > r.rank AS take, n.rank = r.rank AS same FROM r JOIN n ON n.key = r.key AND n.rn = r.rn + 1))
SELECT key, s AS status, description, nodes AS affected_nodes, seed AS seed_id, rn AS records FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY rn DESC) = 1
""")
def merged_records(spark, d):
    """One record per vuln_id by the order-dependent reducer."""
    m = merge.merge_records(merge_input(_updates(spark, d)))
    return m.select("key", "status", "description", "affected_nodes", "seed_id", "records")


@query(f"WITH {_U} SELECT key, emitted_by, min(update_id) AS update_id, count(*) AS asked FROM u GROUP BY ALL")
def claims(spark, d):
    """Which update of each agent came first for each vuln_id."""
    return merge.first_claims(_updates(spark, d), ["key", "emitted_by"], ["update_id"])


@query(f"""
WITH {_U} SELECT CASE WHEN grouping(a) = 1 THEN 'TOTAL' ELSE a END AS agent, count(*) AS calls, CAST(sum(length(coalesce(description, ''))) AS BIGINT) AS characters, CAST(sum(len(coalesce(affected_nodes, []))) AS BIGINT) AS nodes
FROM (SELECT coalesce(lower(trim(emitted_by, {_WS})), 'unknown') AS a, description, affected_nodes FROM u) GROUP BY ROLLUP (a)
""")
def usage(spark, d):
    """What each agent wrote, and the total."""
    u = _updates(spark, d).select(F.lower(trimmed("emitted_by")).alias("who"), F.length(F.coalesce("description", F.lit(""))).cast("bigint").alias("characters"), F.size(F.coalesce("affected_nodes", F.array().cast("array<string>"))).cast("bigint").alias("nodes"))
    return stats.usage_rollup(u, "who", ["characters", "nodes"])


STATUSES = ["hypothesis", "review_error", "confirmed", "chained", "insufficient_context", "exploitable", "false_positive", "unchainable"]


@query("WITH " + _U + " SELECT lower(trim(emitted_by, " + _WS + ")) AS agent, " + ", ".join(f"count_if(s = '{s}') AS {s}" for s in STATUSES) + ", count(*) AS \"all\" FROM (SELECT *, lower(trim(status, " + _WS + ")) AS s FROM u) GROUP BY 1")
def verdicts(spark, d):
    """Statuses per agent."""
    u = _updates(spark, d).select(F.lower(trimmed("emitted_by")).alias("agent"), F.lower(trimmed("status")).alias("s"))
    return stats.status_pivot(u, "agent", "s", STATUSES)


@query(f"""
WITH {_U}, m AS (SELECT max(updated_at) AS now FROM u)
SELECT key, max(updated_at) AS last_at, count(*) AS updates FROM u WHERE updated_at > (SELECT now FROM m) - INTERVAL 168 HOUR AND updated_at <= (SELECT now FROM m) GROUP BY key
""")
def fresh_updates(spark, d):
    """Updates at most a week older than the latest of all."""
    u = _updates(spark, d).withColumn("one", F.lit(1))
    now = u.groupBy("one").agg(F.max("updated_at").alias("now"))  # one row
    return fresh(u.join(now, "one"), "updated_at", F.col("now"), 168).groupBy("key").agg(F.max("updated_at").alias("last_at"), F.count(F.lit(1)).alias("updates"))


@query(f"""
WITH {_U}, p AS (SELECT key, update_id, emitted_by, lower(trim(status, {_WS})) AS s FROM u)
SELECT key, update_id, emitted_by IS NOT DISTINCT FROM lag(emitted_by) OVER w AND s IS NOT DISTINCT FROM lag(s) OVER w AND lag(update_id) OVER w IS NOT NULL AS repeats,
  CAST(count_if(emitted_by = 'explorer') OVER (PARTITION BY key ORDER BY update_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS unit
FROM p WINDOW w AS (PARTITION BY key ORDER BY update_id)
""")
def turn_units(spark, d):
    """Whether an update says what the one before said, and to which unit, each begun by an explorer, it belongs."""
    w = Window.partitionBy("key").orderBy("update_id")
    p = _updates(spark, d).select("key", "update_id", "emitted_by", F.lower(trimmed("status")).alias("s"))
    same = F.col("emitted_by").eqNullSafe(F.lag("emitted_by").over(w)) & F.col("s").eqNullSafe(F.lag("s").over(w)) & F.lag("update_id").over(w).isNotNull()
    unit = F.count_if(F.coalesce(F.col("emitted_by") == "explorer", F.lit(False))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return p.select("key", "update_id", same.alias("repeats"), unit.alias("unit"))


# Groups and batches --------------------------------------------------------------------------------------------

_CHUNKS = f"""
WITH {_F}, k AS (SELECT finding_id, CASE WHEN upper(trim(cwe_id, {_WS})) IN ({_CWES}) THEN upper(trim(cwe_id, {_WS})) ELSE 'OTHER_UNCATEGORIZED' END AS cwe, coalesce(affected_nodes[1], '') AS home, coalesce(vuln_id, '') AS v FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY cwe ORDER BY home, v, finding_id) AS rn, count(*) OVER (PARTITION BY cwe) AS n FROM k),
c AS (SELECT *, CASE WHEN n <= 50 THEN 0 ELSE (rn - 1) // CAST(ceil(n / ceil(n / 50)) AS BIGINT) END AS chunk FROM n)
SELECT cwe, finding_id, chunk, count(*) OVER (PARTITION BY cwe, chunk) AS chunk_size FROM c QUALIFY chunk_size >= 2
"""


@query(_CHUNKS)
def review_groups(spark, d):
    """Findings of a class in balanced chunks of at most 50, those of one home together; a lone one has nothing to compare."""
    f = _findings(spark, d).select("finding_id", text.cwe_key("cwe_id").alias("cwe"), F.coalesce(F.get("affected_nodes", F.lit(0)), F.lit("")).alias("home"), F.coalesce("vuln_id", F.lit("")).alias("v"))
    c = ordering.balanced_chunks(f, ["cwe"], ["home", "v", "finding_id"], 50, Scratch(spark))
    return c.where("chunk_size >= 2").select("cwe", "finding_id", "chunk", "chunk_size")


@query("""
WITH RECURSIVE n AS (SELECT coalesce(repo, '') AS repo, doc_id, coalesce(n_chars, 0) AS n, row_number() OVER (PARTITION BY coalesce(repo, '') ORDER BY doc_id) AS rn FROM documents),
r AS (SELECT repo, doc_id, rn, CAST(0 AS BIGINT) AS batch, n AS used FROM n WHERE rn = 1
  UNION ALL SELECT n.repo, n.doc_id, n.rn, r.batch + CASE WHEN r.used + n.n > 15000 THEN 1 ELSE 0 END, CASE WHEN r.used + n.n > 15000 THEN n.n ELSE r.used + n.n END FROM r JOIN n ON n.repo = r.repo AND n.rn = r.rn + 1)
SELECT repo, doc_id, batch FROM r
""")
def packed_batches(spark, d):
    """Documents of each repository in order, a new batch where 15,000 characters would be passed."""
    docs = table(spark, d, "documents").select(F.coalesce("repo", F.lit("")).alias("repo"), "doc_id", "n_chars")
    return ordering.pack_greedily(docs, ["repo"], ["doc_id"], "n_chars", 15_000).select("repo", "doc_id", "batch")


# Scores --------------------------------------------------------------------------------------------------------

_VECTORS = [
    "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N",
    "CVSS:3.0/AV:N/AC:L/PR:L/UI:N/S:U/C:H/I:N/A:N", "CVSS:3.1/AV:P/AC:H/PR:H/UI:R/S:U/C:N/I:N/A:N", "CVSS:3.1/AV:A/AC:H/PR:L/UI:R/S:C/C:L/I:H/A:L",
    "CVSS:2.0/AV:N/AC:L/Au:N/C:P/I:P/A:P", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:X/C:H/I:H/A:H", "CVSS:3.1/AV:N/AC:L", "", "CVSS:3.1/AV:L/AC:L/PR:H/UI:N/S:C/C:L/I:N/A:H",
]


def _cvss_sql() -> str:
    pick = "[" + ", ".join(f"'{v}'" for v in _VECTORS) + "]"
    m = lambda k: f"regexp_extract(v, '^.*/{k}:([^/]*)', 1)"
    w = lambda k, t: "CASE " + m(k) + " " + " ".join(f"WHEN '{a}' THEN {b}::DOUBLE" for a, b in t.items()) + " END"
    metrics = ", ".join(f"{w(k, t)} AS w_{k}" for k, t in cvss.WEIGHTS.items())
    return f"""
x AS (SELECT p_partkey, {pick}[p_partkey % {len(_VECTORS)} + 1] AS v FROM part),
y AS (SELECT p_partkey, v, {metrics}, {m('S')} AS s, CASE {m('S')} WHEN 'C' THEN {w('PR', cvss.PRIVILEGES['C'])} WHEN 'U' THEN {w('PR', cvss.PRIVILEGES['U'])} END AS pr FROM x),
z AS (SELECT *, 1 - (1 - w_C) * (1 - w_I) * (1 - w_A) AS sub, 8.22::DOUBLE * w_AV * w_AC * pr * w_UI AS reach FROM y),
i AS (SELECT *, CASE s WHEN 'C' THEN 7.52::DOUBLE * (sub - 0.029::DOUBLE) - 3.25::DOUBLE * pow(sub - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * sub END AS impact FROM z),
scores AS (SELECT p_partkey AS id, CASE WHEN starts_with(v, 'CVSS:3.') AND reach IS NOT NULL AND sub IS NOT NULL AND s IN ('U', 'C') THEN CASE WHEN sub <= 0 THEN 0.0::DOUBLE
  ELSE least(floor(least(CASE s WHEN 'C' THEN 1.08::DOUBLE * (impact + reach) ELSE impact + reach END, 10.0::DOUBLE) * 10 + 0.999999::DOUBLE) / 10, 10.0::DOUBLE) END END AS score FROM i),
labelled AS (SELECT id, score, CASE WHEN score IS NULL THEN 'Not assessed' WHEN score >= 9 THEN 'Critical' WHEN score >= 7 THEN 'High' WHEN score >= 4 THEN 'Medium' WHEN score > 0 THEN 'Low' ELSE 'None' END AS severity FROM scores)"""


def scored_parts(spark: SparkSession, d: str) -> DataFrame:
    vector = F.element_at(F.array(*map(F.lit, _VECTORS)), (F.col("p_partkey") % len(_VECTORS) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", vector.alias("vector"))


@query(f"WITH {_cvss_sql()} SELECT row_number() OVER (ORDER BY score DESC NULLS LAST, id) AS place, id, score, severity FROM labelled")
def severity_ranking(spark, d):
    """Scores from vectors, the severest first."""
    return stats.severity_ranking(scored_parts(spark, d), "p_partkey", "vector", Scratch(spark)).select("place", "id", "score", "severity")


@query(f"WITH {_cvss_sql()} SELECT severity, count(*) AS n, count_if(coalesce(score < 7.0, false)) AS held FROM labelled GROUP BY severity")
def severity_gate(spark, d):
    """How many scores of each severity a threshold of 7 holds back."""
    s = cvss.base_score("vector")
    return scored_parts(spark, d).select(cvss.severity(s).alias("severity"), cvss.below_gate(F.col("vector"), 7.0).alias("held")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.count_if("held").alias("held"))


# Search --------------------------------------------------------------------------------------------------------


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM l WHERE regexp_matches(line, '\\b(?:status=500)\\b')
""")
def search_lines(spark, d):
    """Every line that a whole word occurs in."""
    return search.matching_lines(table(spark, d, "documents"), ["doc_id"], "text", search.pattern("status=500", whole_word=True))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM l WHERE regexp_matches(line, '\\b(?:status=500)\\b') ORDER BY doc_id, line_no LIMIT 20
""")
def search_report(spark, d):
    """The first 20 of those lines, as a report shows them."""
    return search_lines(spark, d).orderBy("doc_id", "line_no").limit(20)


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM l WHERE line_no BETWEEN 3 AND 5
""")
def line_ranges(spark, d):
    """Lines three to five of every document."""
    return search.line_range(table(spark, d, "documents"), ["doc_id"], "text", 3, 5)


KEYWORDS = ["password", "token", "session", "scheduler", "nosuchword", "CWE-79"]


@query(" UNION ALL ".join(f"SELECT '{k}' AS keyword, count_if(contains(lower(text), '{k.lower()}')) AS documents FROM documents" for k in KEYWORDS))
def keyword_scan(spark, d):
    """In how many documents each keyword stands."""
    return search.keyword_counts(table(spark, d, "documents"), "text", KEYWORDS)


@query("SELECT doc_id, name, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|\\n)\\s*def\\s+([A-Za-z_]\\w*)', 1)) AS name FROM documents) GROUP BY ALL")
def symbols(spark, d):
    """Functions that documents define."""
    t = table(spark, d, "documents")
    names = t.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|\n)\s*def\s+([A-Za-z_]\w*)"), 1)).alias("name"))
    return names.groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"))


_ADDRESSES = r"https?://[A-Za-z0-9.:@-]+(?:/[A-Za-z0-9._/-]*)?"


@query(f"""
WITH a AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_ADDRESSES}')) AS address FROM documents),
p AS (SELECT *, rtrim(address, '/') AS t FROM a), q AS (SELECT *, regexp_extract(t, '^https?://([^/?#]*)', 1) AS authority, regexp_extract(t, '^(https?)://', 1) AS scheme FROM p)
SELECT doc_id, address, CASE WHEN contains(authority, '@') OR regexp_extract(authority, '^([^:]*)(?::(\\d*))?$', 1) = '' THEN NULL ELSE scheme || '://' || lower(regexp_extract(authority, '^([^:]*)(?::(\\d*))?$', 1)) || ':' ||
  CASE WHEN regexp_extract(authority, '^([^:]*)(?::(\\d*))?$', 2) <> '' THEN regexp_extract(authority, '^([^:]*)(?::(\\d*))?$', 2) WHEN scheme = 'https' THEN '443' ELSE '80' END END AS origin FROM q
""")
def origins(spark, d):
    """Addresses that documents name, with their origins."""
    a = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_ADDRESSES), 0)).alias("address")).distinct()
    return a.select("doc_id", "address", paths.origin(F.col("address")).alias("origin"))


ROUTES = ["/", "/{area}/{item}", "/zexigi", "/novapun/:id", "/rivipo/*", "/<section>/lekafor"]


@query(r"""
WITH p AS (SELECT DISTINCT unnest(regexp_extract_all(description, '(/[a-z]+/[a-z]+)[ .,]', 1)) AS path FROM findings), r AS (SELECT *, string_split(path, '/') AS s FROM p)
SELECT '/{area}/{item}' AS route, path FROM r UNION ALL SELECT '/zexigi', path FROM r WHERE s[2] = 'zexigi' UNION ALL SELECT '/novapun/:id', path FROM r WHERE s[2] = 'novapun' UNION ALL SELECT '/rivipo/*', path FROM r WHERE s[2] = 'rivipo' UNION ALL SELECT '/<section>/lekafor', path FROM r WHERE s[3] = 'lekafor'
""")
def served_requests(spark, d):
    """Which of a system's routes serve the paths that findings name."""
    p = _findings(spark, d).select(F.explode(F.regexp_extract_all("description", F.lit(r"(/[a-z]+/[a-z]+)(?=[ .,])"), 1)).alias("path")).distinct()
    return search.match_requests(p, spark.createDataFrame([(r,) for r in ROUTES], "route string"))


# Vectors -------------------------------------------------------------------------------------------------------


@query("""
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine, list_cosine_similarity(a.e, b.e) AS c FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, neighbour_id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 12) DESC, neighbour_id) AS place FROM s QUALIFY place <= 5
""")
def nearest_vectors(spark, d):
    """The five nearest vectors of every hundredth one, against all."""
    e = table(spark, d, "embeddings")
    return linkage.nearest(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 5, Scratch(spark)).withColumn("cosine", F.round("cosine", 6))


@query("""
WITH RECURSIVE n AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
r AS (SELECT label, rn, vec_id, vec_id AS seed, [{'i': vec_id, 'e': e}] AS seeds FROM n WHERE rn = 1
  UNION ALL SELECT label, rn, vec_id, CASE WHEN best >= 0.3 THEN seeds[list_position(sims, best)].i ELSE vec_id END, CASE WHEN best >= 0.3 THEN seeds ELSE list_append(seeds, {'i': vec_id, 'e': e}) END
  FROM (SELECT *, list_max(sims) AS best FROM (SELECT n.*, r.seeds, list_transform(r.seeds, lambda s: round(list_cosine_similarity(s.e, n.e), 12)) AS sims FROM r JOIN n ON n.label = r.label AND n.rn = r.rn + 1)))
SELECT label AS grp, vec_id AS row_id, seed FROM r
""")
def vector_clusters(spark, d):
    """Greedy clusters of the vectors of each label."""
    return linkage.greedy_clusters(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.3)


# Events --------------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    """Events per hour and type."""
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k
""")
def event_sessions(spark, d):
    """Runs of a user's events at most ten minutes apart."""
    e = table(spark, d, "events")
    s = e.groupBy("user_id", F.session_window("ts", "10 minutes").alias("s")).agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("n"))
    return s.select("user_id", "started", "n")


# Groups, histories and code ------------------------------------------------------------------------------------



@query(f"""
WITH {_F}, c AS (SELECT finding_id, coalesce(cwe_id, '') AS cwe, {_ONE("coalesce(vulnerable_component, '')")} AS comp FROM f),
k AS (SELECT finding_id, CASE WHEN comp <> '' AND (len(string_split(comp, ' ')) >= 3 OR regexp_matches(comp, '[^\\w$\\s]')) THEN cwe || chr(31) || comp END AS key FROM c)
SELECT finding_id, md5(key) AS check_key, coalesce(key IS NOT NULL AND count(*) OVER (PARTITION BY key) BETWEEN 2 AND 6, false) AS together FROM k
""")
def shared_checks(spark, d):
    """Findings that one check can settle together."""
    return groups.shared_checks(_findings(spark, d)).select("finding_id", F.md5("check_key").alias("check_key"), "together")


def _proposed(spark, d):
    m = table(spark, d, "clusters").select("proposal_id", F.explode("member_vuln_ids").alias("m"))
    return m.where(filled("m")).select("proposal_id", F.lower(trimmed("m")).alias("member")).distinct()


@query(f"""
WITH {_F}, m AS (SELECT DISTINCT proposal_id, lower(trim(m, {_WS})) AS v FROM (SELECT proposal_id, unnest(member_vuln_ids) AS m FROM clusters) WHERE length(trim(coalesce(m, ''), {_WS})) > 0),
x AS (SELECT proposal_id, finding_id, upper(trim(cwe_id, {_WS})) IN ({_SYSTEMIC}) AS systemic, len(affected_nodes) AS n FROM m JOIN f ON lower(trim(vuln_id, {_WS})) = v)
SELECT proposal_id, finding_id AS head, count(*) OVER (PARTITION BY proposal_id) AS size FROM x
QUALIFY row_number() OVER (PARTITION BY proposal_id ORDER BY coalesce(systemic, false) DESC, coalesce(n, 0) DESC, finding_id) = 1
""")
def proposal_heads(spark, d):
    """The finding that speaks for each proposal, and how many it names."""
    f = _findings(spark, d).select(F.lower(trimmed("vuln_id")).alias("member"), "finding_id", F.upper(trimmed("cwe_id")).isin(text.SYSTEMIC_CWES).alias("systemic"), F.size("affected_nodes").alias("n"))
    return groups.group_heads(_proposed(spark, d).join(f, "member"), "proposal_id", "finding_id", "systemic", "n")


@query(f"""
WITH {_F}, m AS (SELECT DISTINCT proposal_id, lower(trim(m, {_WS})) AS v FROM (SELECT proposal_id, unnest(member_vuln_ids) AS m FROM clusters) WHERE length(trim(coalesce(m, ''), {_WS})) > 0),
g AS (SELECT DISTINCT lower(trim(vuln_id, {_WS})) AS v, upper(trim(cwe_id, {_WS})) AS group_id FROM f WHERE cwe_id IS NOT NULL),
o AS (SELECT group_id, proposal_id, count(*) AS overlap FROM m JOIN g USING (v) GROUP BY ALL)
SELECT group_id, proposal_id, overlap FROM o QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY overlap DESC, proposal_id) = 1
""")
def best_reasons(spark, d):
    """The proposal that covers most findings of each class."""
    g = _findings(spark, d).where("cwe_id IS NOT NULL").select(F.lower(trimmed("vuln_id")).alias("member"), F.upper(trimmed("cwe_id")).alias("group_id")).distinct()
    return groups.best_reasons(_proposed(spark, d), g)


@query(f"""
WITH {_F} SELECT finding_id, md5(trim(concat_ws(' ', nullif(vulnerability_type, ''), nullif(cwe_id, ''), nullif(lower(CASE WHEN trim(coalesce(vulnerable_component, ''), {_WS}) <> ''
  THEN trim(vulnerable_component, {_WS}) || '. ' || trim(coalesce(description, ''), {_WS}) ELSE trim(coalesce(description, ''), {_WS}) END), '')), {_WS})) AS text_key,
  coalesce(length(trim(coalesce(description, ''), {_WS})) > 0 AND len(string_split(trim(description, {_WS}), chr(10))) <= 20 AND len(list_filter(string_split(trim(description, {_WS}), chr(10)), lambda x: length(x) > 90)) = 0
  AND NOT contains(description, '```'), false) AS inline FROM f
""")
def embedding_keys(spark, d):
    """The digest of what is embedded of each finding, and whether its text fits in a line or few."""
    t = text.embedding_text(*[F.col(c) for c in ("vulnerability_type", "cwe_id", "vulnerable_component", "description")])
    return _findings(spark, d).select("finding_id", F.md5(t).alias("text_key"), text.fits_inline("description").alias("inline"))


def _turns(spark, d):
    kind = F.when(F.col("emitted_by").isin("explorer", "reviewer"), "ai").when(F.col("emitted_by") == "validator", "tool").when(F.col("emitted_by") == "verifier", "human").otherwise("other")
    return _updates(spark, d).select("key", "update_id", kind.alias("kind"), F.length(F.coalesce("description", F.lit(""))).alias("size"))


_TURNS = f"""t AS (SELECT key, update_id, CASE WHEN emitted_by IN ('explorer', 'reviewer') THEN 'ai' WHEN emitted_by = 'validator' THEN 'tool' WHEN emitted_by = 'verifier' THEN 'human' ELSE 'other' END AS kind, length(coalesce(description, '')) AS size FROM u)"""


@query(f"""
WITH {_U}, {_TURNS}, e AS (SELECT *, CAST(floor(size / 2 * 1.15::DOUBLE) AS BIGINT) + 8 AS own, sum(size) OVER (PARTITION BY key) AS alls, count(*) OVER (PARTITION BY key) AS n FROM t),
g AS (SELECT *, coalesce(sum(size) OVER w, 0) AS gone, count(*) OVER w AS k FROM e WINDOW w AS (PARTITION BY key ORDER BY own DESC, update_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT key, update_id, CAST(floor((alls - gone) / 2 * 1.15::DOUBLE) AS BIGINT) + 8 * (n - k) < 400 AS kept FROM g
""")
def fitting_updates(spark, d):
    """Which updates of each vuln_id stay if all are to fit in 400 tokens."""
    return histories.keep_fitting(_turns(spark, d), "key", "update_id", "size", 400).select("key", "update_id", "kept")


@query(f"""
WITH {_U}, {_TURNS}, a AS (SELECT *, row_number() OVER w AS n, lag(kind) OVER w AS prev, max(CASE WHEN kind <> 'tool' THEN update_id END) OVER (PARTITION BY key ORDER BY update_id ROWS UNBOUNDED PRECEDING) AS anchor FROM t WINDOW w AS (PARTITION BY key ORDER BY update_id)),
b AS (SELECT a.*, o.kind AS anchor_kind, (a.n = 1 AND a.kind = 'human') AS head FROM a LEFT JOIN t o ON o.update_id = a.anchor),
c AS (SELECT *, CAST(sum(CASE WHEN kind = 'tool' AND coalesce(anchor_kind, '') = 'ai' THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY update_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS unit,
  row_number() OVER (PARTITION BY key, kind = 'ai' ORDER BY update_id DESC) AS back FROM b),
d AS (SELECT *, update_id >= min(CASE WHEN kind = 'ai' AND back <= 2 THEN update_id END) OVER (PARTITION BY key) AS in_tail FROM c),
e AS (SELECT *, max(CASE WHEN in_tail AND kind IN ('ai', 'tool') AND size > 450 THEN unit END) OVER (PARTITION BY key) AS big FROM d)
SELECT key, update_id, unit, CASE WHEN head THEN 'head' WHEN in_tail AND (big IS NULL OR unit > big) THEN 'tail' ELSE 'middle' END AS part FROM e
""")
def history_parts(spark, d):
    """Head, middle and tail of the updates of each vuln_id, read as a conversation."""
    return histories.split_history(_turns(spark, d), "key", "update_id", "kind", "size", 2, 450).select("key", "update_id", "unit", "part")


@query(f"WITH {_U} SELECT key, CAST(floor(sum(length(coalesce(description, ''))) / 2 * 1.15::DOUBLE) AS BIGINT) + 8 * count(*) AS tokens FROM u GROUP BY key")
def token_estimates(spark, d):
    """A cautious estimate of the tokens of each vuln_id's updates."""
    n = F.sum(F.length(F.coalesce("description", F.lit(""))))
    return _updates(spark, d).groupBy("key").agg(histories.token_estimate(n, F.count(F.lit(1))).alias("tokens"))


@query(r"""
WITH b AS (SELECT doc_id, regexp_extract_all(text, '(?s)```[^\n]*\n(.*?)(?:```|\z)', 1) AS bs FROM documents WHERE contains(text, '```'))
SELECT doc_id, CAST(p AS INTEGER) AS block_no, md5(code) AS code FROM (SELECT doc_id, unnest(bs) AS code, generate_subscripts(bs, 1) AS p FROM b)
""")
def code_blocks(spark, d):
    """Fenced blocks of documents, by digest."""
    return code.code_blocks(table(spark, d, "documents"), ["doc_id"], "text").withColumn("code", F.md5("code"))


@query()
def code_features(spark, d):
    """What Python's parser finds in those blocks."""
    return code.python_features(code.code_blocks(table(spark, d, "documents"), ["doc_id"], "text"), ["doc_id", "block_no"], "code").select("doc_id", "block_no", "parsed", "imports", F.size("symbols").alias("symbols"), "calls", "branches", "inert")


_TAGS = (
    "html|head|body|title|meta|link|base|style|script|noscript|template|slot|main|section|article|aside|header|footer|nav|address|search|hgroup|h[1-6]|p|div|span|a|img|picture|source|video|audio|track|canvas|svg|math|map|area|iframe|embed|object|param|"
    "br|hr|wbr|pre|code|kbd|samp|var|blockquote|q|cite|em|strong|small|b|i|s|u|sub|sup|mark|del|ins|abbr|dfn|bdi|bdo|data|time|ruby|rt|rp|ul|ol|li|menu|dl|dt|dd|figure|figcaption|details|summary|dialog|"
    "table|caption|colgroup|col|thead|tbody|tfoot|tr|th|td|form|fieldset|legend|label|input|button|select|optgroup|option|datalist|textarea|output|progress|meter|center|font|frame|frameset"
)
#: An opening tag of HTML, case aside, or its document type.
_MARKED = rf"(?i)<(?:!doctype\s+html\b|(?:{_TAGS})(?:[\s/][^<>]*)?>)"


@query()
def marked_up(spark, d):
    """The visible text and links of documents in HTML."""
    h = table(spark, d, "documents").where(F.col("text").rlike(_MARKED))
    return code.html_parts(h, ["doc_id"], "text").select("doc_id", F.length("text").alias("characters"), F.size("links").alias("links"), "forms")


_LINES = "l AS (SELECT doc_id, repo, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL)"


@query(f"""
WITH {_LINES}, h AS (SELECT coalesce(repo, '') AS repo, row_number() OVER (ORDER BY doc_id, line_no) AS rn FROM l WHERE regexp_matches(line, '\\b(?:status=500)\\b'))
SELECT repo, count(*) AS more FROM h WHERE rn > 20 GROUP BY repo
""")
def search_overflow(spark, d):
    """Where the matches lie that a report of 20 leaves out."""
    docs = table(spark, d, "documents").withColumn("repo", F.coalesce("repo", F.lit("")))
    hits = search.matching_lines(docs, ["doc_id", "repo"], "text", search.pattern("status=500", whole_word=True)).select("doc_id", "line_no", "repo")
    return ordering.with_row_numbers(hits, [], ["doc_id", "line_no"], Scratch(spark)).where("rn > 20").groupBy("repo").agg(F.count(F.lit(1)).alias("more"))


@query()
def hypothesis_clusters(spark, d):
    """Every finding with the one that stands for it: the first of its identity, and of those of its kind and class the one
    that vectors and anchors say is the same, with hashed vectors in place of a model's. Findings of a CVE stand alone."""
    scratch = Scratch(spark)
    key = linkage.exact_key() | {"cwe": text.cwe_key("cwe_id")}
    f = table(spark, d, "findings").withColumns({"v": F.coalesce("vuln_id", F.lit("")), "alone": F.coalesce(F.col("source_cve"), F.lit("")) != "", **key})
    f = f.withColumn("same", F.md5(F.to_json(F.struct(F.when(F.col("alone"), F.col("finding_id")).alias("id"), *key))))
    h = linkage.identity_heads(f, "same", ["v", "finding_id"], "finding_id", "description", ["alone", "kind", "cwe", "nodes", "v", "vulnerability_type", "cwe_id", "vulnerable_component"])
    t = text.embedding_text(*[F.col(c) for c in ("vulnerability_type", "cwe_id", "vulnerable_component", "description")])
    head = F.col("finding_id") == F.col("first_id")
    r = h.select("finding_id", "first_id", "alone", "kind", "cwe", "nodes", "v", text.component_tokens("vulnerable_component").alias("tokens"), text.degenerate_anchor("vulnerable_component").alias("degenerate"), F.when(head & ~F.col("alone"), t).alias("t"))
    kept = scratch.keep(linkage.made_vectors(r, "t", linkage.hashed_vectors()))
    c = scratch.keep(linkage.gated_clusters(kept.where(head & ~F.col("alone")), ["kind", "cwe"], "finding_id", ["nodes", "v", "finding_id"]))
    later = kept.where(~head).select("finding_id", F.col("first_id").alias("row_id")).join(c, "row_id").select("finding_id", "seed")
    return c.withColumnRenamed("row_id", "finding_id").unionByName(later).unionByName(kept.where("alone").select("finding_id", F.col("finding_id").alias("seed")))


@query(f"""
WITH {_U} SELECT key, arg_min(update_id, (coalesce(emitted_by, '') <> 'verifier', update_id)) AS update_id, bool_or(coalesce(emitted_by, '') = 'verifier') AS preferred FROM u GROUP BY key
""")
def preferred_updates(spark, d):
    """The first update of a preferred agent for each vuln_id, else the first of all."""
    other = F.coalesce("emitted_by", F.lit("")) != "verifier"
    g = _updates(spark, d).groupBy("key").agg(F.min(F.struct(other.alias("o"), "update_id")).alias("f"))
    return g.select("key", "f.update_id", (~F.col("f.o")).alias("preferred"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events QUALIFY place <= 60")
def recent_events(spark, d):
    """The last 60 events of each user."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return table(spark, d, "events").withColumn("place", F.row_number().over(w)).where("place <= 60").select("user_id", "event_id", "place")

# The reducer in full, and what stands beside it ---------------------------------------------------------------------


_LIVES = f"""
WITH RECURSIVE {_U}, n AS (SELECT key, update_id, coalesce(nullif(lower(trim(status, {_WS})), ''), 'hypothesis') AS s, {_RANK} AS rank, description, affected_nodes, row_number() OVER (PARTITION BY key ORDER BY updated_at NULLS FIRST, update_id) AS rn,
  CASE update_id % 7 WHEN 0 THEN 'CVE-1' WHEN 1 THEN 'CVE-2' END AS cve, CASE update_id % 11 WHEN 0 THEN 'applied' WHEN 1 THEN 'reviewed' WHEN 2 THEN 'verified' WHEN 3 THEN 'failed' WHEN 4 THEN 'rejected' END AS patch, update_id % 13 = 0 AS reset FROM u),
r AS (SELECT key, rn, s, rank, description, affected_nodes AS nodes, update_id AS seed, cve, patch FROM n WHERE rn = 1
  UNION ALL SELECT key, rn, CASE WHEN take OR reset THEN new_s ELSE s END, CASE WHEN take OR reset THEN new_rank ELSE rank END,
    CASE WHEN take OR reset THEN new_text WHEN same AND NOT coalesce(cve <> new_cve, false) AND coalesce(new_text, '') <> '' AND NOT contains(coalesce(description, ''), new_text) THEN coalesce(description, '') || chr(10) || chr(10) || 'Additional context: ' || new_text ELSE description END,
    CASE WHEN reset THEN new_nodes WHEN take THEN {_UNION("new_nodes", "nodes")} WHEN same THEN {_UNION("nodes", "new_nodes")} ELSE nodes END, CASE WHEN take OR reset THEN new_id ELSE seed END, CASE WHEN take OR reset THEN new_cve ELSE cve END, CASE WHEN take OR reset THEN new_patch ELSE patch END
  FROM (SELECT n.key, n.rn, r.s, r.rank, r.description, r.nodes, r.seed, r.cve, r.patch, n.s AS new_s, n.rank AS new_rank, n.description AS new_text, n.affected_nodes AS new_nodes, n.update_id AS new_id, n.cve AS new_cve, n.patch AS new_patch, n.reset,
      (r.s = 'insufficient_context' AND n.s IN ({_ANSWERS})) OR coalesce(n.patch IN ('applied', 'failed', 'verified', 'rejected'), false) OR coalesce(r.patch = 'applied' AND n.patch = 'reviewed', false) OR n.rank > r.rank AS take, n.rank = r.rank AS same FROM r JOIN n ON n.key = r.key AND n.rn = r.rn + 1))
SELECT key, s AS status, description, nodes AS affected_nodes, seed AS seed_id, cve AS source_cve, patch AS patch_state, rn AS records FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY rn DESC) = 1
"""


@query(_LIVES)
def merged_lives(spark, d):
    """The same with CVEs, patch states and resets, which are made up of the updates' ids."""
    m = F.col("update_id")
    pick = lambda k, *names: F.get(F.array(*[F.lit(n) for n in names]), (m % k).cast("int"))
    u = merge_input(_updates(spark, d).withColumns({"cve": pick(7, "CVE-1", "CVE-2"), "patch": pick(11, "applied", "reviewed", "verified", "failed", "rejected"), "reset": m % 13 == 0}))
    return merge.merge_records(u)


@query(f"""
WITH {_F}, {_U}, m AS (SELECT DISTINCT proposal_id, lower(trim(m, {_WS})) AS v FROM (SELECT proposal_id, unnest(member_vuln_ids) AS m FROM clusters) WHERE length(trim(coalesce(m, ''), {_WS})) > 0),
o AS (SELECT key, bool_and(lower(trim(status, {_WS})) = 'exploitable') AS confirmed, count(*) AS n FROM u GROUP BY key)
SELECT proposal_id, v AS member, n IS NOT DISTINCT FROM 1 AS answered, CASE WHEN n = 1 THEN confirmed END AS confirmed FROM m LEFT JOIN o ON o.key = v
""")
def own_verdicts(spark, d):
    """Members of proposals with the one update that speaks of them; those of none or several stay open."""
    m = _proposed(spark, d).select(F.col("proposal_id").alias("grp"), F.col("member").alias("row_id"))
    results = _updates(spark, d).select(F.col("key").alias("row_id"), (F.lower(trimmed("status")) == "exploitable").alias("confirmed"))
    answered, left = groups.own_verdicts(results, m)
    out = answered.select("grp", "row_id", F.lit(True).alias("answered"), "confirmed").unionByName(left.select("grp", "row_id", F.lit(False).alias("answered"), F.lit(None).cast("boolean").alias("confirmed")))
    return out.withColumnsRenamed({"grp": "proposal_id", "row_id": "member"})


_ADVISORIES = f"""a AS (SELECT finding_id AS seq, CASE finding_id % 3 WHEN 0 THEN source_cve WHEN 1 THEN source_cve ELSE 'X-' || source_cve END AS id, coalesce(vulnerable_component, 'unknown') AS package, CASE WHEN finding_id % 3 = 0 THEN finding_id || '.0' END AS fixed_version,
  CASE finding_id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' END AS severity_label, CASE finding_id % 5 WHEN 0 THEN 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H' WHEN 1 THEN 'CVSS:3.1/AV:P/AC:H/PR:H/UI:R/S:U/C:L/I:N/A:N' END AS cvss_vector, CASE WHEN finding_id % 2 = 0 THEN [cwe_id] END AS cwe_ids
  FROM f WHERE source_cve LIKE 'CVE-20%' AND coalesce(description, '') <> '')"""


@query(f"""
WITH {_F}, {_ADVISORIES}, k AS (SELECT *, CASE WHEN seq % 3 = 2 THEN coalesce(nullif(regexp_extract(id, 'CVE-20[0-9][0-9]-[0-9]+'), ''), id) ELSE id END AS cid FROM a),
g AS (SELECT cid AS id, arg_min(package, seq) AS package, arg_min(fixed_version, seq) FILTER (fixed_version IS NOT NULL) AS fixed_version, arg_min(severity_label, seq) FILTER (severity_label IS NOT NULL) AS severity_label,
  arg_min(cvss_vector, seq) FILTER (cvss_vector IS NOT NULL) AS cvss_vector, arg_min(cwe_ids, seq) FILTER (cwe_ids IS NOT NULL) AS cwe_ids, count(*) AS advisories FROM k GROUP BY cid)
SELECT *, CASE WHEN severity_label IS NOT NULL THEN severity_label = 'HIGH' ELSE coalesce(contains(cvss_vector, 'AV:N'), false) END AS high FROM g
""")
def advisories(spark, d):
    """One record per CVE of advisories made up of the findings that name one, and whether it is a severe one."""
    i = F.col("finding_id")
    f = _findings(spark, d).where("source_cve LIKE 'CVE-20%'")
    fixed = F.struct(F.array(F.struct(F.array(F.struct(F.lit(None).cast("string").alias("fixed")), F.struct(F.when(i % 3 == 0, F.concat(i.cast("string"), F.lit(".0"))).alias("fixed"))).alias("events"))).alias("ranges"), F.struct(F.col("vulnerable_component").alias("name")).alias("package"))
    vector = F.when(i % 5 == 0, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H").when(i % 5 == 1, "CVSS:3.1/AV:P/AC:H/PR:H/UI:R/S:U/C:L/I:N/A:N")
    none = F.lit(None).cast("array<string>")
    a = F.struct(
        F.when(i % 3 == 2, F.concat(F.lit("X-"), "source_cve")).otherwise(F.concat(F.lit("GHSA-"), i.cast("string"))).alias("id"), F.when(i % 3 == 0, F.array(F.lit("PYSEC-1"), "source_cve")).otherwise(none).alias("aliases"), F.when(i % 3 == 1, F.array("source_cve")).otherwise(none).alias("upstream"),
        F.col("description").alias("details"), F.array(fixed).alias("affected"), F.array(F.struct(F.lit("CVSS_V2").alias("type"), F.lit("v2").alias("score")), F.struct(F.lit("cvss_v3").alias("type"), vector.alias("score"))).alias("severity"),
        F.struct(F.when(i % 2 == 0, F.array("cwe_id")).otherwise(F.array().cast("array<string>")).alias("cwe_ids"), F.when(i % 4 == 0, " high ").when(i % 4 == 1, "low").alias("severity")).alias("database_specific"),
    )
    r = advisory_records(f.select(i.alias("seq"), a.alias("advisory")), ["seq"])
    return r.withColumn("high", cvss.high_severity(F.col("severity_label"), F.col("cvss_vector")))


@query(f"""
WITH {_F}, x AS (SELECT finding_id, vuln_id, coalesce(description, '') AS t, coalesce(affected_nodes, []) AS n, created_at FROM f),
y AS (SELECT *, trim(regexp_replace(lower(coalesce(vuln_id, '')), '[^a-z0-9]+', '-', 'g'), '-') AS s, list_filter(list_transform(string_split('1. ' || replace(t, '. ', chr(10) || '2)  '), chr(10)), lambda v: trim(v, {_WS})), lambda v: v <> '') AS ls FROM x)
SELECT finding_id, rtrim(left(s, 60), '-') AS slug, list_transform(ls, lambda v: regexp_replace(v, '^\\s*\\d+[.)]\\s+', '')) AS steps, list_filter(n, lambda v, i: v IS NOT NULL AND trim(v, {_WS}) <> '' AND list_position(list_transform(n, lambda w: trim(w, {_WS})), trim(v, {_WS})) = i) AS nodes,
  epoch_us(created_at) AS micros FROM y
""")
def text_forms(spark, d):
    """Names as slugs, texts as steps, lists of different entries, and times with nanoseconds as microseconds."""
    f = _findings(spark, d)
    steps = text.step_lines(F.concat(F.lit("1. "), F.replace(F.coalesce("description", F.lit("")), F.lit(". "), F.lit("\n2)  "))))
    at = F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789Z"))
    return f.select("finding_id", text.slug("vuln_id").alias("slug"), steps.alias("steps"), text.cwe_list("affected_nodes").alias("nodes"), text.epoch_micros(at).alias("micros"))


@query("""
WITH p AS (SELECT id, source_file, list_filter(string_split(coalesce(source_file, ''), '/'), lambda x: x <> '') AS c FROM nodes)
SELECT id, CASE WHEN len(c) > 1 THEN array_to_string(c[:-2], '/') ELSE '_root' END AS folder, coalesce(source_file <> '' AND (list_contains(string_split(source_file, '/'), 'core') OR source_file LIKE 'web/views/%' OR source_file LIKE '%.php' OR source_file LIKE 'app/%/r%.rb'), false) AS excluded,
  CASE WHEN source_file <> '' THEN CASE WHEN length(id) % 3 = 0 THEN NULL ELSE '/' || source_file END END AS path FROM p
""")
def path_forms(spark, d):
    """Folders, paths of requests, and what a scan's own patterns leave out."""
    f = F.col("source_file")
    address = F.when(F.length("id") % 3 == 0, F.concat(F.lit("no address "), f)).when(F.length("id") % 3 == 1, F.concat(F.lit("HTTPS://h.example:8/"), f, F.lit("/?q=/x"))).otherwise(F.concat(F.lit("/"), f, F.lit("//")))
    patterns = ["core", " web/views/", "*.php", "app/*/r*.rb", ""]
    return table(spark, d, "nodes").select("id", paths.directory("source_file").alias("folder"), paths.is_excluded("source_file", patterns, defaults=False).alias("excluded"), F.when(f != "", paths.request_path(address)).alias("path"))


@query(f"""
WITH {_F}, {_U}, p AS (SELECT key, list({{'status': status, 'vuln_id': vuln_id}} ORDER BY vuln_id, CAST(to_json({{'status': status, 'vuln_id': vuln_id}}) AS VARCHAR)) AS peers FROM u GROUP BY key)
SELECT finding_id, md5(CAST(to_json({{'peers': peers, 'report': {{'component': vulnerable_component, 'text': description}}}}) AS VARCHAR)) AS content_key FROM f LEFT JOIN p ON p.key = lower(trim(f.vuln_id, {_WS}))
""")
def content_keys(spark, d):
    """The keys under which verdicts on findings are cached, whatever they were scored at and in which order their updates stand."""
    peers = _updates(spark, d).select("key", F.struct("vuln_id", F.concat(F.lit("CVSS:"), F.col("update_id")).alias("cvss_vector"), "status").alias("p")).groupBy("key").agg(F.collect_list("p").alias("peers"))
    f = _findings(spark, d).withColumn("key", F.lower(trimmed("vuln_id"))).join(peers, "key", "left")
    f = f.withColumn("record", F.struct(F.struct(F.col("description").alias("text"), F.rand().cast("string").alias("cvss_vector"), F.col("vulnerable_component").alias("component")).alias("report"), "peers"))
    return f.select("finding_id", text.content_key(f, "record").alias("content_key"))


@query(f"""
WITH {_F}, c AS (SELECT 'password' AS w UNION ALL SELECT 'token' UNION ALL SELECT 'session' UNION ALL SELECT 'scheduler' UNION ALL SELECT 'nosuchword' UNION ALL SELECT 'cwe-79'),
there AS (SELECT w FROM c WHERE EXISTS (SELECT 1 FROM documents WHERE contains(lower(text), w)))
SELECT finding_id FROM f WHERE CASE finding_id % 5 WHEN 0 THEN true WHEN 1 THEN 'token' IN (SELECT w FROM there) OR 'nosuchword' IN (SELECT w FROM there) WHEN 2 THEN 'nosuchword' IN (SELECT w FROM there) WHEN 3 THEN 'scheduler' IN (SELECT w FROM there) ELSE true END
""")
def keyword_filter(spark, d):
    """Findings that ask for no keyword, or for one that stands in some document."""
    i = F.col("finding_id") % 5
    asked = F.when(i == 1, F.array(F.lit(" Token "), F.lit("nosuchword"))).when(i == 2, F.array(F.lit("nosuchword"))).when(i == 3, F.array(F.lit("SCHEDULER"), F.lit(None).cast("string"))).when(i == 4, F.array(F.lit(" "))).otherwise(F.lit(None).cast("array<string>"))
    counts = search.keyword_counts(table(spark, d, "documents"), "text", KEYWORDS)
    return search.with_found_keywords(_findings(spark, d).select("finding_id", asked.alias("asked")), "asked", counts, F.lit(True)).select("finding_id")


@query(f"""
WITH {_F}, m AS (SELECT DISTINCT proposal_id, lower(trim(m, {_WS})) AS v FROM (SELECT proposal_id, unnest(member_vuln_ids) AS m FROM clusters) WHERE length(trim(coalesce(m, ''), {_WS})) > 0)
SELECT proposal_id, finding_id AS row_id, min(finding_id) OVER (PARTITION BY proposal_id, source_cve) AS group_id FROM m JOIN f ON lower(trim(vuln_id, {_WS})) = v
""")
def split_proposals(spark, d):
    """The findings of each proposal, apart by the CVE they name."""
    f = _findings(spark, d).select(F.lower(trimmed("vuln_id")).alias("member"), "finding_id", "source_cve")
    m = _proposed(spark, d).join(f, "member").select("proposal_id", "finding_id", "source_cve")
    return groups.split_groups(m, "proposal_id", "finding_id", "source_cve")


@query(f"""
WITH {_F}, k AS (SELECT finding_id, CASE WHEN finding_id % 7 > 0 THEN cwe_id END AS cwe, status FROM f)
SELECT finding_id, cwe FROM k WHERE cwe <> '' QUALIFY row_number() OVER (PARTITION BY cwe ORDER BY coalesce(status = 'hypothesis', false) DESC, finding_id) = 1
UNION ALL SELECT finding_id, cwe FROM k WHERE cwe IS NULL OR cwe = ''
""")
def preferred_findings(spark, d):
    """The first finding of each class as it is written, hypotheses before others; those without a class all stay."""
    k = _findings(spark, d).select("finding_id", F.when(F.col("finding_id") % 7 > 0, F.col("cwe_id")).alias("cwe"), "status")
    return groups.preferred(k, "cwe", F.col("status") == "hypothesis", ["finding_id"]).select("finding_id", "cwe")


@query(f"""
WITH {_U}, t AS (SELECT key, update_id, [s, a] AS fp FROM (SELECT key, update_id, coalesce(status, '') AS s, coalesce(vulnerable_component, '') AS a, emitted_by FROM u) WHERE emitted_by IN ('explorer', 'reviewer')),
l AS (SELECT key, list_sort(fp) AS fp, row_number() OVER (PARTITION BY key ORDER BY update_id DESC) AS n FROM t)
SELECT a.key FROM l a JOIN l b ON a.key = b.key AND a.n = 1 AND b.n = 2 WHERE a.fp = b.fp
""")
def repeated_calls(spark, d):
    """Where an agent's last two answers ask for the same, in whatever order."""
    u = _updates(spark, d).withColumn("kind", F.when(F.col("emitted_by").isin("explorer", "reviewer"), "ai").otherwise("tool"))
    call = lambda c: F.struct(F.coalesce(c, F.lit("")).alias("name"), F.lit("{}").alias("args"))
    calls = F.when(F.col("update_id") % 2 == 0, F.array(call("status"), call("vulnerable_component"))).otherwise(F.array(call("vulnerable_component"), call("status")))
    return histories.repeated_calls(u.withColumn("calls", calls), "key", "update_id", "kind", "calls")


@query(f"""
WITH {_F}, c AS (SELECT finding_id, list_sort(list_distinct(list_filter(coalesce(affected_nodes, []), lambda x: x IS NOT NULL))) AS n, list_filter([description, vulnerable_component, vuln_id], lambda x: x IS NOT NULL)[:2] AS t FROM f)
SELECT finding_id, array_to_string(n[:1], ', ') || CASE WHEN len(n) > 1 THEN ' (+' || len(n) - 1 || ' more)' ELSE '' END AS nodes, left(array_to_string(list_transform(t, lambda x: left(x, 60)), chr(10)), 90) AS snippet FROM c
""")
def shown_findings(spark, d):
    """Nodes and texts of findings as a prompt shows them, cut."""
    return _findings(spark, d).select("finding_id", text.shown_list(F.col("affected_nodes"), 1).alias("nodes"), text.clipped(F.array("description", "vulnerable_component", "vuln_id"), 2, 60, 90).alias("snippet"))


@query(f"""
WITH {_F}, {_U}, r AS (SELECT key, arg_max({{'s': status, 'b': emitted_by}}, (coalesce(updated_at, TIMESTAMP '1900-01-01'), update_id)) AS r FROM u GROUP BY key)
SELECT finding_id, r.s AS status, r.b AS emitted_by FROM f JOIN r ON r.key = lower(trim(vuln_id, {_WS}))
""")
def last_reports(spark, d):
    """What the last update says of each finding that has one."""
    f = _findings(spark, d).select("finding_id", F.lower(trimmed("vuln_id")).alias("key"))
    return groups.with_last_report(f, _updates(spark, d), "key", ["updated_at", "update_id"], ["status", "emitted_by"]).select("finding_id", "status", "emitted_by")


_GATE = f"""t AS (SELECT finding_id, list_sort(list_distinct(list_filter(coalesce(affected_nodes, []), lambda x: x IS NOT NULL AND x <> ''))) AS nodes, {_TOKENS} AS tokens, regexp_replace(lower(trim(coalesce(vulnerable_component, ''), {_WS})), '\\s+', ' ', 'g') AS raw FROM f),
g AS (SELECT finding_id, nodes, tokens, raw = '' OR (NOT regexp_matches(raw, '[^\\w$\\s]') AND len(tokens) < 3) AS weak FROM t)"""


@query(f"""
WITH {_F}, {_GATE}, q AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, list_cosine_similarity(a.e, b.e) AS c FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 12) DESC, b.vec_id) <= 5),
p AS (SELECT query_id, neighbour_id, 0.7 + 0.3 * round(c, 6) AS sim, a.nodes = b.nodes AS same, a.weak OR b.weak AS weak, CASE WHEN len(a.tokens) = 0 OR len(b.tokens) = 0 THEN 0.0 ELSE len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))) END AS jaccard
  FROM s JOIN g a ON a.finding_id = query_id JOIN g b ON b.finding_id = neighbour_id)
SELECT query_id, neighbour_id, CASE WHEN same THEN sim >= 0.8 ELSE (sim >= 0.93 AND (weak OR sim >= 0.95 OR jaccard >= 0.4)) OR (sim < 0.93 AND sim >= 0.85 AND NOT weak AND jaccard >= 0.6) END AS mergeable FROM p
""")
def mergeable_pairs(spark, d):
    """Whether the findings that nearest vectors belong to by their number may be merged, were they so alike and a bit more."""
    near = nearest_vectors(spark, d).select("query_id", "neighbour_id", (0.7 + 0.3 * F.col("cosine")).alias("sim"))
    f = _findings(spark, d).select("finding_id", linkage.sorted_nodes("affected_nodes").alias("nodes"), text.component_tokens("vulnerable_component").alias("tokens"), text.degenerate_anchor("vulnerable_component").alias("weak"))
    side = lambda i, x: f.select(F.col("finding_id").alias(i), *[F.col(c).alias(f"{c}_{x}") for c in ("nodes", "tokens", "weak")])
    p = near.join(side("query_id", "a"), "query_id").join(side("neighbour_id", "b"), "neighbour_id")
    gate = linkage.mergeable(F.col("nodes_a") == F.col("nodes_b"), F.col("sim"), text.token_jaccard(F.col("tokens_a"), F.col("tokens_b")), F.col("weak_a") | F.col("weak_b"))
    return p.select("query_id", "neighbour_id", gate.alias("mergeable"))
