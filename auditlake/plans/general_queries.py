"""Queries of the general problems: nested records (3) and keys that hold most rows (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import hotkeys, shredding
from auditlake.session import Scratch, filled, table, trimmed

BRANCHES = {
    "upstream": ["target", "description"],
    "downstream": ["target", "description"],
    "vulns": ["cwe", "component", "description", "pattern_label"],
}


def note_entries(spark: SparkSession, d: str, branches: dict[str, list[str]] = BRANCHES) -> DataFrame:
    """Every list entry of `notes` and of the notes in raw answers: key, branch, pos and the fields of the branches."""
    own = shredding.entries(table(spark, d, "notes"), "note_id", branches)
    parse = shredding.answer_parser("note_id", branches, "description")
    return own.unionByName(shredding.entries(table(spark, d, "note_batches"), "payload", branches, parse))


def _with_content(e: DataFrame) -> DataFrame:
    some = F.lit(False)
    for c in ("target", "cwe", "component", "description", "pattern_label"):
        some = some | filled(c)
    return e.where(some & F.col("key").isNotNull()).select(F.col("key").alias("note_id"), "branch", "pos").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Each object with content, by note, branch and place. Rows sent again add nothing: the place is the identity."""
    return _with_content(note_entries(spark, d))


def p3_stored(spark: SparkSession, d: str) -> DataFrame:
    """The same of the stored notes alone."""
    return _with_content(shredding.entries(table(spark, d, "notes"), "note_id", BRANCHES))


def p3_vulns(spark: SparkSession, d: str) -> DataFrame:
    """The table of the repeated ancestor `vulns` of the stored notes, with the note and the place."""
    e = shredding.entries(table(spark, d, "notes"), "note_id", {"vulns": BRANCHES["vulns"]})
    return e.where(F.col("key").isNotNull()).select(F.col("key").alias("note_id"), "pos", *BRANCHES["vulns"]).distinct()


def _branch(spark: SparkSession, d: str, name: str) -> DataFrame:
    e = note_entries(spark, d, {name: BRANCHES[name]})
    return e.where(F.col("key").isNotNull()).select(F.col("key").alias("note_id"), "pos", *BRANCHES[name]).distinct()


def p3_upstream_entries(spark: SparkSession, d: str) -> DataFrame:
    """The table of `upstream` of stored notes and of those in raw answers, with the note and the place. Where the same
    note stands in several with other values, each has its row."""
    return _branch(spark, d, "upstream")


def p3_downstream_entries(spark: SparkSession, d: str) -> DataFrame:
    """The same of `downstream`."""
    return _branch(spark, d, "downstream")


def p3_vulns_entries(spark: SparkSession, d: str) -> DataFrame:
    """The same of `vulns`: what `p3_vulns` has, and those in raw answers."""
    return _branch(spark, d, "vulns")


def p3_levels(spark: SparkSession, d: str) -> DataFrame:
    """How many slots each leaf path of the three branches has at each repetition and definition level, over stored notes
    and those in raw answers, as often as they were sent."""
    names = list(BRANCHES)
    parse = shredding.answer_parser("note_id", BRANCHES, "description")
    t = shredding.level_table(table(spark, d, "notes"), "note_id", names).unionByName(shredding.level_table(table(spark, d, "note_batches"), "payload", names, parse))
    return t.groupBy("path", "rep", "def").agg(F.count(F.lit(1)).alias("slots"), F.count("value").alias("values"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "links")
    return links.where(filled("target") & F.col("relation").isNotNull())


def _pair_keys() -> dict:
    return {"target": trimmed("target"), "relation": F.lower(trimmed("relation"))}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The three latest links of each target and relation with at least 20 different links."""
    c = hotkeys.compress(_pairs(spark, d), _pair_keys(), {"link_id": F.col("link_id")}, {"observed_at": F.col("observed_at")})
    return hotkeys.latest_per_key(c, ["target", "relation"], "link_id", "observed_at", 3, 20).select("target", "relation", "link_id")


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per target and relation: rows, exact distinct source files, the commonest one, and the median file in name order."""
    c = hotkeys.compress(_pairs(spark, d), _pair_keys(), {"source_file": F.col("source_file")})
    return hotkeys.weighted_profile(c, ["target", "relation"], "source_file", Scratch(spark), (0.5, 0.9))


QUERIES = {f.__name__: f for f in (p3_found, p3_stored, p3_vulns, p3_upstream_entries, p3_downstream_entries, p3_vulns_entries, p3_levels, p4_found, p4_profile)}

_WS = r"' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_PAIRS = f"""
links_ok AS (
  SELECT trim(target, {_WS}) AS target, lower(trim(relation, {_WS})) AS relation, link_id, source_file, observed_at
  FROM links WHERE length(trim(coalesce(target, ''), {_WS})) > 0 AND relation IS NOT NULL)
"""

_FILLED = lambda *cs: " OR ".join(f"length(trim(coalesce(e.{c}, ''), {_WS})) > 0" for c in cs)
SQL = {
    "p3_stored": " UNION ".join(
        f"SELECT note_id, '{b}' AS branch, CAST(p - 1 AS INTEGER) AS pos FROM (SELECT note_id, unnest({b}) AS e, generate_subscripts({b}, 1) AS p FROM notes) WHERE note_id IS NOT NULL AND ({_FILLED(*cs)})" for b, cs in BRANCHES.items()
    ),
    "p3_vulns": """
SELECT DISTINCT note_id, CAST(p - 1 AS INTEGER) AS pos, e.cwe AS cwe, e.component AS component, e.description AS description, e.pattern_label AS pattern_label
FROM (SELECT note_id, unnest(vulns) AS e, generate_subscripts(vulns, 1) AS p FROM notes) WHERE note_id IS NOT NULL
""",
    "p4_found": f"""
WITH {_PAIRS}, one AS (SELECT target, relation, link_id, max(observed_at) AS observed_at FROM links_ok GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY target, relation ORDER BY observed_at DESC NULLS LAST, link_id DESC) AS r,
         count(*) OVER (PARTITION BY target, relation) AS n FROM one)
SELECT target, relation, link_id FROM ranked WHERE r <= 3 AND n >= 20
""",
    "p4_profile": f"""
WITH {_PAIRS}, v AS (SELECT target, relation, source_file, count(*) AS w FROM links_ok GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY target, relation ORDER BY source_file) AS upto, sum(w) OVER (PARTITION BY target, relation) AS alln
      FROM v WHERE source_file IS NOT NULL),
s AS (SELECT target, relation, count(*) AS n_distinct, min(CASE WHEN upto >= ceil(alln * 0.5) THEN source_file END) AS p50,
             min(CASE WHEN upto >= ceil(alln * 0.9) THEN source_file END) AS p90 FROM r GROUP BY ALL),
m AS (SELECT target, relation, source_file AS mode, w AS mode_rows FROM r
      QUALIFY row_number() OVER (PARTITION BY target, relation ORDER BY w DESC, source_file) = 1),
t AS (SELECT target, relation, sum(w) AS n_rows FROM v GROUP BY ALL)
SELECT t.target, t.relation, CAST(n_rows AS BIGINT) AS n_rows, coalesce(n_distinct, 0) AS n_distinct, mode, mode_rows, p50, p90
FROM t LEFT JOIN s USING (target, relation) LEFT JOIN m USING (target, relation)
""",
}
