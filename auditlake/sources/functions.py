"""Table functions for SQL, in SQL, so that they are planned with the query that calls them."""

from __future__ import annotations

from pyspark.sql import SparkSession

_LINES = r"posexplode(split(replace(replace(lines_of.body, '\r\n', '\n'), '\r', '\n'), '\n', -1)) AS t(place, line)"
FUNCTIONS = {
    "lines_of(body STRING, first_line INT, last_line INT) RETURNS TABLE (line_no INT, line STRING)": f"""
SELECT place + 1, line FROM {_LINES}
WHERE place + 1 BETWEEN greatest(1, lines_of.first_line) AND least(lines_of.last_line, greatest(1, lines_of.first_line) + 499)""",
    "steps_of(body STRING) RETURNS TABLE (step INT, step_text STRING)": r"""
SELECT place + 1, regexp_replace(line, '^\\s*\\d+[.)]\\s+', '')
FROM posexplode(filter(transform(split(steps_of.body, '\n'), x -> trim(BOTH ' \t\r' FROM x)), x -> x <> '')) AS t(place, line)""",
    "connections_of(node STRING) RETURNS TABLE (other STRING, relation STRING, direction STRING)": """
SELECT source, relation, 'in' FROM graph_links WHERE target = connections_of.node
UNION ALL SELECT target, relation, 'out' FROM graph_links WHERE source = connections_of.node AND target <> connections_of.node""",
    "callers_of(node STRING) RETURNS TABLE (caller STRING, calls BIGINT)": """
SELECT source, count(*) FROM graph_links WHERE target = callers_of.node AND relation = 'calls' GROUP BY source""",
    "texts_with(expression STRING) RETURNS TABLE (path STRING, line_no INT, line STRING)": r"""
SELECT path, place + 1, line FROM graph_texts, LATERAL posexplode(split(replace(replace(body, '\r\n', '\n'), '\r', '\n'), '\n', -1)) AS t(place, line)
WHERE body RLIKE texts_with.expression AND line RLIKE texts_with.expression""",
}


def register(spark: SparkSession) -> None:
    """Makes lines_of(text, first, last), of 500 lines at most, and steps_of(text) known to SQL; and, where there are views
    graph_links(source, target, relation) and graph_texts(path, body), connections_of(node), callers_of(node) and
    texts_with(expression) over them."""
    views = {t.name for t in spark.catalog.listTables()}
    for signature, body in FUNCTIONS.items():
        if all(v in views for v in ("graph_links", "graph_texts") if v in body):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
