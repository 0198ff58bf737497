"""Readers of graphs, advisories, notes and code files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.paths import is_manifest

NODE = "struct<id:string,label:string,source_file:string,source_location:string,file_type:string,community:int>"
LINK = "struct<source:string,target:string,relation:string,source_file:string,source_location:string>"
GRAPH = f"nodes array<{NODE}>, links array<{LINK}>"
ADVISORY = (
    "struct<id:string,aliases:array<string>,upstream:array<string>,details:string,"
    "affected:array<struct<package:struct<name:string>,ranges:array<struct<events:array<struct<fixed:string>>>>>>,"
    "severity:array<struct<type:string,score:string>>,database_specific:struct<cwe_ids:array<string>,severity:string>>"
)
SCAN = f"results array<struct<source:struct<path:string,type:string>,packages:array<struct<package:struct<name:string,version:string>,vulnerabilities:array<{ADVISORY}>>>>>"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of graph files in JSON, one document each. Nodes of dependency manifests are left out, and with
    them the links that touch them; links to nodes that aren't in the file stay. Malformed files have none."""
    g = spark.read.schema(GRAPH).option("multiLine", True).json(path)
    nodes = g.select(F.inline("nodes")).where("id IS NOT NULL")
    dropped = nodes.where(is_manifest("source_file")).select(F.col("id").alias("__id")).distinct()
    links = g.select(F.inline("links")).join(dropped, F.col("source") == F.col("__id"), "left_anti").join(dropped, F.col("target") == F.col("__id"), "left_anti")
    return nodes.where(~is_manifest("source_file")), links


def read_scan(spark: SparkSession, path: str, skip_os: bool = True) -> DataFrame:
    """Advisories of a dependency scan in JSON, one row per package and advisory, with those of the system's own
    packages left out if asked."""
    s = spark.read.schema(SCAN).option("multiLine", True).json(path).select(F.explode("results").alias("r"))
    if skip_os:
        s = s.where(F.coalesce(F.col("r.source.type"), F.lit("")) != "os")
    p = s.select(F.explode("r.packages").alias("p"))
    return p.select(F.col("p.package.name").alias("package"), F.col("p.package.version").alias("version"), F.explode("p.vulnerabilities").alias("advisory"))


def canonical_id(advisory: str) -> Column:
    """The first CVE among aliases, then upstream, then within the id, else the id."""
    of = lambda c: F.get(F.filter(F.coalesce(F.col(f"{advisory}.{c}"), F.array().cast("array<string>")), lambda x: x.startswith("CVE-")), F.lit(0))
    inside = F.regexp_extract(F.col(f"{advisory}.id"), r"CVE-20\d{2}-\d+", 0)
    return F.coalesce(of("aliases"), of("upstream"), F.when(inside != "", inside), F.col(f"{advisory}.id"), F.lit("UNKNOWN"))


def advisory_records(advisories: DataFrame, order: list[str]) -> DataFrame:
    """One row per canonical id: the package of the first advisory in order, and of each other field the first value
    there is. Advisories without details don't count. Texts come from linkage.distinct_descriptions."""
    a = advisories.where(F.coalesce(F.col("advisory.details"), F.lit("")) != "").withColumn("id", canonical_id("advisory"))
    fixed = F.get(F.filter(F.flatten(F.flatten(F.transform("advisory.affected", lambda x: F.transform(x["ranges"], lambda r: F.transform(r["events"], lambda e: e["fixed"]))))), lambda x: x.isNotNull() & (x != "")), F.lit(0))
    label = F.upper(F.trim(F.col("advisory.database_specific.severity")))
    vector = F.get(F.transform(F.filter("advisory.severity", lambda x: F.upper(x["type"]).startswith("CVSS_V3") & x["score"].isNotNull()), lambda x: x["score"]), F.lit(0))
    cwes = F.col("advisory.database_specific.cwe_ids")
    a = a.withColumns({"__at": F.struct(*order), "fixed_version": fixed, "severity_label": F.when(label != "", label), "cvss_vector": vector, "cwe_ids": F.when(F.size(cwes) > 0, cwes)})
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__at"))).alias(c)
    return a.groupBy("id").agg(F.min_by(F.coalesce(F.get(F.col("advisory.affected"), F.lit(0))["package"]["name"], F.lit("unknown")), F.col("__at")).alias("package"), first("fixed_version"), first("severity_label"), first("cvss_vector"), first("cwe_ids"), F.count(F.lit(1)).alias("advisories"))


def read_texts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, size, text) of files below a folder; text is null for what is no UTF-8. Links out of the folder aren't followed
    by the file listing of a distributed file system."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select("path", F.col("length").alias("size"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(type, size, path) of a listing with tabs; lines that begin with '#' are comments."""
    return spark.read.schema("type string, size bigint, path string").option("sep", "\t").option("comment", "#").csv(path)


def capped_listing(files: DataFrame, order: list[str], size: str, most_each: int, most_all: int, most_files: int) -> DataFrame:
    """The files of each image that fit, in order: one over `most_each` is skipped, as is one that would pass
    `most_all` together, so that later smaller ones still fit; at most `most_files`."""
    from auditlake.operators.folds import nothing, ordered_fold

    def step(state, row):
        used, n = state or (0, 0)
        s = row[size] or 0
        if s > most_each or used + s > most_all or n >= most_files:
            return (used, n), ()
        return (used + s, n + 1), [row]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return ordered_fold(files, ["image"], order, step, nothing, schema)


def fresh(rows: DataFrame, at: str, now: Column, hours: float) -> DataFrame:
    """Rows whose age is at least 0 and under the time to live; a null time is never fresh."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    return rows.where((age >= 0) & (age < int(hours * 3600 * 1_000_000)))
