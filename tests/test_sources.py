import json

from pyspark.sql import functions as F

from auditlake.operators import linkage
from auditlake.sources import functions, graphs, sinks


def test_graph_files(spark, tmp_path):
    g = {"nodes": [{"id": "a", "source_file": "x/a.py", "extra": 1}, {"id": "m", "source_file": "x/package.json"}, {"id": None}], "links": [{"source": "a", "target": "m"}, {"source": "a", "target": "gone", "relation": "calls"}]}
    (tmp_path / "g.json").write_text(json.dumps(g, indent=1))
    (tmp_path / "bad.json").write_text("{")
    nodes, links = graphs.read_graph(spark, str(tmp_path))
    assert [r.id for r in nodes.collect()] == ["a"] and [(r.source, r.target) for r in links.collect()] == [("a", "gone")]


def test_advisories(spark, tmp_path):
    adv = lambda i, **k: {"id": i, **k}
    scan = {"results": [
        {"source": {"type": "lockfile"}, "packages": [{"package": {"name": "p", "version": "1"}, "vulnerabilities": [
            adv("GHSA-1", aliases=["X", "CVE-2020-1"], details="short", affected=[{"package": {"name": "first"}}]),
            adv("GHSA-2", upstream=["CVE-2020-1"], details="a longer SHORT text", affected=[{"package": {"name": "second"}, "ranges": [{"events": [{"fixed": None}, {"fixed": "2.0"}]}]}], database_specific={"severity": " high ", "cwe_ids": ["CWE-1"]}, severity=[{"type": "CVSS_V2", "score": "v2"}, {"type": "cvss_v3", "score": "v3"}]),
            adv("DSA-CVE-2021-7-x", details="d"), adv("Z", details=""), adv("Z2")]}]},
        {"source": {"type": "os"}, "packages": [{"package": {"name": "os"}, "vulnerabilities": [adv("OS", details="d")]}]},
    ]}
    (tmp_path / "s.json").write_text(json.dumps(scan))
    a = graphs.read_scan(spark, str(tmp_path / "s.json"))
    got = {r.id: r for r in graphs.advisory_records(a.withColumn("seq", F.col("advisory.id")), ["seq"]).collect()}
    assert set(got) == {"CVE-2020-1", "CVE-2021-7"}
    r = got["CVE-2020-1"]
    assert (r.package, r.fixed_version, r.severity_label, r.cvss_vector, r.cwe_ids, r.advisories) == ("first", "2.0", "HIGH", "v3", ["CWE-1"], 2)
    d = linkage.distinct_descriptions(a.select(graphs.canonical_id("advisory").alias("k"), F.col("advisory.details").alias("t")), "k", "t").where("key = 'CVE-2020-1'")
    assert [x.text for x in d.collect()] == ["a longer SHORT text"]
    assert graphs.read_scan(spark, str(tmp_path / "s.json"), skip_os=False).count() == a.count() + 1


def test_texts_and_index(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.py").write_text("é")
    (tmp_path / "d/b.py").write_bytes(b"\xff\xfe")
    (tmp_path / "d/c.txt").write_text("no")
    assert {(r.path.rsplit("/", 1)[1], r.text) for r in graphs.read_texts(spark, str(tmp_path / "d"), "*.py").collect()} == {("a.py", "é"), ("b.py", None)}
    (tmp_path / "i.tsv").write_text("# type\tsize\tpath\nf\t3\t/a b\n")
    assert [tuple(r) for r in graphs.read_index(spark, str(tmp_path / "i.tsv")).collect()] == [("f", 3, "/a b")]


def test_capped_listing_and_age(rows):
    f = rows("image string, path string, n bigint", *[("i", p, n) for p, n in (("a", 4), ("b", 50), ("c", 7), ("d", 5), ("e", 1), ("f", None), ("g", 1))], ("j", "z", 1))
    got = {(r.image, r.path) for r in graphs.capped_listing(f, ["path"], "n", 10, 10, 4).collect()}
    assert got == {("i", "a"), ("i", "d"), ("i", "e"), ("i", "f"), ("j", "z")}
    t = rows("id int, at string", (1, "2024-01-01 00:00:00"), (2, "2024-01-07 23:59:59"), (3, "2024-01-09 00:00:00"), (4, None)).withColumn("at", F.col("at").cast("timestamp"))
    assert [r.id for r in graphs.fresh(t, "at", F.lit("2024-01-08 00:00:00").cast("timestamp"), 168).collect()] == [2]


def test_ledger(spark, rows, tmp_path):
    p, schema = str(tmp_path / "ledger"), "agent string, calls bigint, input_tokens bigint, output_tokens bigint"
    sinks.append_usage(rows(schema, ("a", None, 5, None), ("a", 9, 0, None)), p)
    sinks.append_usage(rows(schema, ("a", 2, 1, 1)), p)
    assert [tuple(r) for r in sinks.read_usage(spark, p).collect()] == [("a", 3, 6, 1)]
    sinks.write_report(sinks.read_usage(spark, p), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1


def test_table_functions(spark):
    functions.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM lines_of('a\\nb\\nc', 2, 9)").collect()] == [(2, "b"), (3, "c")]
    assert [tuple(r) for r in spark.sql("SELECT * FROM steps_of('1. go\\n\\n 2) stop')").collect()] == [(1, "go"), (2, "stop")]
    assert spark.sql("SELECT * FROM lines_of(CAST(NULL AS STRING), 1, 2)").collect() == []
    spark.createDataFrame([("a", "b", "calls"), ("b", "b", "calls"), ("b", "c", "uses"), (None, "b", None)], "source string, target string, relation string").createOrReplaceTempView("graph_links")
    spark.createDataFrame([("f", "x\r\nrun(1)\nz"), ("g", None)], "path string, body string").createOrReplaceTempView("graph_texts")
    functions.register(spark)
    assert sorted(map(str, spark.sql("SELECT * FROM connections_of('b')").toPandas().itertuples(index=False, name=None))) == ["('a', 'calls', 'in')", "('b', 'calls', 'in')", "('c', 'uses', 'out')", "(None, None, 'in')"]
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM callers_of('b')").collect()) == [("a", 1), ("b", 1)]
    assert [tuple(r) for r in spark.sql("SELECT * FROM texts_with('run')").collect()] == [("f", 2, "run(1)")]


def test_scratch_root(spark, monkeypatch):
    import pytest

    from auditlake import session

    class Fake:
        def __init__(self, master, root=None):
            self.sparkContext, self.conf = self, self
            self.master, self.root, self.applicationId = master, root, "fake"

        def get(self, _key, default):
            return self.root or default

    assert session.scratch_root(Fake("spark://h:7077", "file:///shared")) == "file:///shared"
    for master in ("spark://h:7077", "yarn", "local-cluster[3,2,3000]", "k8s://h"):
        with pytest.raises(ValueError):
            session.scratch_root(Fake(master))
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert session.scratch_root(spark) == session.scratch_root(spark) and spark.conf.get("spark.checkpoint.dir", None) == before
