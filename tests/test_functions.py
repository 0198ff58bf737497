import pytest
from pyspark.sql import functions as F

from auditlake.functions import cvss, paths, text


def values(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_scores(rows):
    cases = {
        "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": 9.8, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H": 10.0, "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N": 6.1,
        "CVSS:3.1/AV:N/AC:L/PR:L/UI:N/S:U/C:H/I:N/A:N": 6.5, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N": 0.0, "CVSS:3.0/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": 9.8,
        "": None, "AV:N/AC:L": None, "CVSS:2.0/AV:N/AC:L/Au:N/C:P/I:P/A:P": None, "CVSS:3.1/AV:N/AC:L": None, "CVSS:3.1/AV:X/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": None,
        "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:X/C:H/I:H/A:H": None, None: None, "CVSS:3.1/AV:L/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": 9.8,
    }
    df = rows("v string, e double", *cases.items())
    for r in df.withColumn("s", cvss.base_score("v")).collect():
        assert r.s == r.e, r.v


def test_labels(rows):
    cases = [(None, "Not assessed"), (0.0, "None"), (0.1, "Low"), (3.9, "Low"), (4.0, "Medium"), (6.9, "Medium"), (7.0, "High"), (8.9, "High"), (9.0, "Critical"), (10.0, "Critical")]
    df = rows("s double, e string", *cases)
    assert values(df, cvss.severity(F.col("s"))) == [e for _, e in cases]


@pytest.mark.parametrize("threshold", [None, 0, -1])
def test_gate_off(rows, threshold):
    df = rows("v string", ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N",))
    assert values(df, cvss.below_gate(F.col("v"), threshold)) == [False]


def test_call_targets(rows):
    cases = [
        ("Ledger::post(sum, day)", "Ledger", "post"), ("billing.totals", "billing", "totals"), ("Pool::shared()->borrow", "Pool", "borrow"), ("$conn->fetch", "", "fetch"),
        ("$this->close", "$this", "close"), ("shutdown", "", "shutdown"), ("`k.l.m`()", "k.l", "m"), (".hidden", "", ".hidden"), ("", "", ""), (None, "", ""), ("p->q->r", "p->q", "r"), (" Ledger :: post ", "Ledger", "post"),
    ]
    df = rows("t string, m string, s string", *cases)
    m, s = text.call_target("t")
    for r in df.withColumns({"gm": m, "gs": s}).collect():
        assert (r.gm, r.gs) == (r.m, r.s), r.t


def test_paths(rows):
    cases = {
        "lib/third_party/z.go": True, "venv/bin/run": True, "target": True, "notes/CHANGES.rst": True, "pkg/test_io.rb": True, "ui/form.spec.js": True, "out/report_2031-12-30_235959/k.c": True,
        "out/report_2031-12-30/k.c": False, "lib/io.go": False, "lib/contest_io.go": False, "targets/k.c": False, "": False, None: False,
    }
    df = rows("p string, e boolean", *cases.items())
    for r in df.withColumn("g", paths.is_excluded("p")).collect():
        assert r.g == r.e, r.p
    df = rows("p string", ("gen/a.py",), ("gen2/a.py",), ("a/b/c.js",), ("a/c.js",))
    assert values(df, paths.is_excluded("p", ["gen", "a/b/", "*.ts"], defaults=False)) == [True, False, True, False]
    assert values(df, paths.is_excluded("p", [], defaults=False)) == [False] * 4


def test_origins(rows):
    cases = [("http://h/x", "http://h:80"), ("https://H:443", "https://h:443"), ("https://h", "https://h:443"), ("http://u@h/", None), ("ftp://h", None), ("http:///x", None), ("http://h\n/", None), (None, None), ("http://[::1]:8080/a", "http://[::1]:8080")]
    df = rows("a string, e string", *cases)
    for r in df.withColumn("g", paths.origin(F.col("a"))).collect():
        assert r.g == r.e, r.a


def test_anchors(rows):
    cases = [("$str", True), ("uid", True), ("", True), (None, True), ("  ", True), ("two words", True), ("node_id", True), (".prepare()", False), ("request_params['filter']", False), ("three word phrase", False)]
    df = rows("c string, e boolean", *cases)
    for r in df.withColumn("g", text.degenerate_anchor("c")).collect():
        assert r.g == r.e, r.c


def test_versions(rows):
    cases = [("use 15.0.5 now", "use [VERSION_REDACTED] now"), ("fixed in 2.3.0, so", "so"), ("at 192.168.1.1 it", "at 192.168.1.1 it"), ("a\n  b   c", "a\nb c"), (None, None), ("v1.2 and 19.0.0-rc.1", "[VERSION_REDACTED] and [VERSION_REDACTED]")]
    df = rows("t string, e string", *cases)
    for r in df.withColumn("g", text.without_versions("t")).collect():
        assert r.g == r.e, r.t


def test_file_names(rows):
    import hashlib

    long, wide = "a/" + "x" * 400 + ".json", "é" * 300
    df = rows("n string", ("a/b\\c",), (long,), (wide,), (None,))
    got = values(df, text.file_name("n"))
    assert got[0] == "a_b_c" and got[3] is None
    safe = long.replace("/", "_")
    assert got[1] == safe[: 240 - 5 - 33] + "-" + hashlib.md5(safe.encode()).hexdigest() + ".json"
    assert got[2] == "é" * 103 + "-" + hashlib.md5(wide.encode()).hexdigest() and all(len(x.encode()) <= 240 for x in got[:3])


def test_record_ids(rows):
    kind, dep = "Code Defect", "Known Dependency Vulnerability"
    cases = [
        (["n1"], " cwe-89 ", kind, " A(b) ", None, None, None, "n1:CWE-89:a(b)"), (["n1"], "CWE-327", kind, "Plain `hash`", None, None, None, "systemic:CWE-327:plain_hash"),
        (["n1"], "CWE-327", kind, "one two three four five six seven", None, None, "short", "systemic:CWE-327"), (["p"], "CWE-20", dep, None, None, "CVE-2020-1", None, "p:CWE-20:CVE-2020-1"),
        ([], "x", kind, None, "D1", None, None, "general:OTHER_UNCATEGORIZED:D1"), (None, None, None, None, "unknown_anchor", None, None, "general:OTHER_UNCATEGORIZED:general"),
    ]
    df = rows("nodes array<string>, cwe string, kind string, comp string, dem string, cve string, descr string, e string", *cases).withColumn("cwe", text.cwe_key("cwe"))
    got = df.withColumn("g", text.record_id(*[F.col(c) for c in ("cwe", "kind", "nodes", "comp", "dem", "cve", "descr")])).collect()
    for r in got:
        assert r.g == r.e


def test_canonical(rows):
    peer = "struct<vuln_id:string,cvss_vector:string,rank:int>"
    df = rows(f"id int, r struct<report:struct<z:string,a:string,cvss_vector:string>,peers:array<{peer}>>, peers string", (1, (("x", "y", "v1"), [("b", "v", 1), (None, "w", 2), ("a", None, 3)]), "clash"), (2, (("x", "y", None), [("a", "q", 3), ("b", None, 1), (None, None, 2)]), ""), (3, (("x", "y", None), None), ""), (4, None, ""), (5, (None, [None]), ""))
    got = {r.id: (r.j, r.k) for r in df.select("id", text.canonical_json(df, "r", "cvss_vector", "vuln_id").alias("j"), text.content_key(df, "r").alias("k")).collect()}
    assert got[1] == got[2] and got[1][0] == '{"peers":[{"rank":2,"vuln_id":null},{"rank":3,"vuln_id":"a"},{"rank":1,"vuln_id":"b"}],"report":{"a":"y","z":"x"}}'
    assert got[3][0] == '{"peers":null,"report":{"a":"y","z":"x"}}' and got[4] == (None, None) and got[5][0] == '{"peers":[null],"report":null}' and got[3][1] != got[1][1]


def test_cut_lists(rows):
    df = rows("a array<string>, n string", (["bb", None, "a", "bb", "c"], "bb\na"), ([], ""), (None, ""), ([None], ""))
    assert [r[0] for r in df.select(text.shown_list(F.col("a"), 2)).collect()] == ["a, bb (+1 more)", "", "", ""]
    assert [r[0] for r in df.select(text.clipped(F.col("a"), 2, 2, 9)).collect()] == [r.n for r in df.collect()]
    assert df.select(text.clipped(F.col("a"), 3, 1, 4)).first()[0] == "b\na\n"
