"""Edges over queues, requests and proxies; repaired calls; nested spans; vectors."""

import random

from pyspark.sql import functions as F

from auditlake.functions import paths
from auditlake.operators import boundaries, linkage


def test_queues_and_requests(rows):
    sent = rows("node string, name string", ("a", "job"), ("a", "job"), ("b", "job"), ("c", ""), ("c", None))
    handled = rows("node string, name string", ("b", "job"), ("d", "job"), ("e", ""))
    assert {tuple(r) for r in boundaries.queue_edges(sent, handled).collect()} == {("a", "b", "event/task 'job'"), ("a", "d", "event/task 'job'"), ("b", "d", "event/task 'job'")}
    q = rows("node string, path string", ("x", "http://h/u/7?z"), ("x", "/none"), ("r", "/u/7"))
    routes = rows("node string, route string", ("r", "/u/{id}"), ("s", "/u/"))
    assert {(r.source, r.target) for r in boundaries.request_edges(q, routes).collect()} == {("x", "r"), ("x", "s"), ("r", "s")}


def test_proxies(rows):
    text = """location /api/ { proxy_pass http://app:8080/v1; }
    location ~ { return 404; } location /s { root /srv; }
    <Location "/old"> ProxyPass /new http://b/ </Location>"""
    d = boundaries.proxy_directives(rows("name string, text string", ("etc/n x.conf", text), ("none", None)))
    assert {(r.prefix, r.upstream) for r in d.collect()} == {("/api/", "/v1"), ("~", None), ("/s", "/s"), ("/old", "/new")}
    e = boundaries.proxy_edges(d, rows("node string, route string", ("a", "/v1"), ("b", "/new/:x"), ("c", "/s"), ("d", "/api")))
    assert {(r.source, r.target) for r in e.collect()} == {("infra:etc_n_x.conf#/api/", "a"), ("infra:etc_n_x.conf#/api/", "d"), ("infra:etc_n_x.conf#/s", "c")}


def test_repaired_calls(rows):
    m = rows("container string, name string, member string", ("C", "run", "C.run"), ("C", "go", "C.go"), ("D", "run", "D.run"))
    c = rows("link_id bigint, source string, container string, label string, line string", (1, "a", "C", "Klass", "x = Klass::run(1) + $this->go($b)"), (2, "a", "C", "Klass", "klass.run()"), (3, "b", "C", "Klass", "other->run()"), (4, "c", "C", "Klass", None), (5, "d", "C", "Klass", "parent::GO()"))
    got = {(r.source, r.target, r.link_id, r.repaired_from) for r in boundaries.repair_calls(c, m).collect()}
    assert got == {("a", "C.run", 1, "C"), ("a", "C.go", 1, "C"), ("d", "C.go", 5, "C")}


def test_nested_spans(rows):
    spans = [("f", "A", 1, 100), ("f", "B", 10, 20), ("f", "C", 12, 15), ("f", "D", 30, 30), ("f", "E", 90, 120), ("f", "G", 200, 201), ("g", "A", 5, 6), ("f", "bad", 9, 8)]
    random.shuffle(spans)
    got = {(r.file, r.node): r.own for r in boundaries.own_lines(rows("file string, node string, first int, last int", *spans)).collect()}
    assert got == {("f", "A"): 100 - 11 - 1 - 11, ("f", "B"): 7, ("f", "C"): 4, ("f", "D"): 1, ("f", "E"): 11, ("f", "G"): 2, ("g", "A"): 2}


def test_vectors_and_gate(spark, rows):
    asked = spark.sparkContext.accumulator(0)

    def provider(texts):
        asked.add(len(texts))
        return [None if t == "bad" else [float(len(t)), 1.0] for t in texts]

    t = rows("id int, t string, vector0 string", (1, "aa", ""), (2, "aa", ""), (3, "bad", ""), (4, None, ""), (5, "known", ""))
    key = t.where("id = 5").select(F.sha2(F.lit("m:known"), 256)).first()[0]
    cache = rows("text_key string, vector array<float>", (key, [9.0, 9.0]))
    got = {r.id: r.vector for r in linkage.with_vectors(t, "t", cache, "m", provider, 2).collect()}
    assert got == {1: [2.0, 1.0], 2: [2.0, 1.0], 3: None, 4: None, 5: [9.0, 9.0]} and asked.value == 2
    assert {r.id: r.vector is None for r in linkage.with_vectors(t, "t", None, "m", linkage.hashed_vectors(8), 8).collect()} == {1: False, 2: False, 3: False, 4: True, 5: False}
    up = lambda c: [c, (1 - c * c) ** 0.5]
    r = rows("g string, id bigint, nodes string, tokens array<string>, degenerate boolean, vector array<double>",
        ("g", 1, "n", ["a", "b", "c"], False, up(1.0)), ("g", 2, "n", ["z"], True, up(0.81)), ("g", 3, "m", ["a", "b", "c"], False, up(0.9)), ("g", 4, "m", ["z", "y", "x"], False, up(0.94)), ("g", 5, "m", ["q"], True, up(0.96)), ("g", 6, "n", None, True, None), ("h", 7, "n", ["a"], True, up(1.0)))
    got = {x.row_id: x.seed for x in linkage.gated_clusters(r, ["g"], "id").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}
    many = rows("g string, id bigint, nodes string, tokens array<string>, degenerate boolean, vector array<double>", *[("g", i, f"n{i}", ["a"], False, [1.0, 0.0]) for i in range(30)])
    assert sorted({x.seed for x in linkage.gated_clusters(many, ["g"], "id").collect()}) == [0, 26]


def test_artifacts(rows):
    cases = [("etc/nginx/nginx.conf", True), ("a/node_modules/package.json", False), ("app/PACKAGE.JSON", True), (".env.local", True), ("x.env", False), ("a/start.sh", True), (None, False)]
    df = rows("p string, e boolean", *cases)
    assert [r[0] for r in df.select(paths.is_artifact("p")).collect()] == [e for _, e in cases]
    more = [("app/x.cfg", 10, True), ("app/x.py", 10, False), ("app/static/x.cfg", 10, False), ("other/x.cfg", 10, False), ("/app/x", 0, False), ("app/x", 300_000, False), ("app/a.nft.json", 5, False)]
    df = rows("p string, n bigint, e boolean", *more)
    assert [r[0] for r in df.select(paths.is_other_config(F.col("p"), F.col("n"), "/app/")).collect()] == [e for *_, e in more]
    assert [r[0] for r in df.select(paths.is_other_config(F.col("p"), F.col("n"), "/")).collect()] == [False] * len(more)
    assert [r[0] for r in rows("p string", ("src/api/x.py",), ("x/app.ts",), ("apis/x.py",), (None,)).select(paths.is_entry_file("p")).collect()] == [True, True, False, False]


def test_declarations_find_their_nodes(rows):
    n = rows("id string, label string, source_file string, node string", ("1", "Klass::Go", "a/x.py", ""), ("2", "go", "a/x.py", ""), ("3", "x.py", "a/x.py", ""), ("4", "go()", "a/y.py", ""), ("5", None, "a/y.py", ""), ("6", "go", None, ""))
    d = rows("file string, function string, kind string", ("a/x.py", "GO", "r"), ("a/x.py", "none", "r"), ("a/x.py", None, "r"), ("a/y.py", "go", "r"), ("a/z.py", "go", "r"), (None, "go", "r"))
    assert {(r.file, r.function): r.node for r in boundaries.anchored(d, n).collect()} == {("a/x.py", "GO"): "1", ("a/x.py", "none"): "3", ("a/x.py", None): "3", ("a/y.py", "go"): "4", ("a/z.py", "go"): None, (None, "go"): None}
    e = rows("source string, target string, match_key string, label string", ("1", "2", "k", ""), ("1", "2", "k", ""), ("infra:a", "5", "p", ""))
    got = {tuple(r) for r in boundaries.boundary_edges({"q": e}, n).select("boundary_type", "source", "target", "source_label", "target_label", "target_file").collect()}
    assert got == {("q", "1", "2", "Klass::Go", "go", "a/x.py"), ("q", "infra:a", "5", None, "", "a/y.py")}


def test_configs_and_builds(rows):
    f = rows("path string, text string, name string", ("etc/nginx.conf", "x" * 200_001, ""), ("etc/nginx-a.conf", "b", ""), ("etc/nginx.conf.bak", "c", ""), ("a.vhost", "", ""), ("b.vhost", None, ""), (".htaccess", "d", ""), (None, "e", ""))
    assert {r.name: len(r.text) for r in boundaries.proxy_files(f).collect()} == {"etc/nginx.conf": 200_000, "etc/nginx-a.conf": 1, ".htaccess": 1}
    b = rows("app string, path string, kind string", ("a", "a/compose.yml", ""), ("a", "a/b/docker-compose.yaml", ""), ("a", "a/Dockerfile", ""), ("b", "b/vendor/compose.yml", ""), ("b", "b/Dockerfile.dev", ""), ("b", "b/x.dockerfile", ""), ("b", "b/Dockerfile.dev", ""), ("c", "c/Dockerfiles", ""), (None, "Dockerfile", ""), (None, None, ""))
    assert sorted(map(str, map(tuple, boundaries.build_files(b, "app").collect()))) == sorted(map(str, [("a", "compose", "a/b/docker-compose.yaml"), ("b", "dockerfile", "b/Dockerfile.dev"), ("b", "dockerfile", "b/x.dockerfile"), (None, "dockerfile", "Dockerfile")]))


def test_known_calls_stay(rows):
    m = rows("container string, name string, member string", ("C", "run", "C.run"), ("C", "go", "C.go"))
    c = rows("link_id bigint, source string, container string, label string, line string", (1, "a", "C", "K", "K::run(1) + K.go()"))
    known = rows("source string, target string", ("a", "C.run"), ("a", "C.run"))
    assert [(r.source, r.target) for r in boundaries.repair_calls(c, m, known).collect()] == [("a", "C.go")]
