"""Merging, linkage, ordering and search, each against a plain version."""

import random

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.operators import linkage, merge, ordering, search, stats
from auditlake.session import Scratch

UPDATE = "key string, seq int, id bigint, status string, description string, affected_nodes array<string>, source_cve string, patch_state string, force_reset boolean, records string"


def upd(i, status, desc="d", nodes=("n",), cve=None, patch=None, reset=False, key="k", seq=None):
    return (key, i if seq is None else seq, i, status, desc, list(nodes) if nodes is not None else None, cve, patch, reset, "clash")


def one(rows, *u):
    return merge.merge_records(rows(UPDATE, *u)).collect()[0]


def test_ladder(rows):
    for old, new, wins in [("hypothesis", "confirmed", 1), ("confirmed", "hypothesis", 0), ("confirmed", "exploitable", 1), ("exploitable", "false_positive", 1), ("false_positive", "exploitable", 0), ("insufficient_context", "confirmed", 1), ("chained", "confirmed", 0), (None, "review_error", 1), ("bogus", "review_error", 1)]:
        got = one(rows, upd(0, old, "a"), upd(1, new, "b"))
        assert got.description == ("a", "b")[wins], (old, new)


def test_merge_rules(rows):
    got = one(rows, upd(0, "confirmed", "a", ["x", ""]), upd(1, "Confirmed ", "b", ["y", "x"]), upd(2, "confirmed", "a", None), upd(3, "hypothesis", "z", ["w"]))
    assert (got.description, got.affected_nodes, got.records, got.seed_id) == ("a\n\nAdditional context: b", ["x", "y"], 4, 0)
    got = one(rows, upd(0, "confirmed", "a", ["x"], "CVE-1"), upd(1, "confirmed", "b", ["y"], "CVE-2"))
    assert (got.description, got.affected_nodes) == ("a", ["x", "y"])
    got = one(rows, upd(0, "exploitable", "a", ["x"]), upd(1, "confirmed", "b", ["y"], patch="applied"), upd(2, "confirmed", "c", ["z"], patch="reviewed"), upd(3, "hypothesis", "d", [], patch="rejected"))
    assert (got.status, got.description, got.affected_nodes) == ("hypothesis", "d", ["z", "y", "x"])
    got = one(rows, upd(0, "false_positive", "a"), upd(1, "confirmed", "b", ["q"], reset=True))
    assert (got.status, got.description, got.affected_nodes) == ("confirmed", "b", ["q"])
    assert merge.merge_records(rows(UPDATE, upd(0, "confirmed", key=None))).collect() == []
    got = one(rows, upd(0, "confirmed", None, None), upd(1, "confirmed", "t"), upd(1, "confirmed", "t"))
    assert (got.description, got.records) == ("\n\nAdditional context: t", 2)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from([*merge.RANKS, None, " X "]), st.sampled_from(["p", "q", "pq", ""]), st.lists(st.sampled_from("xyz"), max_size=2)), min_size=1, max_size=12), st.randoms())
def test_merge_is_independent_of_arrival(spark, rows, data, rnd):
    u = [upd(i, s, t, n, key=k) for i, (k, s, t, n) in enumerate(data)]
    shuffled = list(u)
    rnd.shuffle(shuffled)
    a, b = (sorted(map(str, merge.merge_records(rows(UPDATE, *x)).collect())) for x in (u, shuffled + shuffled[:3]))
    assert a == b
    kept = merge.surviving_updates(rows(UPDATE, *u), "key", [F.col("seq")], "status", Scratch(spark)).collect()
    top: dict = {}
    for r in u:
        rank = merge.RANKS.get((r[3] or "").strip().lower(), 0)
        was = top.get(r[0])
        assert ((r[2], was is None or rank > was) in [(k.id, k.replaces) for k in kept]) == (was is None or rank >= was)
        top[r[0]] = rank if was is None else max(was, rank)


def test_row_numbers_and_chunks(spark, rows):
    random.seed(3)
    data = [(random.choice(["a", "a", "a", "b", None]), random.randrange(20), i, "clash") for i in range(200)]
    df = rows("g string, v int, id bigint, __part string", *data).drop("__part").repartition(7)
    got = ordering.with_row_numbers(df, ["g"], ["v", "id"], Scratch(spark), total="n").collect()
    for g in ("a", "b", None):
        mine = sorted((r.v, r.id, r.rn) for r in got if r.g == g)
        assert [x[2] for x in mine] == list(range(1, len(mine) + 1)) and {r.n for r in got if r.g == g} == {len(mine)}
    assert ordering.with_row_numbers(df.limit(0), ["g"], ["v"], Scratch(spark)).collect() == []
    c = ordering.balanced_chunks(df, ["g"], ["v", "id"], 25, Scratch(spark)).collect()
    for g in ("a", "b", None):
        mine = sorted((r.v, r.id, r.chunk, r.chunk_size) for r in c if r.g == g)
        n = len(mine)
        per = -(-n // -(-n // 25))
        assert [x[2] for x in mine] == [i // per for i in range(n)]
        assert all(x[3] == sum(y[2] == x[2] for y in mine) for x in mine)


def test_greedy_packing(rows):
    sizes = [5, 5, 1, 20, 3, None, 9, 10]
    df = rows("g string, id bigint, n bigint", *[("a", i, s) for i, s in enumerate(sizes)], ("b", 0, 99))
    got = sorted((r.g, r.id, r.batch) for r in ordering.pack_greedily(df, ["g"], ["id"], "n", 10).collect())
    assert got == [("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("a", 4, 3), ("a", 5, 3), ("a", 6, 4), ("a", 7, 5), ("b", 0, 0)]


def test_contained_texts(rows):
    df = rows("k string, t string, place int", ("c", "Long text, here", 1), ("c", "long TEXT", 1), ("c", "other", 1), ("c", "", 1), ("c", None, 1), ("c", "other", 1), ("c", "xx", 1), ("c", "y", 1), (None, "z", 1))
    got = linkage.distinct_descriptions(df, "k", "t").collect()
    assert sorted((r.place, r.text) for r in got) == [(1, "Long text, here"), (2, "other"), (3, "xx")]


def test_nearest(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5)).astype(np.float32)
    v[7] = v[3]
    v[9] = 0
    df = spark.createDataFrame([(i, x.tolist(), i % 2) for i, x in enumerate(v)] + [(99, None, 0)], "id bigint, e array<float>, place int").repartition(5)
    got = linkage.nearest(df, df.where("id % 10 = 0"), "id", "e", 4, Scratch(spark)).collect()
    u = v.astype(float) / np.maximum(np.linalg.norm(v.astype(float), axis=1, keepdims=True), 1e-300)
    for q in range(0, 60, 10):
        sim = np.round(u @ u[q], 12)
        best = sorted((i for i in range(60) if i != q), key=lambda i: (-sim[i], i))[:4]
        assert [r.neighbour_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.place)] == best
    assert linkage.nearest(df, df.limit(0), "id", "e", 4, Scratch(spark)).collect() == []


def test_greedy_clusters(spark):
    vs = {0: [1.0, 0.0], 1: [0.9, 0.1], 2: [0.0, 1.0], 3: [0.7, 0.7], 4: None, 5: [1.0, 0.05]}
    df = spark.createDataFrame([("g", i, v) for i, v in vs.items()], "g string, id bigint, e array<float>")
    got = {r.row_id: r.seed for r in linkage.greedy_clusters(df, "g", "id", "e", 0.9).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 0}
    p = spark.createDataFrame([(True, 0.8, 0.0, False), (False, 0.94, 0.3, False), (False, 0.94, 0.4, False), (False, 0.94, 0.0, True), (False, 0.9, 0.6, False), (False, 0.9, 0.6, True), (False, 0.96, 0.0, False)], "s boolean, c double, j double, d boolean")
    assert [r[0] for r in p.select(linkage.mergeable(F.col("s"), F.col("c"), F.col("j"), F.col("d"))).collect()] == [True, False, True, True, True, False, True]


def test_search(rows):
    assert search.glob_sides("*.{c,h},!gen_*, q{r,s{t,}}.x , !, {u!,v}{1,2}") == (r".*\.(?:c|h)|q(?:r|s(?:t|))\.x|(?:u!|v)(?:1|2)", "gen_.*")
    assert search.glob_sides("k{m,n") == (r"k\{m|n", "") and search.glob_sides("") == search.glob_sides(" , ") == ("", "")
    p = rows("p string, e boolean", ("d/a.c", True), ("gen_a.c", False), ("a.h", True), ("a.cc", False), ("x/qst.x", False), (None, None))
    assert [r[0] for r in p.select(search.matches_globs(F.col("p"), "*.{c,h},!gen_*")).collect()] == [r.e for r in p.collect()]
    assert [r[0] for r in p.select(search.matches_globs(F.col("p"), None)).collect()] == [True] * 6
    assert search.pattern("k.v") == r"k\.v" and search.pattern("k(|v+| |w\\|x", True) == r"k\(|v+|w\|x" and search.pattern("[", True) == r"\[" and search.pattern("k|v", True, True) == r"\b(?:k|v)\b"
    df = rows("id bigint, t string, line string", (1, "a\r\nfoo(1)\nb", ""), (2, None, ""), (3, "", ""), (4, "nofoo\nfoo(", ""))
    got = search.matching_lines(df, ["id"], "t", search.pattern("foo(")).collect()
    assert sorted((r.id, r.line_no) for r in got) == [(1, 2), (4, 2)]
    assert [(r.line_no, r.line) for r in search.line_range(df.where("id = 1"), ["id"], "t", 0, 2).collect()] == [(1, "a"), (2, "foo(1)")]
    assert search.line_range(df, ["id"], "t", 5, 2).collect() == []
    code = rows("id int, t string", (1, "@app.route('/a/<id>')\nrequests.get(f'http://h/a/1')\nq.delay(1)"))
    assert {(r.kind, r.name) for r in search.declarations(code, ["id"], "t").collect()} == {("route", "/a/<id>"), ("js_route", "/a/<id>"), ("request", "http://h/a/1"), ("delayed", "q")} - {("js_route", "/a/<id>")}


def test_served(rows):
    routes = rows("route string", ("/",), ("/a",), ("/a/b/",), ("/u/{id}",), ("/u/:id/x",), ("/f/*",), ("/<s>/z",), ("/:p/*/w",), (None,))
    paths = ["/", "/a", "/a/b/c?q=1", "/ab", "http://h/u/7", "/u/7/x", "/f/1/2", "/k/z", "/m/n/o/w", "rel", None, "/u/7/"]
    got = {(r.route, r.path) for r in search.match_requests(rows("path string", *[(p,) for p in paths]), routes).collect()}
    assert got == {("/", "/"), ("/a", "/a"), ("/a", "/a/b/c?q=1"), ("/a/b", "/a/b/c?q=1"), ("/u/{id}", "http://h/u/7"), ("/u/:id/x", "/u/7/x"), ("/f/*", "/f/1/2"), ("/<s>/z", "/k/z"), ("/:p/*/w", "/m/n/o/w"), ("/u/{id}", "/u/7/")}


def test_stats(spark, rows):
    u = rows("agent string, calls bigint, input bigint", ("a", 1, 5), ("a", None, None), (None, 2, 7))
    assert {r.agent: (r.calls, r.input) for r in stats.usage_rollup(u, "agent", ["input"]).collect()} == {"a": (2, 5), "unknown": (1, 7), "TOTAL": (3, 12)}
    r = rows("id bigint, v string", (2, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"), (1, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"), (3, None), (4, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H"))
    got = stats.severity_ranking(r, "id", "v", Scratch(spark)).collect()
    assert sorted((x.place, x.id, x.severity) for x in got) == [(1, 4, "Critical"), (2, 1, "Critical"), (3, 2, "Critical"), (4, 3, "Not assessed")]
    own = rows("c int, item string, text string", (1, "i", "Auth auth store"), (2, "j", None))
    near = rows("c int, item string, text string", (1, "i", "role"), (1, "i", "auth"))
    scores = stats.role_scores(own, near, "c", {"access": ["auth", "role"], "storage": ["store"]})
    assert {(x.c, x.role): x.score for x in scores.collect()} == {(1, "access"): 4, (1, "storage"): 2, (2, "access"): 0, (2, "storage"): 0}
    assert {(x.c, x.role) for x in stats.top_roles(scores, "c", 2, "none").collect()} == {(1, "access"), (1, "storage"), (2, "none")}
