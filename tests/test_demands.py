"""Demands: every stage of a resolution and every miss, every branch to the callers, and what comes after."""

import pytest
from pyspark.sql import functions as F

from auditlake.operators import demands, graph
from auditlake.session import Scratch

NODE = "id string, label string, source_file string, name string, home string"
LINK = "link_id bigint, source string, target string, relation string, found string"
ASKED = "note_id bigint, node_id string, direction string, pos int, target string, description string, module string, symbol string"


@pytest.fixture
def world(spark, rows):
    """Base <- Middle <- Leaf, a class beside them, functions, and names that several nodes have."""
    nodes = rows(NODE, *[(*n, "clash", "clash") for n in [
        ("base", "Base", "lib/k/base.py"), ("base_run", ".run()", "lib/k/base.py"), ("mid", "Middle", "lib/k/mid.py"), ("leaf", "Leaf", "app/leaf.py"), ("leaf.go", ".go()", "app/leaf.py"), ("leaf.stop", ".stop()", "app/leaf.py"),
        ("side", "Side", "app/side.py"), ("side.go", ".go()", "app/side.py"), ("ring", "Ring", "app/circle.py"), ("f.lone", "lone()", "app/fun.py"), ("f.lonely", "lonely()", "app/fun.py"), ("t1", "twice()", "a.py"), ("t2", "twice()", "b.py"), ("m1", ".mixed()", "a.py"), ("m2", "mixed()", "b.py"),
        ("nofile", "hidden()", None), ("empty", "", "c.py"), ("null", None, "c.py"),
    ]])
    pairs = [("leaf", "leaf.go", "method"), ("leaf", "leaf.stop", "method"), ("leaf", "f.lone", "method"), ("side", "side.go", "method"), ("gone", "side.go", "method"), ("mid", "base", "inherits"), ("leaf", "mid", "extends"), ("side", "ring", "implements"), ("ring", "side", "mixes_in"), ("leaf", "gone", "inherits")]
    calls = [("c1", "leaf.go", "calls"), ("c1", "leaf.go", "calls"), ("c2", "leaf.go", "calls"), ("c3", "leaf", "calls"), ("c4", "leaf.stop", "calls"), ("c3", "side", "calls"), ("c5", "f.lone", "calls")]
    links = rows(LINK, *[(i, *x, "clash") for i, x in enumerate(pairs + calls)])
    return nodes, links, demands.Resolver(nodes, links, Scratch(spark))


def ask(rows, *data, direction="downstream"):
    d = rows("note_id bigint, node_id string, target string", *[(i, *x) for i, x in enumerate(data)])
    module, symbol = demands.call_target("target")
    return d.select("note_id", "node_id", F.lit(direction).alias("direction"), F.lit(0).alias("pos"), "target", F.lit("d").alias("description"), module.alias("module"), symbol.alias("symbol"))


CASES = [
    ("leaf.go", "$this->stop()", "scope", "leaf.stop", None), ("leaf.go", "self::run(1)", "scope", "base_run", None), ("leaf", "static::go", "scope", "leaf.go", None), ("leaf.go", "parent::go()", None, None, "global-ambiguous"), ("mid", "parent::run", "scope", "base_run", None),
    ("f.lone", "this->lone()", "name", "f.lone", None), ("x", "fun.lone()", "file", "f.lone", None), ("x", "fun.lon()", "part", "f.lone", None), ("x", "App/Fun::LONELY", "file", "f.lonely", None), ("x", "fun.zz", None, None, "class-absent"),
    ("x", "Middle::run(a, b)", "inherited", "base_run", None), ("x", "Leaf::run", "inherited", "base_run", None), ("x", "Ring::go", "inherited", "side.go", None), ("leaf.go", "Middle::stop", "caller", "leaf.stop", None), ("x", "Middle::stop", None, None, "method-absent"), ("x", "Gone::go", None, None, "class-absent"),
    ("x", "lone()", "name", "f.lone", None), ("x", "twice", None, None, "global-ambiguous"), ("x", "mixed()", "function", "m2", None), ("x", "hidden", None, None, "global-none"), ("x", "$db->lone()", "name", "f.lone", None), ("x", "global::lone/other", "name", "f.lone", None),
    ("x", "()", None, None, "no-symbol"), ("x", " ", None, None, "no-symbol"), (None, "lone", "name", "f.lone", None), ("x", "g", None, None, "global-none"),
]


def test_stages(rows, world):
    _, _, r = world
    got = {x.note_id: (x.stage, x.resolved, x.miss) for x in r.resolve(ask(rows, *[(n, t) for n, t, *_ in CASES], *[("x", None)])).collect()}
    assert [(CASES[i][1], *got[i]) for i in range(len(CASES))] == [(t, s, f, m) for _, t, s, f, m in CASES]
    assert got[len(CASES)] == (None, None, "no-symbol") and len(got) == len(CASES) + 1
    assert r.resolve(ask(rows, ("x", "lone")).limit(0)).collect() == []


def test_empty_graph(spark, rows, world):
    nodes, links, _ = world
    r = demands.Resolver(nodes.limit(0), links.limit(0), Scratch(spark))
    assert [(x.stage, x.miss) for x in r.resolve(ask(rows, ("x", "A::b"), ("x", "b"))).orderBy("note_id").collect()] == [(None, "class-absent"), (None, "global-none")]


def test_notes_to_demands(rows, world):
    _, _, r = world
    entry = "array<struct<target:string,description:string>>"
    notes = rows(f"note_id bigint, node_id string, upstream {entry}, downstream {entry}", (1, "leaf.go", None, [("Leaf::stop(1)", "D"), ("$this->stop", " d "), (None, "x"), (" ", "x"), None, ("self::go", "own")]), (1, "leaf.go", None, [("Leaf::stop(1)", "D")]), (2, "side", None, [("fun.lone", "e")]), (3, None, None, [("lone", "f")]))
    down = demands.distinct_demands(demands.route_downstream(r.resolve(demands.note_demands(notes))), upstream=False)
    assert {tuple(x) for x in down.select("target_node", "source", "description", "merged").collect()} == {("leaf.stop", "leaf.go", " d ", 2), ("f.lone", "side", "e", 1)}


def test_call_shapes(rows):
    cases = [
        ("$id", "", ""), ("Till::open(1)", "Till", "open"), ("Till::open", "Till", "open"), ("Till::$now", "Till", ""), ("till.shut(a.b)", "till", "shut"), ("a.b.c(1)", "a.b", "c"), ("shut (x)", "", "shut"), ("$a->shut(x)", "", "shut"),
        ("`shut(x)`", "", "shut"), ("a.b", "", ""), ("(x)", "", ""), (None, "", ""), ("", "", ""), ("f(a::b)", "", "f"),
    ]
    m, s = demands.call_shape("t")
    for r in rows("t string, m string, s string", *cases).withColumns({"gm": m, "gs": s}).collect():
        assert (r.gm, r.gs) == (r.m, r.s), r.t


def test_invoked(rows):
    code = rows("node_id string, text string, called string", ("a", "x = run (1); $no(2); obj.go(3); k\\\\nope(4); run(5); 9lives()", ""), ("b", None, ""), ("c", "", ""))
    assert sorted((r.node_id, r.called) for r in demands.invoked_names(code).collect()) == [("a", "go"), ("a", "run")]


def test_upstream(rows, world):
    nodes, links, r = world
    asked = [
        ("leaf.go", "$id"), ("leaf.go", "go(1)"), ("leaf.go", "self::stop()"), ("leaf.go", "run(1)"), ("leaf.go", "other(1)"), ("base_run", "$x"), ("leaf", "$amount"), ("leaf", "$none"), ("leaf", "$prop"), ("leaf", "stop(2)"), ("side", "$y"),
        ("leaf", "$both"), ("leaf", "$uncalled"),
    ]
    d = ask(rows, *asked, direction="upstream")
    look = "node_id string, name string, note_id string"
    params = rows(look, ("leaf.go", "Amount", ""), ("leaf.go", "amount", ""), ("leaf.stop", None, ""), ("leaf.go", "both", ""), ("leaf.stop", "both", ""))
    props = rows(look, ("leaf", "PROP", ""))
    invoked = rows("node_id string, called string", ("c1", "other"), ("c1", "other"), ("c9", "other"), ("c2", "run"))
    routed, missed = demands.route_upstream(d, nodes, r, graph.callers(links), invoked, params, props)
    got = {}
    for x in routed.collect():
        got.setdefault(asked[x.note_id][1], set()).add((x.branch, x.target_node))
    assert got == {
        "$id": {("bare", "c1"), ("bare", "c2")}, "self::stop()": {("resolved", "c4")}, "run(1)": {("invokes", "c2")}, "other(1)": {("invokes", "c1")}, "$amount": {("member", "c1"), ("member", "c2")},
        "$prop": {("bare", "c3")}, "stop(2)": {("member", "c4")}, "$y": {("bare", "c3")}, "$both": {("member", "c1"), ("member", "c2"), ("member", "c4")},
    }
    assert {asked[x.note_id][1]: x.miss for x in missed.collect()} == {"$none": "no-parameter", "$x": "no-caller", "go(1)": "not-invoked", "$uncalled": "no-parameter"}
    bare, none = demands.route_upstream(d.where("target LIKE '$%'"), nodes, r, graph.callers(links))
    assert {asked[x.note_id][1] for x in none.collect()} == {"$x"} and {x.branch for x in bare.collect()} == {"bare"}


def test_cve_demands(rows):
    records = rows("source_cve string, namespace string, description string, target_node string", ("C1", "lib", "d", ""), ("C2", "none", "d", ""), ("C3", None, "d", ""))
    at = rows("node_id string, namespace string", *[(f"n{i}", "lib") for i in range(8)], ("n1", "lib"), (None, None))
    uses = at.where("node_id <> 'n0'")
    assert sorted((x.target_node, x.source) for x in demands.cve_demands(records, at, uses).collect()) == [(f"n{i}", "C1") for i in range(1, 8)]
    assert {x.source_cve: x.hint for x in demands.usage_hints(records, at, uses).collect()} == {"C1": "n1, n2, n3, n4, n5 (+2 more)", "C2": None, "C3": None}
    assert demands.usage_hints(records, at, uses, shown=7).where("hint LIKE '%n7'").count() == 1


def test_failed(rows):
    asked = rows("target_node string, demand_id string, source string, parameter_name string, description string, label string", ("t", "D0", "s", "$id", "one", ""), ("t", "D1", "r", "$id", "two", ""), ("t", "D2", "q", None, None, ""), ("u", "D0", None, "", "x", ""))
    e = rows("target_node string, demand_id string, status string, evidence string", ("t", "D0", "FAILED", "e"), ("t", "D1", "FAILED", None), ("t", "D2", "FAILED", "f"), ("t", "D9", "FAILED", "g"), ("u", "D0", "FAILED", "h"), ("u", "D0", "MET", "i"), ("u", "D0", None, "i"))
    text = lambda d, v: f"Fails to satisfy demand: '{d}'. Evidence: {v}"
    assert sorted(tuple(x) for x in demands.failed_demands(e, asked).collect()) == sorted([("t", "D0", "$id#0", text("one", "e")), ("t", "D1", "$id#1", text("two", "None")), ("t", "D2", "q", text("None", "f")), ("t", "D9", "D9", text("No description found.", "g")), ("u", "D0", "unknown", text("x", "h"))])
