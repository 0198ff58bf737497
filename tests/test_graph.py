
from auditlake.operators import graph
from auditlake.session import Scratch

LINK = "link_id bigint, source string, target string, relation string, observed_at int, node string"
NODE = "id string, label string, source_file string, file_type string, community int, name string"


def links(rows, *data):
    return rows(LINK, *[(i, *d, None, "clash") for i, d in enumerate(data)])


def nodes(rows, *data):
    return rows(NODE, *[(*d, "clash") for d in data])


def test_closure_with_cycle(spark, rows):
    df = links(rows, ("a", "b", "inherits"), ("b", "c", "inherits"), ("c", "a", "inherits"), ("c", "c", "inherits"), ("a", "b", "inherits"), ("a", "x", "calls"))
    got = {(r.node, r.ancestor): r.depth for r in graph.ancestors(df, "inherits", Scratch(spark)).collect()}
    assert got == {("a", "b"): 1, ("b", "c"): 1, ("c", "a"): 1, ("a", "c"): 2, ("b", "a"): 2, ("c", "b"): 2}
    chain = links(rows, *[(f"n{i}", f"n{i + 1}", "inherits") for i in range(12)])
    got = graph.ancestors(chain, "inherits", Scratch(spark)).where("node = 'n0'").collect()
    assert sorted(r.depth for r in got) == list(range(1, 9))
    assert graph.ancestors(df.limit(0), "inherits", Scratch(spark)).collect() == []


def test_paths(spark, rows):
    df = links(rows, ("a", "b", "calls"), ("b", "d", "calls"), ("a", "c", "calls"), ("c", "d", "uses"), ("b", "c", "calls"), ("c", "b", "calls"), ("d", "a", "calls"), ("a", "b", "uses"))
    got = [(r.hops, r.path) for r in graph.simple_paths(df, "a", "d").collect()]
    assert got == [(2, list("abd")), (2, list("acd")), (3, list("abcd")), (3, list("acbd"))]
    assert [r.path for r in graph.simple_paths(df, "a", "d", most=1).collect()] == [list("abd")]
    assert graph.simple_paths(df, "a", "none").collect() == [] and graph.simple_paths(df, "a", "d", max_hops=1).collect() == []


def test_members(rows):
    n = nodes(rows, ("A", "A", "f", "code", 1), ("B", "B", "f", "code", 1), ("A.run", ".Run()", "f", "code", 1), ("A.run2", ".run()", "f", "code", 1), ("A.f", "fun()", "f", "code", 1), ("B_go", ".go()", "f", "code", 1), ("A_run", ".run()", "f", "code", 1), ("C_go", ".go()", "g", "code", 1), ("C", "C", "f", "code", 1), ("D", None, None, "code", 1), ("D_x", ".x()", None, "code", 1), ("_go", ".go()", "f", "code", 1))
    df = links(rows, ("A", "A.run2", "method"), ("A", "A.run", "method"), ("A", "A.f", "method"), ("A", "B_go", "contains"), ("gone", "A.run", "method"), ("A", "gone", "method"))
    assert {(r.container, r.name, r.member) for r in graph.members(n, df).collect()} == {("A", "run", "A.run"), ("B", "go", "B_go"), ("D", "x", "D_x")}


def test_inheritance(spark, rows):
    own = rows("container string, name string, member string", ("A", "x", "A.x"), ("B", "x", "B.x"), ("B", "y", "B.y"), ("C", "y", "C.y"), ("D", "z", "D.z"))
    up = rows("source string, target string, name string", ("A", "B", ""), ("A", "B", ""), ("A", "C", ""), ("B", "D", ""), ("D", "A", ""), ("D", "D", ""), ("E", "E", ""), ("F", "A", ""))
    got = {(r.node, r.name): (r.member, r.owner, r.depth) for r in graph.inherited_members(own, up, Scratch(spark)).collect()}
    assert got == {
        ("A", "x"): ("A.x", "A", 0), ("A", "y"): ("B.y", "B", 1), ("A", "z"): ("D.z", "D", 2), ("B", "x"): ("B.x", "B", 0), ("B", "y"): ("B.y", "B", 0), ("B", "z"): ("D.z", "D", 1), ("C", "y"): ("C.y", "C", 0),
        ("D", "z"): ("D.z", "D", 0), ("D", "x"): ("A.x", "A", 1), ("D", "y"): ("B.y", "B", 2), ("F", "x"): ("A.x", "A", 1), ("F", "y"): ("B.y", "B", 2), ("F", "z"): ("D.z", "D", 3),
    }
    assert len(graph.inherited_members(own, up, Scratch(spark), depth=1).collect()) == 9
    assert graph.inherited_members(own.limit(0), up, Scratch(spark)).collect() == []


def test_definitions(spark, rows):
    schema = "name string, class string, parent string, file string, start_line int, end_line int, trail string"
    s = rows(schema, *[(*x, "clash") for x in [("Top::go", "Top", None, "t", 1, 2), ("Mid::at", "Mid", "Top", "m", 5, 6), ("Mid::at", "Mid", "No", "m", 3, 4), ("Low::x", "Low", "Mid", "l", 1, 1), ("P::a", "P", "Q", "p", 1, 1), ("Q::b", "Q", "P", "q", 1, 1), ("fun", None, None, "f", 9, 9), (None, "N", "Top", "n", 1, 1)]])
    s = s.where("parent IS NULL OR parent <> 'No'").unionByName(rows(schema, ("Mid::b", "Mid", "No", "m", 9, 9, "")))
    asked = rows("symbol string, name string", *[(x, "") for x in ("Low::go", "Low::at", "Mid::at", "P::none", "fun", "none", "N::go", "Nil::go", None, "fun")])
    got = {r.symbol: (r.name, r.file, r.start_line, r.trail) for r in graph.definitions(s, asked, Scratch(spark)).collect()}
    assert got == {"Low::go": ("Top::go", "t", 1, ["Mid", "Top"]), "Low::at": ("Mid::at", "m", 5, ["Mid"]), "Mid::at": ("Mid::at", "m", 5, []), "fun": ("fun", "f", 9, []), "N::go": ("Top::go", "t", 1, ["Top"])}


def test_incident_and_degrees(rows):
    df = links(rows, ("a", "a", "calls"), ("a", "b", "calls"), ("a", "b", "uses"))
    assert sorted((r.node, r.other, r.direction) for r in graph.incident_links(df).collect()) == [("a", "a", "in"), ("a", "b", "out"), ("a", "b", "out"), ("b", "a", "in"), ("b", "a", "in")]
    assert {r.node: (r.links_in, r.links_out, r.predecessors, r.successors) for r in graph.degrees(df).collect()} == {"a": (1, 2, 1, 1), "b": (2, 0, 1, 0)}


def test_dirty_links(rows):
    df = rows("link_id bigint, source string, target string, relation string, ingested_at int", (1, " a ", "b\t", " Calls ", 1), (1, " a ", "b\t", " Calls ", 2), (2, "a", None, "calls", 1), (3, "a", "  ", "calls", 1), (4, "a", "b", None, 1))
    assert [(r.source, r.target, r.relation) for r in graph.clean_links(df).collect()] == [("a", "b", "calls")]


def test_edges_and_batches(rows):
    n = nodes(rows, ("a", "A", "s/a.py", "code", 1), ("b", "B", "s/b.py", "code", 2), ("t", "TestT", "s/t.py", "code", 2), ("v", "V", "vendor/v.py", "code", 3), ("d", "D", "s/d", "document", 4))
    df = links(rows, ("a", "b", "calls"), ("a", "b", "calls"), ("a", "t", "imports"), ("a", "t", "calls"), ("a", "v", "calls"), ("a", "d", "calls"), ("b", "t", "calls"), ("b", "a", "uses"))
    noted = rows("node_id string", ("b",), ("b",), (None,))
    e = graph.cross_community_edges(n, df, noted)
    assert [(r.source, r.target, r.link_id, r.source_noted, r.target_noted, r.match_key) for r in e.collect()] == [("a", "b", 0, False, True, "community 1->2 via calls")]
    many = rows("relation string, source string, target string, match_key string, source_noted boolean, target_noted boolean", *[("x", f"s{i:02}", "t", "k", i % 2 == 0, i % 3 == 0) for i in range(20)], ("y", "s", "t", "k", False, True))
    top = graph.top_per_category(many, "relation", 10)
    assert [r.source for r in top.where("relation = 'x'").orderBy("place").collect()] == ["s00", "s06", "s12", "s18", "s02", "s04", "s08", "s10", "s14", "s16"]
    b = graph.batches(top, "relation", 4, 3)
    assert sorted((r.relation, r.batch) for r in b.collect()) == [("x", 1)] * 4 + [("x", 2)] * 4 + [("x", 3)] * 2


def test_hops(spark, rows):
    df = links(rows, ("a", "b", "x"), ("b", "c", "x"), ("c", "a", "x"))
    got = graph.shortest_hops(df, rows("id string", ("a",), ("q",)), Scratch(spark)).collect()
    assert {(r.start, r.node, r.hops) for r in got} == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("q", "q", 0)}
