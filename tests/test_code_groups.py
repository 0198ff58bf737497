"""Code, histories and groups against plain versions."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.functions import text
from auditlake.operators import code, groups, histories
from auditlake.plans import record_queries
from auditlake.session import Scratch


def test_code(rows):
    md = "intro\n```py\nimport a.b\nfrom c import d\nfrom . import e\nclass K:\n    x: int = 1\n    def m(self):\n        return f()\n```\nmid\n```\nX = 1\n```\n```\nopen ("
    df = rows("id int, t string, code string", (1, md, "clash"), (2, None, ""), (3, "no fence", ""))
    blocks = code.code_blocks(df, ["id"], "t")
    assert [(r.id, r.block_no) for r in blocks.collect()] == [(1, 1), (1, 2), (1, 3)]
    got = {r.block_no: r for r in code.python_features(blocks, ["id", "block_no"], "code").collect()}
    r = got[1]
    assert (r.parsed, r.imports, r.calls, r.inert) == (True, ["a", "c"], 1, False)
    assert [(s.kind, s.name, s.parent, s.start_line, s.end_line) for s in r.symbols] == [("class", "K", None, 4, 7), ("method", "m", "K", 6, 7)]
    assert got[2].inert and not got[3].parsed and got[3].symbols == [] and not got[3].inert
    nothing = code.python_features(rows("id int, c string", (1, None), (2, "")), ["id"], "c").collect()
    assert [(x.parsed, x.inert) for x in nothing] == [(False, False), (True, True)]


def test_html(rows):
    page = """<p>Hi &amp; <b>you</b></p><script>no()</script><a href=' /x '>l</a><a>none</a><form><input type=hidden name=csrf_tok value=1><input type=hidden name=other value=2></form>
    <meta name="csrf-param" content="authenticity"><meta name="csrf-token" content="T"><meta name="csrf_tok" content="9">"""
    got = code.html_parts(rows("id int, h string, text string", (1, page, ""), (2, None, ""), (3, "", "")), ["id"], "h").collect()
    r = got[0]
    assert (r.text, r.links, r.forms) == ("Hi &\nyou\nl\nnone", ["/x"], 1)
    assert r.tokens == {"csrf_tok": "1", "csrf-token": "T", "authenticity": "T"}
    assert (got[1].text, got[1].links, got[2].text) == (None, [], "")


def test_html_by_any_tag(spark, rows, tmp_path):
    pages = ["<P>a</P>", '<p class="x">a', "<div>a</div>", "x<br/>y", '<A\nHREF="/b">a</A>', "<form action=q>", "<!DOCTYPE html>a", "<p>a</p>", "a<p>b</p>", "a < b > c", "<T>", "<pre", None, "Map<String, a>"]
    html = {*range(9)}
    rows("doc_id bigint, text string", *enumerate(pages)).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in record_queries.marked_up(spark, str(tmp_path)).collect()}
    assert got.keys() == html and (got[4].links, got[5].forms) == (1, 1)


def test_script_only(rows):
    t = "<template>\n<b/>\n</template>\n<script lang='a>b'>\nlet a\n</script>\r\n<style/><SCRIPT>x</script >"
    masked = "          \n    \n           \n                   \nlet a\n         \r\n                x          "
    cases = [(t, "x/A.VUE", masked), (t, "a.js", t), (masked, "a.vue", masked), (None, "a.vue", None), ("", "a.vue", ""), (t, None, t), ("<script>open", "a.vue", "<script>open")]
    got = rows("t string, p string, e string", *cases).withColumn("g", code.script_only(F.col("t"), F.col("p"))).collect()
    assert [r.g for r in got] == [r.e for r in got]


def plain_split(msgs, tail_turns, max_size):
    """(unit, part) of each message, read one by one."""
    part, n, seen = ["middle"] * len(msgs), 0, set()
    while n < len(msgs) and msgs[n][0] in ("system", "human") and msgs[n][0] not in seen:
        seen.add(msgs[n][0])
        part[n] = "head"
        n += 1
    unit, units, lead = 0, [], None
    for k, _ in msgs:
        if not (k == "tool" and lead == "ai"):
            unit, lead = unit + 1, k
        units.append(unit)
    answers = [i for i in range(n, len(msgs)) if msgs[i][0] == "ai"]
    if answers:
        start = answers[-min(tail_turns, len(answers))]
        big = [units[i] for i in range(start, len(msgs)) if msgs[i][0] in ("ai", "tool") and max_size and msgs[i][1] > max_size]
        for i in range(start, len(msgs)):
            if not big or units[i] > max(big):
                part[i] = "tail"
    return list(zip(units, part))


messages = st.lists(st.tuples(st.sampled_from(["system", "human", "ai", "ai", "tool", "tool"]), st.integers(0, 9)), max_size=12)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(messages, min_size=1, max_size=6), st.integers(1, 3), st.sampled_from([0, 7]), st.integers(5, 60))
def test_histories(rows, convs, tail_turns, max_size, budget):
    data = [(c, i, k, n, "clash") for c, msgs in enumerate(convs) for i, (k, n) in enumerate(msgs)]
    df = rows("conv int, turn int, kind string, size int, part0 string", *data) if data else None
    if df is None:
        return
    got = {(r.conv, r.turn): (r.unit, r.part) for r in histories.split_history(df, "conv", "turn", "kind", "size", tail_turns, max_size).collect()}
    for c, msgs in enumerate(convs):
        assert [got[c, i] for i in range(len(msgs))] == plain_split(msgs, tail_turns, max_size)
    kept = {(r.conv, r.turn): r.kept for r in histories.keep_fitting(df, "conv", "turn", "size", budget).collect()}
    est = lambda xs: int(sum(xs) / 2 * 1.15) + 8 * len(xs)
    for c, msgs in enumerate(convs):
        left = {i: n for i, (_, n) in enumerate(msgs)}
        while left and est(left.values()) >= budget:
            left.pop(max(left, key=lambda i: (est([left[i]]), -i)))
        assert {i for i in range(len(msgs)) if kept[c, i]} == set(left)


def test_repeated_calls(rows):
    a, b = ("f", "1"), ("g", "2")
    data = [("x", 1, "ai", [a, b]), ("x", 2, "tool", None), ("x", 3, "ai", [b, a]), ("y", 1, "ai", [a]), ("y", 2, "ai", [b]), ("z", 1, "ai", [a]), ("w", 1, "ai", [a]), ("w", 2, "ai", []), ("w", 3, "ai", [a])]
    df = rows("conv string, turn int, kind string, calls array<struct<name:string,args:string>>", *data)
    assert sorted(r.conv for r in histories.repeated_calls(df, "conv", "turn", "kind", "calls").collect()) == ["w", "x"]


def test_groups(rows):
    f = rows("id int, cwe_id string, vulnerable_component string, together string", *[(i, "C", " a  b C ", "") for i in range(3)], (5, "C", "uid", ""), (6, "C", "uid", ""), (7, "D", "x.y()", ""), (8, None, None, ""), *[(10 + i, "E", "p q r", "") for i in range(7)])
    got = {r.id: (r.check_key is not None, r.together) for r in groups.shared_checks(f.drop("together")).collect()}
    assert all(got[i] == (True, True) for i in range(3)) and got[5] == got[8] == (False, False) and got[7] == (True, False) and got[12] == (True, False)
    m = rows("g int, id int, s boolean, n int", (1, 3, False, 9), (1, 2, True, 1), (2, 5, None, None), (2, 4, False, 0), (2, 6, False, 2))
    assert {(r.g, r.head, r["size"]) for r in groups.group_heads(m, "g", "id", "s", "n").collect()} == {(1, 2, 2), (2, 6, 3)}
    p = rows("proposal_id bigint, member string", (1, "a"), (1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "z"))
    g = rows("member string, group_id string", ("a", "G"), ("b", "G"), ("c", "G"), ("q", "H"))
    assert [tuple(r) for r in groups.best_reasons(p, g).collect()] == [("G", 1, 2)]
    n = rows("id string, label string, source_file string, community int", ("f", "a.py", "x/a.py", 1), ("r", "run()", "x/a.py", 1), ("l", "b.py", "x/b.py", 1), ("e", "", "x/b.py", 1), ("o", "a.py", "x/a.py", 2), ("n", None, None, 1), ("c", "x", "x/c", None))
    assert {r.id for r in groups.without_skeletons(n).collect()} == {"r", "l", "e", "o", "n"}
    res = rows("row_id string, confirmed boolean", ("a", True), ("b", True), ("b", False), ("zz", True))
    done, rest = groups.own_verdicts(res, rows("grp int, row_id string", (1, "a"), (1, "b"), (1, "c")))
    assert [(r.row_id, r.confirmed) for r in done.collect()] == [("a", True)] and {r.row_id for r in rest.collect()} == {"b", "c"}


def test_places(spark, rows):
    rng = random.Random(1)
    nodes = [(rng.choice("fg"), rng.choice([None, *range(0, 50, 5)]), f"n{i}") for i in range(25)]
    places = [(i, rng.choice(["f", "g", "h", None]), rng.choice([None, *range(60)])) for i in range(60)]
    df = groups.enclosing_nodes(rows("pid int, file string, line int", *places), rows("file string, line int, node string", *nodes), Scratch(spark))
    for r in df.collect():
        before = [(ln, n) for f, ln, n in nodes if f == r.file and ln is not None and r.line is not None and ln <= r.line]
        assert r.node == (min(n for ln, n in before if ln == max(before)[0]) if before else None)


def test_more_text(rows):
    names = rows("n string, e boolean", ("isAdmin", False), ("admin_panel", True), ("check-role()", True), ("mySecretKey", True), ("authority", True), ("author", True), ("parole", False), ("", False), (None, False))
    for r in names.withColumn("g", text.security_name("n")).collect():
        assert r.g == r.e, r.n
    t = rows("t string", ("2024-01-02T03:04:05.678901234Z",), ("2024-01-02T03:04:05",), ("nope",), (None,), ("2024-01-02T03:04:05+01:00",))
    base = 1704164645_000000
    assert [r[0] for r in t.select(text.epoch_micros("t")).collect()] == [base + 678901, base, None, None, base - 3600_000000]
    e = rows("k string, c string, v string, d string", ("K", "C", " V ", "D D"), (None, "", None, "X"), (None, None, None, None))
    assert [r[0] for r in e.select(text.embedding_text(*map(F.col, "kcvd"))).collect()] == ["K C v. d d", "x", ""]
    assert [r[0] for r in rows("a array<string>", ([" x", "x", "", None, "y"],), (None,)).select(text.cwe_list("a")).collect()] == [["x", "y"], []]
    assert [r[0] for r in rows("a string", ("A  b--C!",), (None,), ("x" * 70,)).select(text.slug("a")).collect()] == ["a-b-c", "", "x" * 60]
    assert [r[0] for r in rows("a string", ("a\nb",), ("",), ("x" * 91,), ("\n".join("a" * 21),), ("```",), (None,)).select(text.fits_inline("a")).collect()] == [True, False, False, False, False, False]


def test_names_and_parts(rows):
    n = rows("id string, label string, source_file string, shown string", *[(*x, "clash") for x in [("k", "Klass", "f"), ("k_go", ".Go()", "f"), ("k_run", ".run()", "g"), ("z_go", ".go()", "f"), ("q9", ".at()", "f"), ("e", "", "f"), ("n", None, None), ("w", "()", "f"), ("d", ".()", "f")]])
    assert {r.id: r.shown for r in groups.display_names(n).collect()} == {"k": "Klass", "k_go": "Klass::Go()", "k_run": "run()", "z_go": "go()", "q9": "at", "e": "e", "n": "n", "w": "()", "d": ".()"}
    m = rows("root int, id int, cve string, group_id int", (1, 3, "a", 0), (1, 2, "a", 0), (1, 5, None, 0), (1, 4, None, 0), (2, 2, "b", 0), (None, 9, None, 0))
    assert {tuple(r) for r in groups.split_groups(m, "root", "id", "cve").collect()} == {(1, 3, 2), (1, 2, 2), (1, 5, 4), (1, 4, 4), (2, 2, 2), (None, 9, 9)}
    p = rows("k string, n int, kind string, o string", ("a", 1, "x", "p"), ("a", 2, "ti", "q"), ("a", 3, "ti", "r"), ("b", 4, None, "s"), ("b", 5, "x", "t"), (None, 6, "x", "u"), (None, 6, "x", "u"), ("", 7, "ti", "v"))
    assert sorted(r.n for r in groups.preferred(p, "k", F.col("kind") == "ti", ["n"]).collect()) == [2, 4, 6, 6, 7]
    assert groups.preferred(p.limit(0), "k", F.lit(True), ["n"]).collect() == []


def test_keyword_filter(rows):
    from auditlake.operators import search

    r = rows("id int, ks array<string>, documents int", (1, None, 0), (2, [], 0), (3, [" "], 0), (4, [" Yes ", "no"], 0), (5, ["no"], 0), (5, ["no"], 0), (6, [None, "YES"], 0))
    counts = rows("keyword string, documents bigint", ("yes", 2), ("no", 0))
    keep = lambda scanned: sorted(x.id for x in search.with_found_keywords(r, "ks", counts, F.lit(scanned)).collect())
    assert keep(True) == [1, 2, 3, 4, 6] and keep(False) == [1, 2, 3, 4, 5, 5, 6]


def test_names_in_code(rows):
    cases = [("function f($A, int $b = 1,\n $a) {\n $no }", ["a", "b"]), ("abstract function g($x);\nfunction h($y)", ["x"]), ("\n" * 12 + "$late", []), ("", []), (None, None)]
    assert [r.g for r in rows("t string, e array<string>", *cases).select(code.signature_names(F.col("t")).alias("g")).collect()] == [e for _, e in cases]
    cases = [("class K {\n public $A = $z; private $c;\n protected static int $B;\n function f() {\n private $late;", ["a", "c", "b"]), ("class K { public $x; function f() {}", []), ("var $q", ["q"]), ("\n" * 400 + "var $late", []), ("", []), (None, None)]
    assert [r.g for r in rows("t string, e array<string>", *cases).select(code.property_names(F.col("t")).alias("g")).collect()] == [e for _, e in cases]


def test_last_reports(rows):
    f = rows("id string, n int, said string", ("a", 1, "old"), ("a", 2, ""), ("b", 3, ""), (None, 4, ""))
    r = rows("id string, at int, seq int, said string, n int", ("a", 5, 1, "p", 0), ("a", None, 9, "q", 0), ("a", 5, 2, None, 0), ("z", 1, 1, "r", 0), (None, 1, 1, "s", 0))
    assert sorted((x.n, x.said) for x in groups.with_last_report(f, r, "id", ["at", "seq"], ["said"]).collect()) == [(1, None), (2, None)]
