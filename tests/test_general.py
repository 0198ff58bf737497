"""Nested records and keys that hold most rows, each against a plain version."""

import json
import random
from collections import Counter, defaultdict

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.operators import hotkeys, ordering, shredding
from auditlake.plans import general_queries
from auditlake.session import Scratch

DEEP = pa.list_(pa.struct([("a", pa.string()), ("b", pa.list_(pa.struct([("c", pa.int64()), ("d", pa.list_(pa.string()))])))]))
words = st.one_of(st.none(), st.text("xyz", max_size=2))
inner = st.one_of(st.none(), st.fixed_dictionaries({"c": st.one_of(st.none(), st.integers(0, 9)), "d": st.one_of(st.none(), st.lists(words, max_size=3))}))
outer = st.one_of(st.none(), st.fixed_dictionaries({"a": words, "b": st.one_of(st.none(), st.lists(inner, max_size=3))}))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(outer, max_size=3)), max_size=6), st.integers(0, 2))
def test_shredding_round_trip(data, skip):
    array = pa.array(data, DEEP)[min(skip, len(data)) :]  # slices keep an offset
    data = data[min(skip, len(data)) :]
    leaves = shredding.shred_array(array, ("r",))
    rows, places, cols = shredding.assemble(leaves, ("r",))
    flat = [(i, p, (x or {}).get("a")) for i, r in enumerate(data) for p, x in enumerate(r or [])]
    assert list(zip(rows.tolist(), places[0].tolist(), cols[("a",)].to_pylist())) == flat
    rows, places, cols = shredding.assemble(leaves, ("r", "list", "b"))
    flat = [(i, p, q, (y or {}).get("c")) for i, r in enumerate(data) for p, x in enumerate(r or []) for q, y in enumerate((x or {}).get("b") or [])]
    assert list(zip(rows.tolist(), places[0].tolist(), places[1].tolist(), cols[("c",)].to_pylist())) == flat
    rows, places, cols = shredding.assemble(leaves, ("r", "list", "b", "list", "d"))
    flat = [(i, p, q, s, z) for i, r in enumerate(data) for p, x in enumerate(r or []) for q, y in enumerate((x or {}).get("b") or []) for s, z in enumerate((y or {}).get("d") or [])]
    assert list(zip(rows.tolist(), *[p.tolist() for p in places], cols[("value",)].to_pylist())) == flat


def test_levels():
    leaves = shredding.shred_array(pa.array([None, [], [None, {"a": None, "b": []}], [{"a": "x", "b": [{"c": 1, "d": None}]}]], DEEP), ("r",))
    a = leaves[0]
    assert (a.row.tolist(), a.rep.tolist(), a.defn.tolist()) == ([0, 1, 2, 2, 3], [0, 0, 0, 1, 0], [0, 1, 2, 3, 4])


def test_answers():
    note = {"note_id": 7, "upstream": {"target": "t"}, "downstream": ["plain", None, {"description": " "}], "vulns": None}
    parse = shredding.answer_parser("note_id", {"upstream": ["target", "description"], "downstream": ["target", "description"], "vulns": ["cwe"]}, "description")
    body = json.dumps({"notes": [note]})
    whole = {"key": 7, "upstream": [{"target": "t", "description": None}], "downstream": [{"target": None, "description": "plain"}, None, {"target": None, "description": " "}], "vulns": None}
    good = [body, json.dumps([note]), json.dumps(note), json.dumps({"result": {"notes": [note]}}), json.dumps(body), f"```json\n{body}\n```", f"Here [see below] it is: {body} and so on", json.dumps({"answer": [body]})]
    for text in good:
        assert parse(pa.array([text])).to_pylist() == [whole], text
    for text in (None, "", " \n", "null", "no JSON {here}", body[:-1], body[: len(body) // 2], "```json\n" + body[:-2] + "\n```", '[{"note_id": 1}, {', "5", '{"note_id": null}', '{"note_id": "x"}', json.dumps(body[:-3])):
        assert parse(pa.array([text], pa.string())).to_pylist() == [], text
    assert parse(pa.array([json.dumps({"notes": [{"note_id": "12", "vulns": [5, [1], {"cwe": 3}]}]})])).to_pylist()[0]["vulns"] == [None, None, {"cwe": "3"}]


def test_answers_wrapped_deeply():
    note = {"note_id": 7, "upstream": [{"target": "t"}]}
    parse = shredding.answer_parser("note_id", {"upstream": ["target"]}, "target")
    deep = note
    for k in range(40):
        deep = {"k": deep} if k % 2 else [deep]
    quoted = json.dumps(json.dumps(json.dumps(note)))
    for x in (deep, {"answer": json.dumps(note)}, {"a": [{"b": f"```json\n{json.dumps([note])}\n```"}]}, {"a": quoted}):
        assert parse(pa.array([json.dumps(x)])).to_pylist() == [{"key": 7, "upstream": [{"target": "t"}]}], x
    inner = {"note_id": 7, "upstream": [{"target": "t"}], "more": json.dumps({"note_id": 8})}
    assert [r["key"] for r in parse(pa.array([json.dumps({"a": inner, "b": 'say "hello"', "c": '"'})])).to_pylist()] == [7]


def test_entries_of_tables(rows):
    schema = "note_id bigint, branch string, pos string, key string, upstream array<struct<target:string,description:string>>"
    df = rows(schema, (1, "x", "y", "z", [("a", None), None]), (2, None, None, None, []), (3, None, None, None, None), (1, "x", "y", "z", [("a", None), None]), (None, "", "", "", [("b", "")]))
    got = shredding.entries(df, "note_id", {"upstream": ["target", "description"]}).collect()
    assert Counter((r.key, r.branch, r.pos, r.target) for r in got) == Counter([(1, "upstream", 0, "a"), (1, "upstream", 1, None)] * 2 + [(None, "upstream", 0, "b")])
    assert shredding.entries(df.limit(0), "note_id", {"upstream": ["target", "description"]}).collect() == []
    t = shredding.level_table(df, "note_id", "upstream").where("key = 1").distinct().collect()
    assert sorted((r.path, r.slot, r.rep, r["def"], r.value) for r in t) == [
        ("upstream.list.description", 0, 0, 3, None), ("upstream.list.description", 1, 1, 2, None), ("upstream.list.target", 0, 0, 4, "a"), ("upstream.list.target", 1, 1, 2, None)
    ]


def test_tables_of_all_branches(spark, rows, tmp_path):
    way, vuln = "array<struct<target:string,description:string>>", "array<struct<cwe:string,component:string,description:string,pattern_label:string>>"
    note = (1, [("a", "b"), None], [("c", None)], [("CWE-1", "d", "e", None)])
    rows(f"note_id bigint, upstream {way}, downstream {way}, vulns {vuln}", note, note).write.parquet(f"{tmp_path}/notes.parquet")
    raw = json.dumps({"notes": [{"note_id": 2, "upstream": [{"target": "x"}], "downstream": ["y"], "vulns": [{"cwe": "CWE-2"}]}]})
    rows("payload string", (raw,), (raw,), (None,)).write.parquet(f"{tmp_path}/note_batches.parquet")
    got = lambda f: sorted(map(tuple, f(spark, str(tmp_path)).collect()))
    assert got(general_queries.p3_upstream_entries) == [(1, 0, "a", "b"), (1, 1, None, None), (2, 0, "x", None)]
    assert got(general_queries.p3_downstream_entries) == [(1, 0, "c", None), (2, 0, None, "y")]
    assert got(general_queries.p3_vulns_entries) == [(1, 0, "CWE-1", "d", "e", None), (2, 0, "CWE-2", None, None, None)]
    levels = {x[:3]: x[3:] for x in got(general_queries.p3_levels)}
    assert levels[("upstream.list.target", 0, 4)] == (4, 4) and levels[("upstream.list.target", 1, 2)] == (2, 0)
    assert levels[("downstream.list.description", 0, 4)] == (2, 2) and levels[("vulns.list.cwe", 0, 4)] == (4, 4)


def test_hot_keys(spark, rows):
    random.seed(5)
    data = [("hot" if random.random() < 0.6 else random.choice("abc"), random.choice(["u", "v", None]), random.randrange(60), random.choice([None, *range(5)]), "extra", 1, 2) for _ in range(600)]
    data += data[:50]
    df = rows("k string, r string, id bigint, at int, weight string, __key_n int, __c_at int", *data)
    c = hotkeys.compress(df, {"k": F.col("k"), "r": F.col("r")}, {"id": F.col("id")}, {"at": F.col("at")})
    best = defaultdict(dict)
    for k, r, i, at, *_ in data:
        old = best[k, r].get(i)
        best[k, r][i] = at if old is None else max(old, -1 if at is None else at)
    expected = {(k, r, i) for (k, r), m in best.items() if len(m) >= 20 for i in sorted(m, key=lambda i: (m[i] is not None, m[i] or 0, i), reverse=True)[:3]}
    got = hotkeys.latest_per_key(c, ["k", "r"], "id", "at", 3, 20).collect()
    assert {(x.k, x.r, x.id) for x in got} == expected and len(got) == len(expected)
    p = hotkeys.weighted_profile(hotkeys.compress(df, {"k": F.col("k")}, {"v": F.col("at")}), ["k"], "v", Scratch(spark), (0.5, 0.9)).collect()
    for x in p:
        known = sorted(d[3] for d in data if d[0] == x.k and d[3] is not None)
        count = Counter(known)
        mode = min(count, key=lambda v: (-count[v], v))
        assert (x.n_rows, x.n_distinct, x["mode"], x.mode_rows) == (sum(d[0] == x.k for d in data), len(count), mode, count[mode])
        assert (x.p50, x.p90) == (known[-(-len(known) // 2) - 1], known[-(-len(known) * 9 // 10) - 1])
    empty = hotkeys.compress(df.limit(0), {"k": F.col("k")}, {"v": F.col("at")})
    assert hotkeys.weighted_profile(empty, ["k"], "v", Scratch(spark)).collect() == []
    nulls = rows("k string, at int", ("a", None), (None, 1))
    got = hotkeys.weighted_profile(hotkeys.compress(nulls, {"k": F.col("k")}, {"v": F.col("at")}), ["k"], "v", Scratch(spark)).collect()
    assert {(x.k, x.n_rows, x.n_distinct, x["mode"], x.p50) for x in got} == {("a", 1, 0, None, None), (None, 1, 1, 1, 1)}


def test_running_splits_a_hot_group(spark):
    """A group with a third of all rows is spread like the rest, and what runs over it is right across its parts."""

    class Seen(Scratch):
        def keep(self, df, **seen):
            self.kept = super().keep(df, **seen)
            return self.kept

    rng = random.Random(3)
    data = [("hot" if i % 3 == 0 else f"k{rng.randrange(40)}" if i % 50 else None, i, rng.choice([None, rng.randrange(9)]), "clash") for i in range(6000)]
    rng.shuffle(data)
    scratch = Seen(spark)
    df = spark.createDataFrame(data, "k string, at int, v int, rn string")
    got = ordering.running(df, ["k"], ["at"], scratch, {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, {"all": ("sum", F.lit(1))}).collect()
    sizes = sorted(r["count"] for r in scratch.kept.groupBy("__part").count().collect())
    assert len(sizes) >= 3 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    assert scratch.kept.where("k = 'hot'").select("__part").distinct().count() > 1
    sums, most, n = defaultdict(int), {}, Counter(d[0] for d in data)
    expected = {}
    for k, at, v, _ in sorted(data, key=lambda d: d[1]):
        expected[at] = (k, sums[k], most.get(k), n[k])
        if v is not None:
            sums[k], most[k] = sums[k] + v, max(v, most.get(k, v))
    assert len(got) == 6000 and {r.at: (r.k, r.s, r.m, r["all"]) for r in got} == expected
    assert ordering.running(df.limit(0), [], ["at"], Scratch(spark), {"s": ("sum", F.col("v"))}).collect() == []


def test_quoted_after_brackets():
    assert shredding.documents_in("[x [y " * 2000 + '{"a": 1}') == [{"a": 1}] and shredding.documents_in('```json\n"[1]"') == ["[1]"] and shredding.documents_in('say "[1]" now') == ["[1]"]
