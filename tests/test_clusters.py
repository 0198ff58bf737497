"""Gated clustering over whole groups, against a plain version."""

import random

import numpy as np

from auditlake.operators import linkage
from auditlake.plans import record_queries

FINDING = "finding_id bigint, vuln_id string, cwe_id string, description string, vulnerable_component string, affected_nodes array<string>, vulnerability_type string, source_cve string, arrived_at timestamp"


def plain_clusters(data):
    """As the definition says: one finding after the other, each with every seed."""
    seeds, crossed, out = [], {}, {}
    for i, nodes, tokens, weak, v in data:
        best, joined = -1.0, None
        for s in seeds:
            c = round(float(np.dot(v, s[4]) / np.sqrt(np.dot(v, v) * np.dot(s[4], s[4]))), 12)
            a, b = set(tokens), set(s[2])
            jaccard = len(a & b) / len(a | b) if a and b else 0.0
            either, same = weak or s[3], nodes == s[1]
            passes = c >= 0.8 if same else (either or c >= 0.95 or jaccard >= 0.4) if c >= 0.93 else c >= 0.85 and not either and jaccard >= 0.6
            if c > best and passes and (same or crossed.get(s[0], 0) < 25):
                best, joined = c, s
        if joined:
            out[i] = joined[0]
            crossed[joined[0]] = crossed.get(joined[0], 0) + (nodes != joined[1])
        else:
            out[i] = i
            seeds.append((i, nodes, tokens, weak, v))
    return out


def test_gated_clusters_over_blocks(spark):
    rng, rnd = np.random.default_rng(5), random.Random(5)
    centres = rng.normal(size=(150, 12))
    data = []
    for i in range(3 * linkage.GATE_BLOCK // 2 + 7):
        v = (centres[rnd.randrange(150) if rnd.random() < 0.9 else 0] + rng.normal(size=12) * rnd.choice([0.05, 0.3, 0.5])).astype(np.float32)
        data.append((i, f"n{rnd.randrange(40)}", rnd.sample("abcde", rnd.randrange(5)), rnd.random() < 0.3, v.astype(float)))
    df = spark.createDataFrame([("g", *x[:4], x[4].tolist()) for x in data], "g string, id bigint, nodes string, tokens array<string>, degenerate boolean, vector array<float>").repartition(5)
    assert {r.row_id: r.seed for r in linkage.gated_clusters(df, ["g"], "id").collect()} == plain_clusters(data)


def test_duplicates_far_apart_in_a_class(spark, rows, tmp_path):
    def finding(i, component, text, nodes, cwe="CWE-89", kind="Code Defect", cve=None):
        return (i, f"v{i:04}", cwe, text, component, nodes, kind, cve, None)

    other = [finding(i, f"call{i}.run(x{i})", " ".join(f"w{i}x{k}" for k in range(12)), [f"m{i:04}"]) for i in range(10, 130)]
    same = "the value of name reaches the query in save without any binding of it"
    got = record_queries.hypothesis_clusters
    data = [
        *other, finding(1, "store.save(name)", same, ["a"]), finding(2, "store.save(name)", same + " now", ["z"], " cwe-89"),
        finding(3, "store.save(name)", same, ["y"], kind="Systemic"), finding(4, "store.save(name)", same, ["x"], "CWE-79"),
        finding(5, "store.save(name)", same, ["a"], cve="CVE-1"), finding(6, "auth.check(id)", "one way to put it", ["b"]), finding(7, " Auth.check(ID)", "another text", ["b", "", "b"]),
    ]
    rows(FINDING, *data, data[0]).write.parquet(f"{tmp_path}/findings.parquet")
    out = [(r.finding_id, r.seed) for r in got(spark, str(tmp_path)).collect()]
    assert len(out) == len(data) and {i: s for i, s in out if i != s} == {2: 1, 7: 6}
