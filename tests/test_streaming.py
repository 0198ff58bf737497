from pyspark.sql import functions as F

from auditlake.operators.merge import merge_records
from auditlake.streaming import keyed

SCHEMA = "key string, seq int, id bigint, status string, description string, affected_nodes array<string>, source_cve string, patch_state string, force_reset boolean"


def test_merging_late_updates(spark, tmp_path):
    u = [("k", 2, 2, "confirmed", "b", ["y"], None, None, False), ("k", 1, 1, "hypothesis", "a", ["x"], None, None, False), ("j", 1, 3, "confirmed", "c", [], None, None, False), ("k", 3, 4, "confirmed", "d", ["z"], None, None, False)]
    source, table, point = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "point")
    for part in (u[:1], u[1:]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(source)
        q = keyed.merge_stream(spark.readStream.schema(SCHEMA).parquet(source), table, point)
        q.awaitTermination(60)
        assert q.exception() is None
    got = sorted(map(str, keyed.merged(spark, table).collect()))
    assert got == sorted(map(str, merge_records(spark.createDataFrame(u, SCHEMA)).collect())) and len(got) == 2


def run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    return spark.table(name).collect()


def test_windows_and_claims(spark, tmp_path):
    e = spark.createDataFrame([("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:30:00", "a", 2.0), ("2024-01-01 02:00:00", "a", 4.0), ("2024-01-01 05:00:00", "b", 1.0)], "ts string, kind string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    got = run(spark, keyed.window_stream(stream, "ts", "1 hour", "10 minutes", "kind", "value"), "w")
    assert {(str(r.start), r.kind, r.n, r.total) for r in got} >= {("2024-01-01 00:00:00", "a", 2, 3.0), ("2024-01-01 02:00:00", "a", 1, 4.0)}
    assert {(r.kind) for r in run(spark, keyed.claim_stream(stream, ["kind"], "ts", "10 days"), "c")} == {"a", "b"}
    assert ("a", 1) in {(r.kind, r.n) for r in run(spark, keyed.session_stream(stream, "ts", "5 minutes", "10 minutes", "kind"), "s")}
