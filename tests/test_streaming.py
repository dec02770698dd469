from pyspark.sql import functions as F

from tracewright.streaming import sessions


def test_error_fixes_across_batches(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    schema = "session int, ord long, kind string, item string"
    batches = [[(1, 1, "use", "A"), (1, 2, "err", "A"), (2, 1, "err", "X")], [(1, 3, "use", "B"), (1, 4, "use", "C"), (2, 2, "err", "Y")], [(2, 3, "use", "Z")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = sessions.error_fixes(spark.readStream.schema(schema).parquet(str(src))).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r.session, r.err, r.fix, r.ord) for r in spark.read.parquet(out).collect())
    assert got == [(1, "A", "B", 3), (2, "Y", "Z", 3)]


def test_session_activity(spark):
    rows = [(1, "2026-01-01 00:00:00", "a"), (1, "2026-01-01 00:10:00", "b"), (1, "2026-01-01 02:00:00", "a")]
    df = spark.createDataFrame(rows, "user_id int, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    got = sorted((str(r.start), r.n, r.n_items) for r in sessions.session_activity(df).collect())
    assert [(n, k) for _, n, k in got] == [(2, 2), (1, 1)]
