from symbolmill.streaming import feeds

CHANGES = "key string, seq long, op string, payload string"


def finish(query):
    query.processAllAvailable()
    query.stop()


def test_change_feed_in_any_order(spark, tmp_path):
    batches = [[("a", 5, "update", "x"), ("b", 1, "insert", "y")], [("a", 3, "insert", "old"), ("b", 2, "delete", None)], [("b", 1, "insert", "y"), ("c", 1, "insert", "z")]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
    for i in range(len(batches)):
        spark.read.parquet(str(tmp_path / f"in{i}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    stream = feeds.stream_table(spark, str(tmp_path), "t", CHANGES, max_files=1)
    q = feeds.latest_changes(stream).writeStream.outputMode("update").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "cp")).start()
    finish(q)
    last = {}
    for r in spark.table("latest").collect():
        last[r.key] = max(last.get(r.key, (0,)), (r.seq, r.op, r.payload or ""))
    assert {k: v[:2] for k, v in last.items()} == {"a": (5, "update"), "b": (2, "delete"), "c": (1, "insert")}
    q = stream.writeStream.foreachBatch(feeds.merge_into(str(tmp_path / "out"), ["key"], "seq")).option("checkpointLocation", str(tmp_path / "cp2")).start()
    finish(q)
    rows = spark.read.parquet(str(tmp_path / "out/2")).collect()
    assert {(r.key, r.seq, r.op) for r in rows} == {("a", 5, "update"), ("b", 2, "delete"), ("c", 1, "insert")}


def test_windows_and_repeats(spark, tmp_path):
    schema = "reference_id long, reference_kind string, recorded_at timestamp"
    df = spark.sql("select * from values (1L, 'x', timestamp'2024-01-01'), (1L, 'x', timestamp'2024-01-01'), (2L, 'x', timestamp'2024-01-02'), (3L, 'y', timestamp'2024-01-02') t(reference_id, reference_kind, recorded_at)")
    df.coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    stream = feeds.unique_deliveries(feeds.stream_table(spark, str(tmp_path), "t", schema), "reference_id", "recorded_at")
    q = stream.writeStream.format("memory").queryName("unique_refs").option("checkpointLocation", str(tmp_path / "cp")).start()
    finish(q)
    assert spark.table("unique_refs").count() == 3
    counted = feeds.references_per_window(feeds.stream_table(spark, str(tmp_path), "t", schema))
    q = counted.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp2")).start()
    finish(q)
    assert {(r.reference_kind, r.n) for r in spark.table("windows").collect()} == {("x", 3), ("y", 1)}
