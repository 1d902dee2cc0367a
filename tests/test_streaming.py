from tidemark.streaming.append import append_new, append_within_watermark, read_events


def test_stream_appends_what_is_new(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id int, ts timestamp, v string"
    rows = [(1, "a"), (2, "b"), (2, "b")]
    put = lambda rows: spark.createDataFrame(rows, "id int, v string").selectExpr("id", "timestamp '2024-01-01 00:00:00' as ts", "v").coalesce(1).write.mode("append").parquet(source)
    put(rows)
    run = lambda: append_new(read_events(spark, source, spark.createDataFrame([], schema).schema), target, ["id", "v"], str(tmp_path / "cp")).awaitTermination()
    run()
    put([(2, "b"), (3, "c")])  # one is sent again
    run()
    assert sorted((r.id, r.v) for r in spark.read.parquet(target).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_stream_with_watermark(spark, tmp_path):
    source = str(tmp_path / "in")
    df = spark.createDataFrame([(1,), (1,), (2,)], "id int").selectExpr("id", "timestamp '2024-01-01 00:00:00' as ts")
    df.coalesce(1).write.parquet(source)
    append_within_watermark(read_events(spark, source, df.schema), "ts", ["id"], "1 hour", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
