from foliary.streaming import jobs


def test_ingest_stream_stores_each_path_once(spark, tmp_path):
    src, store, ledger, check = (str(tmp_path / x) for x in ("in", "store", "ledger", "check"))
    shape = "collection_name string, path string, text string"
    first = spark.createDataFrame([("c", "/a//1", "x"), ("c", "/a/1", "x"), ("c", "/a/2", "y")], shape)
    first.write.parquet(src)
    run = lambda: jobs.ingest_stream(spark, src, first.schema, store, ledger, check).trigger(availableNow=True).start().awaitTermination(120)
    run()
    spark.createDataFrame([("c", "/a/2", "y"), ("c", "/a/3", "z"), ("e", "/a/2", "w")], shape).write.mode("append").parquet(src)
    run()
    got = spark.read.parquet(store).select("collection_name", "path").collect()
    assert len(got) == 4 and ("c", "/a/3") in {tuple(r) for r in got}


def test_trend_stream(spark, tmp_path):
    f = spark.sql("select timestamp'2025-01-01 10:00:00' created_at, true is_positive union all select timestamp'2025-01-01 11:00:00', false union all select timestamp'2025-01-02 11:00:00', null")
    f.write.parquet(str(tmp_path / "in"))
    q = jobs.trend_stream(spark.readStream.schema(f.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("trend").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((str(r.day), r.total, r.positive) for r in spark.table("trend").collect()) == [("2025-01-01", 2, 1), ("2025-01-02", 1, 1)]


def test_cache_stream_counts_hits(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = spark.createDataFrame([("c", "q", 1.0), ("c", "q", 2.0), ("c", "r", 3.0)], "collection_name string, question string, created_epoch double")
        rows.write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        q = jobs.cache_stream(stream).writeStream.format("memory").queryName("hits").outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert {(r.question, r.hits) for r in spark.table("hits").collect()} == {("q", 1), ("r", 0)}
    finally:
        spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
