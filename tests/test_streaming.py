from provenir.streaming.ingest import ingest


def test_stream_keeps_each_content_once_and_a_second_run_adds_nothing(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string").coalesce(1).write.parquet(src)

    def run():
        stream = spark.readStream.schema("doc_id long, text string").parquet(src)
        ingest(stream, out, str(tmp_path / "cp")).awaitTermination(60)
        return sorted((r.doc_id, r.text) for r in spark.read.parquet(out).collect())

    assert run() == [(1, "a"), (2, "b")]
    spark.createDataFrame([(4, "b"), (5, "c")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
    assert run() == [(1, "a"), (2, "b"), (5, "c")] == run()
