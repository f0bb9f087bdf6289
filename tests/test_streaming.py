from datetime import datetime

from sparkredact.streaming import watch


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = [("p", 0, "a@b.io", 0.9, datetime(2024, 1, 1, 0, 1)), ("p", 1, "hello world", 0.9, datetime(2024, 1, 1, 0, 2)), ("q", 0, "45%", 0.9, datetime(2024, 1, 1, 0, 7))]
    spark.createDataFrame(rows, watch.SEGMENT_SCHEMA).repartition(2).write.parquet(f"{tmp_path}/in")
    stream = watch.segments_in(spark, f"{tmp_path}/in", files=1)
    query = watch.to_table(watch.detected(stream), f"{tmp_path}/out", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r.image_id, r.seg_idx, r.categories) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("p", 0, ["email", "url"]), ("q", 0, ["percent_value"])]


def test_counts_in_windows(spark, tmp_path):
    rows = [("p", i, "45%", 0.9, datetime(2024, 1, 1, 0, m)) for i, m in enumerate([1, 2, 7])]
    spark.createDataFrame(rows, watch.SEGMENT_SCHEMA).write.parquet(f"{tmp_path}/in")
    query = watch.category_counts(watch.segments_in(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.window.start.minute, r.category, r.n) for r in spark.table("counts").collect()) == [(0, "percent_value", 2), (5, "percent_value", 1)]
