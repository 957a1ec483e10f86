import datetime as dt

from attestra.streaming import latest as L

SCHEMA = "k string, t timestamp, v string"


def source(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame([(k, dt.datetime(2024, 1, d), v) for k, d, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_latest_rows(spark, tmp_path):
    stream = source(spark, tmp_path, [[("a", 1, "x"), ("b", 5, "y")], [("a", 3, "z"), ("b", 2, "old")], [("a", 2, "late")]])
    q = L.latest_rows(stream, "k", "t", "v").writeStream.outputMode("update").format("memory").queryName("latest").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    rows = spark.table("latest").collect()
    assert {k: max((r.t, r.v) for r in rows if r.k == k)[1] for k in "ab"} == {"a": "z", "b": "y"}


def test_deliveries_and_windows(spark, tmp_path):
    stream = source(spark, tmp_path, [[("a", 1, "x"), ("a", 1, "x"), ("b", 2, "y")], [("a", 2, "x"), ("c", 20, "z")]])
    q = L.run_available(L.deliveries(stream, "t", "3 days", ["k"]), str(tmp_path / "out"), str(tmp_path / "c1"))
    q.awaitTermination(120)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
    again = L.run_available(L.deliveries(stream, "t", "3 days", ["k"]), str(tmp_path / "out"), str(tmp_path / "c1"))
    again.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    counts = L.windowed_counts(stream, "t", "3 days", "7 days", ["k"]).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    counts.awaitTermination(120)
    assert sum(r["count"] for r in spark.table("counts").collect()) == 5
