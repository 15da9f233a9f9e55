import datetime as dt

from insumo.streaming.refresh import event_counts, upsert_offers


def test_upsert(spark, tmp_path):
    src = tmp_path / "in"
    schema = "ingest_seq long, id string, final_price double, updated_at string, ingested_at timestamp"
    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, "a", 1.0, "2024-01-01", t), (2, "b", 2.0, "2024-01-01", t)], schema).write.parquet(str(src / "1"))
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(src))
    upsert_offers(spark, stream(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(3, "a", 9.0, "2024-01-01", t)], schema).write.parquet(str(src / "2"))
    upsert_offers(spark, stream(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    last = max(p.name for p in (tmp_path / "out").iterdir())
    assert sorted((r.id, r.final_price) for r in spark.read.parquet(str(tmp_path / "out" / last)).collect()) == [("a", 9.0), ("b", 2.0)]


def test_windows(spark):
    t = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(t, "x", 1.0), (t + dt.timedelta(minutes=5), "x", 2.0), (t + dt.timedelta(hours=2), "x", 4.0)], "ts timestamp, event_type string, value double")
    assert sorted(r.total for r in event_counts(e).collect()) == [3.0, 4.0]
