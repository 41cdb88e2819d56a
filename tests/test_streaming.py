from pyspark.sql import functions as F

from tremor.operators.labels import latest_confirmed
from tremor.sources.proxies import events_from
from tremor.streaming import label_stream as S

SF_DIR = "/root/testdata/sf0.001"


def parts(spark, tmp_path):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "in")
    for k in range(3):
        events.where(f"event_id % 3 = {k} OR event_id % 50 = 0").coalesce(1).write.mode("append").parquet(folder)
    return events, folder


def test_latest_labels_follow_the_stream(spark, tmp_path):
    events, folder = parts(spark, tmp_path)
    query = S.keep_latest(S.read_events(spark, folder), str(tmp_path / "table"), str(tmp_path / "ck"), late="400 days").trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "table").iterdir())
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "table" / f"version={last}")).select("sample_pk", "id", "reason_key").collect()}
    assert got == {tuple(r) for r in latest_confirmed(events_from(events)).select("sample_pk", "id", "reason_key").collect()}


def test_windowed_counts(spark, tmp_path):
    events, folder = parts(spark, tmp_path)
    query = S.windowed_counts(S.read_events(spark, folder, 10), late="400 days").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    copies = events.union(events.where("event_id % 50 = 0")).union(events.where("event_id % 50 = 0"))
    expected = copies.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in spark.sql("SELECT * FROM counts").collect()} == {tuple(r) for r in expected.select("w.start", "event_type", "n").collect()}
