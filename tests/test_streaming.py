import datetime as dt

from pyspark.sql import functions as F

from umbra.functions.throttle import Limit
from umbra.streaming.streams import entity_windows, read_stream, redact_stream, throttle_stream


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    rows = [(k, dt.datetime(2024, 1, 1, 0, k), "a@b.org" if k % 2 else "none", 0) for k in range(20)]
    spark.createDataFrame(rows, "id long, ts timestamp, text string, ms long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), "id long, ts timestamp, text string, ms long")
    assert run(redact_stream(stream, "text"), "s1", "append").filter("text = '[REDACTED]'").count() == 10
    got = run(entity_windows(stream, "ts", "text"), "s2", "complete").orderBy("window").collect()
    assert [r["email_address"] for r in got] == [5, 5]
    late = run(throttle_stream(stream.withColumn("k", F.lit(1)), "k", "ms", Limit(4000, 15)), "s3", "append")
    assert sorted(r["delay_ms"] for r in late.collect())[14:17] == [0, 4000, 4266]
