"""Streams give what tables give once their windows are closed."""

from pyspark.sql import functions as F

from tallyforge.streaming import windows


def test_tumbling_stream(spark, tmp_path):
    batch = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id * 7 AS INT)) AS ts, id % 3 AS k, CAST(id AS DOUBLE) AS v FROM range(100)")
    batch.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    out = windows.tumbling(stream, "ts", "1 hour", ["k"], F.count("*").alias("n"))
    q = out.writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("tumbled").collect()))
    assert got == sorted(map(tuple, windows.tumbling(batch, "ts", "1 hour", ["k"], F.count("*").alias("n")).collect())) and len(got) > 20


def test_repeats_within_the_watermark(spark, tmp_path):
    batch = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS ts, id % 4 AS k FROM range(20)")
    batch.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    q = windows.first_of_key(stream, ["k"], "ts").writeStream.format("memory").queryName("firsts").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == windows.first_of_key(batch, ["k"], "ts").count() == 4
