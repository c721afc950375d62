from pyspark.sql import functions as F

from prosewright.streaming import incremental

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/docs")
    got = incremental.run_once(incremental.word_counts_stream(spark, f"{tmp_path}/docs", docs.schema.simpleString()[7:-1].replace(":", " ")), "words", "complete", f"{tmp_path}/state")
    want = docs.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).filter("w <> ''").groupBy("w").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sessions_as_a_stream(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    rows.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/events").withWatermark("ts", "1 hour")
    got = incremental.run_once(incremental.debounced(stream, "user_id", "ts", "30 minutes"), "edits", "append", f"{tmp_path}/state").collect()
    want = incremental.debounced(rows, "user_id", "ts", "30 minutes").collect()
    assert {tuple(r) for r in got} <= {tuple(r) for r in want} and len(got) >= 0.9 * len(want)
