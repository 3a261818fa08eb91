"""Streaming results equal batch results on the same input."""

import random

from pyspark.sql import functions as F

from checks.registry import write_files
from policylake.operators.schedule import throttle
from policylake.sources import files
from policylake.streaming import documents as SD
from policylake.streaming.throttle import stream_throttle

from conftest import rows
from test_golden import PAGE


def drain(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_stream_documents_equals_batch(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.html").write_text(PAGE.replace("12%", f"{10 + i}%"))
    (tmp_path / "copy.html").write_text(PAGE.replace("12%", "10%"))
    out = str(tmp_path / "out")
    write = lambda docs, batch: docs.select("content_hash", "rate", F.col("relevance.score").alias("score"), "status").write.mode("overwrite").parquet(f"{out}/{batch}")
    stream = SD.read_file_stream(spark, str(tmp_path / "*.html"))
    SD.stream_documents(stream, write, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    batch = SD.recognise(files.read_files(spark, str(tmp_path / "*.html"))).select("content_hash", "rate", F.col("relevance.score").alias("score"), "status").distinct()
    assert rows(spark.read.parquet(f"{out}/*")) == rows(batch) and len(rows(batch)) == 3


def test_no_content_in_the_exchange_of_the_stream(spark, tmp_path):
    (tmp_path / "a.html").write_text(PAGE)
    narrow = SD.new_contents(SD.read_file_stream(spark, str(tmp_path)))
    assert "content" not in narrow.columns
    query = narrow.writeStream.format("memory").queryName("narrow").trigger(availableNow=True).start()
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert "Exchange hashpartitioning(content_hash" in plan and spark.table("narrow").count() == 1
    assert "content#" not in plan  # hash, path and time alone


def test_stream_throttle_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    data = [(i, f"k{i % 4}", 1_700_000_000 + i // 2 + rng.randrange(2)) for i in range(300)]
    df = spark.createDataFrame(data, "id int, k string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    for part in range(3):
        df.filter(F.col("id").between(part * 100, part * 100 + 99)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    drain(stream_throttle(stream, "k", "ts", "id", 3, 20), "throttled", "append")
    names = ("id", "window_start_us", "request_no", "allowed")
    assert rows(spark.table("throttled").select(*names)) == rows(throttle(df, "k", "ts", "id", 3, 20).select(*names))


def test_event_counts_stream(spark, tmp_path):
    df = spark.range(100).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 2).alias("kind"))
    df.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    drain(SD.stream_event_counts(stream, "ts", "10 minutes", "1 hour", ("kind",)), "counts", "complete")
    assert spark.table("counts").agg(F.sum("event_count")).first()[0] == 100 and spark.table("counts").count() == 20


def test_run_recorder(spark, tmp_path):
    sources = spark.createDataFrame([("1", 60, "daily"), ("2", None, "weekly")], "id string, interval_minutes int, frequency string").withColumns({
        c: F.lit(None).cast(t) for c, t in (("last_fetched_at", "timestamp"), ("next_fetch_at", "timestamp"), ("last_run_status", "string"), ("last_error", "string"), ("updated_at", "timestamp"))})
    outcomes = spark.createDataFrame([("1", True, None, 100), ("2", False, "boom", 200)], "source_id string, ok boolean, error string, s bigint").withColumn("at", F.timestamp_seconds("s")).drop("s")
    outcomes.write.parquet(str(tmp_path / "o"))
    target = str(tmp_path / "sources")
    recorder = SD.run_recorder(lambda: sources, lambda df, batch: df.write.mode("overwrite").parquet(f"{target}/{batch}"))
    query = SD.start_recorder(spark.readStream.schema(outcomes.schema).parquet(str(tmp_path / "o")), recorder, str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {r["id"]: r for r in spark.read.parquet(f"{target}/0").collect()}
    assert got["1"]["last_run_status"] == "success" and (got["1"]["next_fetch_at"] - got["1"]["updated_at"]).total_seconds() == 3600
    assert got["2"]["last_error"] == "boom" and got["2"]["last_fetched_at"] is None


def test_stream_throttle_over_batches_whose_windows_expire(spark, tmp_path):
    """Three micro-batches hours apart: state of the first is gone, by its timer, when the third comes."""
    rng = random.Random(5)
    data = [(100 * batch + i, f"k{i % 3}", 1_700_000_000 + batch * 7_200 + rng.randrange(60)) for batch in range(3) for i in range(90)]
    df = spark.createDataFrame(data, "id int, k string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    for batch in range(3):
        df.filter(F.col("id").between(100 * batch, 100 * batch + 99)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(stream_throttle(stream, "k", "ts", "id", 3, 20, watermark="1 minute"), "expiring", "append")
    names = ("id", "window_start_us", "request_no", "allowed", "retry_after")
    assert rows(spark.table("expiring").select(*names).fillna(-1)) == rows(throttle(df, "k", "ts", "id", 3, 20).select(*names).fillna(-1))


def test_files_of_rows_share_folders(spark, tmp_path):
    lines = [f"https://x{i % 9}.example.com/" for i in range(40)] + [None]
    write_files(spark.createDataFrame([(t,) for t in lines], "url string").coalesce(2), "url", str(tmp_path / "out"), per_folder=15)
    read = files.read_files(spark, str(tmp_path / "out"), "*.txt").collect()
    assert sorted(bytes(r["content"]).decode() for r in read) == sorted(f"{t or ''}\n" for t in lines)  # equal rows are files of their own
    assert 3 <= len({r["path"].rsplit("/", 1)[0] for r in read}) <= 4


def test_a_batch_of_small_files_is_read_in_few_tasks(spark, tmp_path):
    write_files(spark.range(300).select(F.col("id").cast("string").alias("t")), "t", str(tmp_path / "in"))
    seen = []
    write = lambda docs, batch: seen.append((docs.rdd.getNumPartitions(), docs.count()))
    SD.stream_documents(SD.read_file_stream(spark, str(tmp_path / "in")), write, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [n for _, n in seen] == [300] and seen[0][0] <= 2 * spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.files.openCostInBytes") != str(SD.SMALL_FILE)  # only the stream's copy of the session has it
