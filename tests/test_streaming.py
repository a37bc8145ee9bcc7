from datetime import datetime, timedelta

from pyspark.sql import functions as F

from snapweave.operators.devices import device_state
from snapweave.operators.folds import change_batches as fold_batches
from snapweave.sources import files
from snapweave.streaming import streams

T0 = datetime(2024, 1, 1)
BEATS = "heartbeat_id long, device_id string, at timestamp, state string, agent_version string, queued_files long, last_error string"


def test_device_states_equal_the_batch(spark, tmp_path):
    rows = [(i, f"d{i % 3}", T0 + timedelta(seconds=i), f"s{i}", "" if i % 2 else f"v{i}", i, "connection refused" if i % 4 == 0 else "") for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], BEATS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(BEATS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = streams.device_states(stream, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    last = sorted((tmp_path / "out").iterdir())[-1]
    got = sorted(map(tuple, spark.read.parquet(str(last)).select("device_id", "state", "agent_version", "queued_files", "last_error").collect()))
    want = sorted(map(tuple, device_state(spark.createDataFrame(rows, BEATS)).select("device_id", "state", "agent_version", "queued_files", "last_error").collect()))
    assert got == want


def test_change_batches_equal_the_fold(spark, tmp_path):
    ddl = "change_id long, root string, path string, removed boolean, is_dir boolean, at timestamp"
    times = [0, 5, 14, 16, 29, 31, 100, 101, 400]
    rows = [(i, "r", f"p{i % 4}", i % 2 == 0, False, T0 + timedelta(seconds=s)) for i, s in enumerate(times)]
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    # a later change of another folder moves the watermark so that the last batch is handed on
    spark.createDataFrame([(99, "other", "x", False, False, T0 + timedelta(hours=2))], ddl).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = streams.change_batches(stream).writeStream.format("memory").queryName("batches").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("batches").where("root = 'r'").groupBy("opened_at").agg(F.count(F.lit(1)).alias("n")).orderBy("opened_at").collect()
    folded = fold_batches(spark.createDataFrame(rows, ddl)).groupBy("batch").agg(F.countDistinct("path").alias("n")).orderBy("batch").collect()
    assert [r["n"] for r in got] == [r["n"] for r in folded][: len(got)] and len(got) >= len(folded) - 1


def test_sources(spark, tmp_path):
    digest = "ab" * 32
    (tmp_path / "store/ab/ab").mkdir(parents=True)
    (tmp_path / f"store/ab/ab/{digest}").write_bytes(b"12345")
    (tmp_path / "store/ab/ab/tmp-1").write_bytes(b"x")
    assert [tuple(r) for r in files.blob_inventory(spark, f"{tmp_path}/store").collect()] == [(digest, 5)]
    (tmp_path / "docs/a").mkdir(parents=True)
    (tmp_path / "docs/a/x.txt").write_text("hi")
    got = files.scan(spark, f"{tmp_path}/docs", "Docs").first()
    assert (got["path"], got["size"], got["type"]) == ("Docs/a/x.txt", 2, "file")
    blocks = spark.createDataFrame([(digest, b"1"), (digest, b"1"), ("cd" * 32, b"2")], "digest string, block binary")
    for _ in range(2):
        files.put_blobs(blocks, f"{tmp_path}/blocks")
    assert spark.read.parquet(f"{tmp_path}/blocks").count() == 2
