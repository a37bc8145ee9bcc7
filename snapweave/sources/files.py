"""Sources: domain tables, blob inventories and file trees, and sinks that only ever append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/{name}.parquet")


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    # the content column is never selected, so only metadata is read
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")


def blob_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """digest, size of the blocks in a store laid out as ab/cd/<digest>, on any file system or object store Spark reads."""
    digest = F.regexp_extract("path", r"/([0-9a-f]{64})$", 1)
    return _listing(spark, folder).select(digest.alias("digest"), F.col("length").alias("size")).where("digest <> ''")


def scan(spark: SparkSession, folder: str, root_name: str) -> DataFrame:
    """Files below a folder as scan rows: abs_path, path (root name and relative path), type, size, mtime to the second.

    Spark lists regular files; links and special files are not listed.
    """
    base = folder.rstrip("/")
    plain = F.regexp_replace("path", "^file:/+", "/")
    below = F.substr(plain, F.lit(len(base) + 2))
    return _listing(spark, folder).select(plain.alias("abs_path"), F.concat_ws("/", F.lit(root_name), below).alias("path"), F.lit("file").alias("type"), F.col("length").alias("size"), F.date_trunc("second", "modificationTime").alias("mtime"))


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of whole files, for the content kernels."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")


def blob_key(digest):
    """Where a block lies in a store."""
    return F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def put_blobs(blobs: DataFrame, folder: str) -> None:
    """Append blocks (digest, block) the folder lacks, each once, as Parquet partitioned by the digest's first two digits. Running it again adds nothing."""
    spark = blobs.sparkSession
    new = blobs.dropDuplicates(["digest"]).withColumn("shard", F.substring("digest", 1, 2))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path) and fs.listStatus(path):
        new = new.join(spark.read.parquet(folder).select("digest"), "digest", "left_anti")
    new.select("digest", "block", "shard").write.mode("append").partitionBy("shard").parquet(folder)


def events_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
