"""Content blocks: what is missing, shared, unreferenced or lost; usage and history roll-ups; ingest of new rows.

chunks (digest, stored_bytes, plain_bytes), refs (snapshot_id, digest), snapshots (snapshot_id, account_id, status, ...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema


def references(entries: DataFrame) -> DataFrame:
    """Distinct (snapshot_id, digest) of all entries' chunks."""
    return entries.select("snapshot_id", F.explode("chunks").alias("digest")).distinct()


def missing_for_snapshots(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """References whose block is not stored."""
    return refs.join(chunks, "digest", "left_anti").select("snapshot_id", "digest")


def missing_of_request(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """requests (request_id, digests) -> request_id, pos, digest of the blocks to upload: each once, in the order asked."""
    asked = requests.select("request_id", F.posexplode("digests").alias("pos", "digest")).groupBy("request_id", "digest").agg(F.min("pos").alias("pos"))
    return asked.join(chunks.select("digest"), "digest", "left_anti").select("request_id", "pos", "digest")


def close_snapshots(snapshots: DataFrame, refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """snapshot_id, missing, closes_as: complete only if every referenced block is stored."""
    gaps = missing_for_snapshots(refs, chunks).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("missing"))
    missing = F.coalesce("missing", F.lit(0))
    return snapshots.select("snapshot_id").join(gaps, "snapshot_id", "left").select("snapshot_id", missing.alias("missing"), F.when(missing > 0, "failed").otherwise("complete").alias("closes_as"))


def garbage(chunks: DataFrame, refs: DataFrame, created_before=None) -> DataFrame:
    """Blocks no snapshot refers to, optionally only those created before a time (so uploads in flight stay)."""
    old = chunks if created_before is None else chunks.where(F.col("created_at") < F.lit(created_before))
    return old.join(refs, "digest", "left_anti")


def garbage_report(chunks: DataFrame, refs: DataFrame) -> DataFrame:
    return garbage(chunks, refs).agg(F.count(F.lit(1)).alias("deleted"), F.coalesce(F.sum("stored_bytes"), F.lit(0)).alias("freed_bytes"))


def integrity(inventory: DataFrame, chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """digest, verdict over block files, block rows and references.

    orphan: a file without row and reference; missing_meta: a referenced digest without row; missing_blob: a
    referenced row without file; garbage: a row nothing refers to; ok otherwise.
    """
    sides = (inventory.select("digest", F.lit(1).alias("f"), F.lit(0).alias("m"), F.lit(0).alias("r"))
             .unionByName(chunks.select("digest", F.lit(0).alias("f"), F.lit(1).alias("m"), F.lit(0).alias("r")))
             .unionByName(refs.select("digest", F.lit(0).alias("f"), F.lit(0).alias("m"), F.lit(1).alias("r"))))
    seen = sides.groupBy("digest").agg(F.max("f").alias("f"), F.max("m").alias("m"), F.max("r").alias("r"))
    verdict = F.when((F.col("m") == 0) & (F.col("r") == 1), "missing_meta").when(F.col("m") == 0, "orphan").when(F.col("r") == 0, "garbage").when(F.col("f") == 0, "missing_blob").otherwise("ok")
    return seen.select("digest", verdict.alias("verdict"))


def unrestorable(snapshots: DataFrame, refs: DataFrame, chunks: DataFrame, inventory: DataFrame, per_snapshot: int = schema.INTEGRITY_PER_SNAPSHOT) -> DataFrame:
    """snapshot_id, digest: up to per_snapshot lost blocks of every complete snapshot."""
    there = chunks.join(inventory, "digest", "left_semi").select("digest")
    lost = refs.join(snapshots.where("status = 'complete'").select("snapshot_id"), "snapshot_id").join(there, "digest", "left_anti")
    n = F.row_number().over(Window.partitionBy("snapshot_id").orderBy("digest"))
    return lost.select("snapshot_id", "digest", n.alias("n")).where(F.col("n") <= per_snapshot).drop("n")


def usage(accounts: DataFrame, devices: DataFrame, snapshots: DataFrame, refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per account: blocks, bytes stored and plain over distinct blocks, bytes referenced, devices, snapshots, two ratios.

    compression_ratio is plain / stored of distinct blocks; dedup_ratio counts a block once per snapshot that
    refers to it. Both are 0 where nothing is stored.
    """
    by_snapshot = refs.join(snapshots.select("snapshot_id", "account_id"), "snapshot_id").join(chunks, "digest")
    by_block = by_snapshot.groupBy("account_id", "digest").agg(F.max("stored_bytes").alias("stored"), F.max("plain_bytes").alias("plain"), F.count(F.lit(1)).alias("times"))
    sums = by_block.groupBy("account_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum("stored").alias("stored_bytes"), F.sum("plain").alias("logical_bytes"), F.sum(F.col("plain") * F.col("times")).alias("referenced_bytes"))
    n_devices = devices.where("NOT revoked").groupBy("account_id").agg(F.count(F.lit(1)).alias("device_count"))
    n_snapshots = snapshots.where("status = 'complete'").groupBy("account_id").agg(F.count(F.lit(1)).alias("snapshot_count"))
    out = accounts.select("account_id", "quota_bytes").join(sums, "account_id", "left").join(n_devices, "account_id", "left").join(n_snapshots, "account_id", "left")
    zero = out.na.fill(0, ["chunk_count", "stored_bytes", "logical_bytes", "referenced_bytes", "device_count", "snapshot_count"])
    ratio = lambda c: F.when(F.col("stored_bytes") > 0, F.round(F.col(c) / F.col("stored_bytes"), 4)).otherwise(0.0)
    return zero.select("*", ratio("logical_bytes").alias("compression_ratio"), ratio("referenced_bytes").alias("dedup_ratio"), F.greatest(F.col("logical_bytes") - F.col("stored_bytes"), F.lit(0)).alias("saved_bytes"))


def stored_bytes(snapshots: DataFrame, refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per account the bytes of the blocks its snapshots refer to."""
    used = refs.join(snapshots.select("snapshot_id", "account_id"), "snapshot_id").select("account_id", "digest").distinct()
    return used.join(chunks.select("digest", "stored_bytes"), "digest").groupBy("account_id").agg(F.sum("stored_bytes").alias("stored_bytes"))


def upload_history(snapshots: DataFrame, since=None) -> DataFrame:
    """account_id, day, bytes, files of complete snapshots; days without any have no row."""
    rows = snapshots.where("status = 'complete'")
    rows = rows if since is None else rows.where(F.col("started_at") >= F.lit(since))
    return rows.groupBy("account_id", F.date_format("started_at", "yyyy-MM-dd").alias("day")).agg(F.sum("uploaded_bytes").alias("bytes"), F.sum("file_count").alias("files"))


def upload_plan(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per snapshot: bytes to upload and bytes spared. Within a snapshot every occurrence of a missing block counts as upload."""
    used = entries.select("snapshot_id", F.explode("chunks").alias("digest"), (F.col("size") / F.size("chunks")).cast("long").alias("bytes"))
    known = used.join(chunks.select("digest", F.lit(True).alias("known")), "digest", "left")
    return known.groupBy("snapshot_id").agg(F.sum(F.when(F.col("known").isNull(), F.col("bytes")).otherwise(0)).alias("uploaded_bytes"), F.sum(F.when(F.col("known"), F.col("bytes")).otherwise(0)).alias("deduplicated_bytes"))


def register_chunks(chunks: DataFrame, uploads: DataFrame) -> DataFrame:
    """Rows to append: uploads of unknown digests, the first of each (by created_at) wins."""
    first = uploads.groupBy("digest").agg(F.min_by(F.struct(*[c for c in uploads.columns if c != "digest"]), "created_at").alias("r")).select("digest", "r.*")
    return first.join(chunks.select("digest"), "digest", "left_anti")


def upsert_entries(entries: DataFrame, updates: DataFrame, order: str) -> DataFrame:
    """One row per (snapshot_id, path): the last update by `order`, else the stored row."""
    columns = [c for c in entries.columns if c not in ("snapshot_id", "path")]
    rows = entries.select("snapshot_id", "path", F.struct(*columns).alias("row")).withColumn("_o", F.lit(None).cast(updates.schema[order].dataType))
    new = updates.select("snapshot_id", "path", F.struct(*columns).alias("row"), F.col(order).alias("_o"))
    both = rows.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy("snapshot_id", "path").agg(F.max_by("row", F.struct("_new", "_o")).alias("row")).select("snapshot_id", "path", "row.*")


def delete_cascade(gone: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Tables without the rows of the snapshots in gone (snapshot_id)."""
    return [t.join(gone.select("snapshot_id"), "snapshot_id", "left_anti") for t in tables]


def lookup(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """keys + found: point lookups of many keys at once."""
    return keys.select(key).distinct().join(rows.select(key, F.lit(True).alias("found")).distinct(), key, "left").select(key, F.coalesce("found", F.lit(False)).alias("found"))


def run_counters(entries: DataFrame, sent: DataFrame | None = None) -> DataFrame:
    """Per snapshot: files, dirs and bytes of its own entries, and what `sent` (upload_plan) says was uploaded and spared."""
    out = entries.groupBy("snapshot_id").agg(F.count_if(F.col("type") == "file").alias("files"), F.count_if(F.col("type") == "dir").alias("dirs"), F.sum("size").alias("bytes"))
    return out if sent is None else out.join(sent, "snapshot_id", "left").na.fill(0, ["uploaded_bytes", "deduplicated_bytes"])


def count_rows(tables: dict[str, DataFrame], name: str) -> int:
    """Row count of one of the known tables; anything else is refused."""
    if name not in tables:
        raise ValueError(f"no table {name!r}")
    return tables[name].count()


def pin_snapshots(snapshots: DataFrame, requests: DataFrame) -> DataFrame:
    """snapshots with the pins of requests (account_id, snapshot_id, pinned) by their owner; of several a set pin wins."""
    asked = requests.groupBy("account_id", "snapshot_id").agg(F.max("pinned").alias("_asked"))
    return snapshots.join(asked, ["account_id", "snapshot_id"], "left").withColumn("pinned", F.coalesce("_asked", "pinned")).select(*snapshots.columns)


def delete_chunks(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """chunks without the rows of gone (digest), once their bytes are deleted."""
    return chunks.join(gone.select("digest"), "digest", "left_anti")
