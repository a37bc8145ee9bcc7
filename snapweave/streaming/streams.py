"""The same operators over unbounded input: device state from heartbeats, change batches, pruned feeds."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.devices import device_state

#: Changes of one folder held at most; beyond that the batch asks for a rescan.
MOST_PENDING = 50_000


def device_states(heartbeats: DataFrame, table: str, checkpoint: str):
    """Keep the latest state per device in a Parquet folder, batch by batch: the new states replace the old ones.

    Last arrival wins by (at, heartbeat_id); writing a batch again gives the same table.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = device_state(batch)
        out = f"{table}/batch={batch_id:010d}"
        if batch_id:
            old = spark.read.parquet(f"{table}/batch={batch_id - 1:010d}")
            both = old.unionByName(fresh)
            newest = F.struct("last_seen", "state", "queued_files")
            fresh = both.groupBy("device_id").agg(F.max_by("state", newest).alias("state"), F.max_by("agent_version", F.when(F.col("agent_version").isNotNull(), newest)).alias("agent_version"), F.max("last_seen").alias("last_seen"), F.max_by("queued_files", newest).alias("queued_files"), F.max_by("last_error", newest).alias("last_error"))
        fresh.write.mode("overwrite").parquet(out)

    return heartbeats.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)


def change_batches(changes: DataFrame, seconds: int = 15, late: str = "1 minute") -> DataFrame:
    """changes (root, path, removed, is_dir, at) -> root, opened_at, path, removed, is_dir, rescan.

    A batch opens with a folder's first change and closes `seconds` later; the last change per path counts.
    More than MOST_PENDING paths give one row that asks for a rescan. Event time and a watermark stand in for
    the wall clock of a single machine: they decide when a quiet folder's batch is handed on.
    """
    width = seconds * 1000

    def close(root: str, opened: int, paths: dict) -> list[tuple]:
        if len(paths) > MOST_PENDING:
            return [(root, pd.Timestamp(opened, unit="ms"), None, None, None, True)]
        return [(root, pd.Timestamp(opened, unit="ms"), p, r, d, False) for p, (r, d) in sorted(paths.items())]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, paths = (state.get[0], json.loads(state.get[1])) if state.exists else (None, {})
        rows: list[tuple] = []
        if state.hasTimedOut:
            rows, opened, paths = close(key[0], opened, paths), None, {}
            state.remove()
        else:
            # one trigger's changes of one folder; they must be put in order
            frame = pd.concat(list(frames)).sort_values(["at", "path"])
            for at, path, removed, is_dir in zip((frame["at"].astype("int64") // 10 ** (6 if str(frame["at"].dtype).startswith("datetime64[ns") else 3)).tolist(), frame["path"], frame["removed"], frame["is_dir"]):
                if opened is not None and at >= opened + width:
                    rows += close(key[0], opened, paths)
                    opened, paths = None, {}
                if opened is None:
                    opened = at
                if len(paths) <= MOST_PENDING:
                    paths[path] = (bool(removed), bool(is_dir))
            state.update((opened, json.dumps(paths)))
            state.setTimeoutTimestamp(max(opened + width, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["root", "opened_at", "path", "removed", "is_dir", "rescan"])

    timed = changes.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("root").applyInPandasWithState(step, "root string, opened_at timestamp, path string, removed boolean, is_dir boolean, rescan boolean", "opened long, paths string", "append", GroupStateTimeout.EventTimeTimeout)


def change_sessions(changes: DataFrame, seconds: int = 15, late: str = "1 minute") -> DataFrame:
    """The documented intent: batches that end when a folder has been quiet."""
    timed = changes.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    s = timed.groupBy("root", F.session_window("at", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("changes"))
    return s.select("root", F.col("w.start").alias("started_at"), F.col("w.end").alias("quiet_at"), "changes")
