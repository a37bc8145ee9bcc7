"""Ordered folds per key: limiters, buckets, quota gates and change batches, where each verdict depends on the last.

Rows are dealt by key and sorted within partitions; a task walks them in order and holds only the state of the
key at hand, so a key's rows are never gathered. Within one key the order is a true sequence and can't be
split; across keys everything is parallel.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema


_ARROW = {"boolean": pa.bool_(), "long": pa.int64()}


def fold(rows: DataFrame, key: str, order: list[str], start: Callable[[], Callable], columns: list[str], out: str) -> DataFrame:
    """Rows with the columns `out` (DDL of booleans and longs). start() makes a step for one key; step(*values of columns) returns the new columns.

    Kept columns stay in Arrow, so nulls and longs above 2^53 come out as they went in; only the step's inputs
    become Python values. Rows without a key are one key.
    """
    names, types = zip(*(c.split() for c in out.split(",")))

    def walk(batches):
        last, step = None, None
        for batch in batches:
            made = []
            for k, *values in zip(*(batch.column(c).to_pylist() for c in (key, *columns))):
                if step is None or (k != last and not (k != k and last != last)):  # NaN is one key
                    last, step = k, start()
                made.append(step(*values))
            new = [pa.array([m[i] for m in made], _ARROW[t]) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    dealt = rows.repartition(F.col(key)).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(walk, f"{', '.join(f'`{n}` {t}' for n, t in rows.dtypes)}, {out}")


def _micros(rows: DataFrame, at: str) -> DataFrame:
    return rows.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp")))


def attempt_limiter(attempts: DataFrame, key: str = "key", at: str = "at", tie: str = "attempt_id", limit: int = schema.LOGIN_ATTEMPTS, minutes: int = schema.LOGIN_WINDOW_MINUTES) -> DataFrame:
    """attempts + allowed: fewer than `limit` accepted ones within the last `minutes`; refused ones don't count. Without a time: null."""
    window = minutes * 60_000_000

    def start():
        taken: deque = deque()

        def step(us):
            if us is None:
                return (None,)
            while taken and taken[0] <= us - window:
                taken.popleft()
            ok = len(taken) < limit
            if ok:
                taken.append(us)
            return (ok,)

        return step

    return fold(_micros(attempts, at), key, [at, tie], start, ["_us"], "allowed boolean").drop("_us")


def token_bucket(transfers: DataFrame, rate: float, key: str = "key", at: str = "at", size: str = "bytes", tie: str = "transfer_id") -> DataFrame:
    """transfers + sent_at_us: when each may go, one after the other. A second's worth is the most that is saved up; a larger transfer goes when the bucket is full. rate 0 means no limit. Without a time or size: null."""

    def start():
        state = {"tokens": float(rate), "last": None, "free": 0}

        def step(us, n):
            if us is None or n is None:
                return (None,)
            now = max(us, state["free"])
            if rate <= 0 or n <= 0:
                return (now,)
            if state["last"] is not None:
                state["tokens"] = min(rate, state["tokens"] + (now - state["last"]) / 1e6 * rate)
            need = min(float(n), rate)
            wait = max(0.0, (need - state["tokens"]) / rate)
            sent = now + int(-(-wait * 1e6 // 1))
            state["tokens"] = min(rate, state["tokens"] + (sent - now) / 1e6 * rate) - need
            state["last"] = state["free"] = sent
            return (sent,)

        return step

    return fold(_micros(transfers, at), key, [at, tie], start, ["_us", size], "sent_at_us long").drop("_us")


def quota_gate(uploads: DataFrame, key: str = "account_id", order: tuple = ("at", "upload_id"), size: str = "bytes", quota: str = "quota_bytes", default_quota: int = 0) -> DataFrame:
    """uploads + accepted, used_before: refused once the bytes accepted so far reach the quota (0: the default; none if that is 0 too). No size counts as 0."""

    def start():
        used = 0

        def step(n, limit):
            nonlocal used
            limit = int(limit or default_quota)
            before, ok = used, limit <= 0 or used < limit
            if ok:
                used += int(n or 0)
            return (ok, before)

        return step

    return fold(uploads, key, list(order), start, [size, quota], "accepted boolean, used_before long")


def change_batches(changes: DataFrame, key: str = "root", at: str = "at", tie: str = "change_id", seconds: int = 15) -> DataFrame:
    """changes + batch: a window opens with the first change after the last one closed and holds all changes for `seconds`. Without a time: null."""
    width = seconds * 1_000_000

    def start():
        state = {"until": None, "n": 0}

        def step(us):
            if us is None:
                return (None,)
            if state["until"] is None or us >= state["until"]:
                state["until"], state["n"] = us + width, state["n"] + 1
            return (state["n"],)

        return step

    return fold(_micros(changes, at), key, [at, tie], start, ["_us"], "batch long").drop("_us")


def change_sessions(changes: DataFrame, key: str = "root", at: str = "at", seconds: int = 15) -> DataFrame:
    """The documented intent: a batch ends when a folder has been quiet for `seconds`. key, started_at, ended_at, changes."""
    s = changes.groupBy(key, F.session_window(F.col(at).cast("timestamp"), f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("changes"))
    return s.select(key, F.col("w.start").alias("started_at"), F.col("w.end").alias("quiet_at"), "changes")


def last_per_path(batched: DataFrame, key: str = "root", at: str = "at", tie: str = "change_id") -> DataFrame:
    """One change per (key, batch, path): the last."""
    return batched.groupBy(key, "batch", "path").agg(F.max_by(F.struct("removed", "is_dir"), F.struct(at, tie)).alias("c")).select(key, "batch", "path", "c.removed", "c.is_dir")
