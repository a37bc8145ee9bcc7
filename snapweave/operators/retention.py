"""Retention that never breaks a dependent version, and the maintenance pass."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from . import store
from .tree import ancestors


def keep(snapshots: DataFrame, accounts: DataFrame, now: datetime, include_failed: bool = False) -> DataFrame:
    """(snapshot_id) to keep: the newest complete one of each device, pinned ones, those young enough or of accounts that keep forever (0 days), and all ancestors of these."""
    rows = snapshots.where(F.lit(True) if include_failed else F.col("status") == "complete").join(accounts.select("account_id", "retention_days"), "account_id")
    newest = F.row_number().over(Window.partitionBy("device_id").orderBy(F.desc("started_at"), F.desc("snapshot_id"))) == 1
    young = F.col("started_at") >= F.lit(now) - F.make_dt_interval(F.col("retention_days"))
    seeds = rows.withColumn("_newest", newest).where(F.col("_newest") | F.col("pinned") | (F.col("retention_days") <= 0) | young).select("snapshot_id")
    up = ancestors(snapshots, schema.MAX_ANCESTOR_HOPS)
    return seeds.join(up, seeds["snapshot_id"] == up["id"]).select(F.col("ancestor").alias("snapshot_id")).distinct()


def expired(snapshots: DataFrame, accounts: DataFrame, now: datetime, include_failed: bool = False) -> DataFrame:
    """(snapshot_id) that go: complete ones outside the keep set, with everything of any status that builds on them."""
    rows = snapshots.where(F.lit(True) if include_failed else F.col("status") == "complete").join(accounts.select("account_id"), "account_id")
    out = rows.join(keep(snapshots, accounts, now, include_failed), "snapshot_id", "left_anti").select(F.col("snapshot_id").alias("ancestor"))
    up = ancestors(snapshots, schema.MAX_ANCESTOR_HOPS)
    return up.join(out, "ancestor", "left_semi").select(F.col("id").alias("snapshot_id")).distinct()


def stale_running(snapshots: DataFrame, now: datetime, hours: int = schema.STALE_RUNNING_HOURS) -> DataFrame:
    return snapshots.where((F.col("status") == "running") & (F.col("started_at") < F.lit(now - timedelta(hours=hours))))


def fail_stale(snapshots: DataFrame, now: datetime, hours: int = schema.STALE_RUNNING_HOURS) -> DataFrame:
    stale = (F.col("status") == "running") & (F.col("started_at") < F.lit(now - timedelta(hours=hours)))
    return snapshots.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def prune_events(events: DataFrame, now: datetime, days: int = schema.EVENT_RETENTION_DAYS, most: int | None = schema.EVENT_MOST_ROWS, per_account: bool = False) -> DataFrame:
    """Events that stay: young enough, then the newest `most` by id (None: all), over all accounts or of each."""
    young = events.where(F.col("at") >= F.lit(now - timedelta(days=days)))
    if most is None:
        return young
    if not per_account:
        return young.orderBy(F.desc("event_id")).limit(most)
    n = F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("event_id")))
    return young.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def expired_tokens(tokens: DataFrame, now: datetime) -> DataFrame:
    return tokens.where(F.col("expires_at") < F.lit(now))


def maintenance(snapshots, accounts, refs, chunks, events, tokens, now: datetime) -> DataFrame:
    """(step, n) of one pass, in order: stale runs, retention, garbage (seeing what retention left), events (by age alone), tokens."""
    failed = fail_stale(snapshots, now)
    gone = expired(failed, accounts, now)
    left = store.delete_cascade(gone, refs)[0]
    steps = {
        "1 stale_failed": stale_running(snapshots, now), "2 snapshots_expired": gone, "3 chunks_deleted": store.garbage(chunks, left),
        "4 events_kept": prune_events(events, now, most=None), "5 tokens_expired": expired_tokens(tokens, now),
    }
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("step"), "n") for name, df in steps.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
