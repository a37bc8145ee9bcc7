"""Devices, activity feed, queues and verdicts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema

# What marks an error message as a lost connection.
CONNECTIVITY = (
    "no such host", "server misbehaving", "dial tcp", "connect: connection refused", "connection refused", "connection reset",
    "i/o timeout", "tls handshake", "tls: ", "x509:", "certificate verify", "network is unreachable",
    "temporary failure in name resolution", "name or service not known", "unexpected eof", "broken pipe",
    "http2: client connection lost", "connection timed out", "timeout awaiting response", "wsarecv", "wsasend",
    "forcibly closed", "failed to respond", "lookup ", "context deadline exceeded", "client.timeout exceeded",
)


def is_connectivity(message: Column) -> Column:
    m = F.lower(message)
    out = F.lit(False)
    for needle in CONNECTIVITY:
        out = out | F.contains(m, F.lit(needle))
    return F.coalesce(out, F.lit(False))


def health(last_error: Column, last_complete: Column, now: datetime, hours: int = schema.STALE_DEVICE_HOURS) -> Column:
    return F.when(F.coalesce(last_error, F.lit("")) != "", "error").when(last_complete.isNull(), "never_run").when(last_complete < F.lit(now - timedelta(hours=hours)), "stale").otherwise("ok")


def device_list(devices: DataFrame, snapshots: DataFrame, now: datetime) -> DataFrame:
    """Devices that aren't revoked, with their snapshot counts, latest complete snapshot and health: one aggregate instead of correlated subqueries."""
    done = F.when(F.col("status") == "complete", F.struct("started_at", "snapshot_id", "total_bytes"))
    stats = snapshots.groupBy("device_id").agg(F.count_if(F.col("status") == "complete").alias("snapshot_count"), F.max(done).alias("latest"))
    joined = devices.where("NOT revoked").join(stats, "device_id", "left")
    return joined.select(
        "device_id", "account_id", "name", F.coalesce("snapshot_count", F.lit(0)).alias("snapshot_count"), F.col("latest.snapshot_id").alias("latest_id"),
        F.col("latest.started_at").alias("latest_at"), F.coalesce("latest.total_bytes", F.lit(0)).alias("latest_bytes"), health(F.col("last_error"), F.col("latest.started_at"), now).alias("health"),
    )


def with_backup(snapshots: DataFrame, devices: DataFrame) -> DataFrame:
    """Devices with a complete snapshot, by their newest; one that was removed has no name of its own."""
    newest = snapshots.where("status = 'complete'").groupBy("device_id").agg(F.max("started_at").alias("newest"))
    return newest.join(devices.select("device_id", "name"), "device_id", "left").select("device_id", F.coalesce("name", F.lit("Removed device")).alias("name"), "newest").orderBy(F.desc("newest"), "device_id")


def health_summary(listed: DataFrame) -> DataFrame:
    return listed.groupBy("health").agg(F.count(F.lit(1)).alias("devices"), F.min("name").alias("first_device"))


def device_state(heartbeats: DataFrame) -> DataFrame:
    """Last heartbeat of each device; an empty version keeps the last one that was not empty."""
    order = F.struct("at", "heartbeat_id")
    version = F.max_by(F.nullif("agent_version", F.lit("")), F.when(F.nullif("agent_version", F.lit("")).isNotNull(), order))
    return heartbeats.groupBy("device_id").agg(F.max_by("state", order).alias("state"), version.alias("agent_version"), F.max("at").alias("last_seen"), F.max_by("queued_files", order).alias("queued_files"), F.max_by(F.when(is_connectivity(F.col("last_error")), "").otherwise(F.col("last_error")), order).alias("last_error"))


def is_live(last_seen: Column, now: datetime, minutes: int = schema.LIVE_MINUTES) -> Column:
    return F.coalesce(last_seen >= F.lit(now - timedelta(minutes=minutes)), F.lit(False))


def feed(events: DataFrame, devices: DataFrame, *, account_id=None, device_id=None, level=None, limit: int = schema.EVENT_PAGE) -> DataFrame:
    """Newest events first with the device's name, optionally of one account, device or level."""
    limit = max(1, min(limit or schema.EVENT_PAGE, schema.EVENT_PAGE_MOST))
    for column, value in (("account_id", account_id), ("device_id", device_id), ("level", level)):
        if value is not None:
            events = events.where(F.col(column) == F.lit(value))
    top = events.orderBy(F.desc("at"), F.desc("event_id")).limit(limit)
    return top.join(devices.select("device_id", "name"), "device_id", "left")


def problems(events: DataFrame) -> DataFrame:
    return events.where(F.col("level").isin("warn", "error"))


def about_files(events: DataFrame) -> DataFrame:
    """Events with a path, or whose message speaks of files or folders."""
    return events.where((F.coalesce("path", F.lit("")) != "") | F.col("message").rlike("(?i)file|folder|upload|backed up"))


def add_events(events: DataFrame, most_message: int = 2000, most_path: int = 1000) -> DataFrame:
    """Rows as they are stored: level info by default, long texts cut to whole characters within so many UTF-8 bytes."""
    level = F.coalesce(F.nullif("level", F.lit("")), F.lit("info"))
    return events.withColumn("level", level).withColumn("message", cut_bytes(F.col("message"), most_message)).withColumn("path", cut_bytes(F.col("path"), most_path))


def cut_bytes(text: Column, most: int) -> Column:
    """The longest prefix of whole characters within `most` bytes of UTF-8."""
    cut = F.regexp_replace(F.left(text, F.lit(most)), "", "")
    width = lambda c: F.octet_length(c)
    by_character = F.aggregate(F.split(cut, ""), F.struct(F.lit("").alias("s"), F.lit(False).alias("full")), lambda a, c: F.when(a["full"] | (width(a["s"]) + width(c) > most), F.struct(a["s"].alias("s"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), F.lit(False).alias("full"))))["s"]
    return F.when(F.octet_length(text) <= most, text).otherwise(by_character)


def newest_per_key(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The newest `most` rows of each key (queues and rings that drop the oldest), numbered n from the newest."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("n", n).where(F.col("n") <= most)


def latest_event(events: DataFrame) -> DataFrame:
    return events.groupBy("device_id").agg(F.max("at").alias("latest_at"))


def consume_codes(attempts: DataFrame, codes: DataFrame) -> DataFrame:
    """attempts (attempt_id, code, at) x codes (code, expires_at) -> attempt_id, accepted: the first attempt in time uses a code up."""
    order = Window.partitionBy("code").orderBy("at", "attempt_id")
    known = attempts.join(codes, "code", "left").withColumn("_valid", F.coalesce(F.col("at") < F.col("expires_at"), F.lit(False)))
    first = F.row_number().over(order) == 1
    return known.select("attempt_id", (first & F.col("_valid")).alias("accepted"))


def outstanding_codes(codes: DataFrame, now: datetime, most: int = 50) -> DataFrame:
    state = F.when(F.col("used_at").isNotNull(), "used").when(F.col("expires_at") < F.lit(now), "expired").otherwise("open")
    return codes.orderBy(F.desc("created_at"), F.desc("code")).limit(most).withColumn("state", state)


def policy(account_value: Column, default: Column) -> Column:
    """An account's own limit if it has one (over 0), else the default."""
    return F.when(account_value > 0, account_value).otherwise(default)


def governor(rows: DataFrame, limits: dict) -> DataFrame:
    """allowed and reason from fullscreen, metered, battery_present, charging, battery_pct, cpu_percent; the first reason that applies."""
    unplugged = F.col("battery_present") & ~F.col("charging")
    floor, cpu = limits.get("min_battery_percent", 0), limits.get("max_cpu_percent", 0)
    reason = (
        F.when(F.lit(limits.get("pause_while_fullscreen", False)) & F.col("fullscreen"), "fullscreen")
        .when(F.lit(limits.get("pause_on_metered", False)) & F.col("metered"), "metered")
        .when(F.lit(limits.get("pause_on_battery", False)) & unplugged, "battery")
        .when(F.lit(floor > 0) & unplugged & (F.col("battery_pct") >= 0) & (F.col("battery_pct") < floor), "battery floor")
        .when(F.lit(cpu > 0) & (F.col("cpu_percent") >= 0) & (F.col("cpu_percent") > cpu), "cpu")
        .otherwise("")
    )
    return rows.withColumn("reason", reason).withColumn("allowed", F.col("reason") == "")


def headline(running: Column, paused: Column, state: Column, last_error: Column, last_backup: Column, now: datetime) -> Column:
    """Health of an agent, worst first."""
    return (
        F.when(~running, "agent_stopped").when(paused, "paused").when(state.isin("uploading", "scanning"), "working").when(F.coalesce(last_error, F.lit("")) != "", "error")
        .when(last_backup.isNull(), "never_run").when(last_backup < F.lit(now - timedelta(hours=schema.STALE_DEVICE_HOURS)), "stale").otherwise("protected")
    )


def backup_kind(requested_full: Column, parent: Column, chain: Column, most: int = schema.AGENT_MAX_CHAIN) -> Column:
    return F.when(requested_full | parent.isNull() | (chain >= most), "full").otherwise("delta")


def sampled_events(rows: DataFrame, key: str, order: str, every: int = 15) -> DataFrame:
    """The first file of each key and every 15th after."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("n", n).where((F.col("n") == 1) | (F.col("n") % every == 0))


def clear_recovered(agents: DataFrame) -> DataFrame:
    """agents (state, message, last_error) after a heartbeat that went through, + cleared: lost connections are no longer
    true, nor is a refused enrolment; other errors (a quota) stay."""
    lost = is_connectivity(F.col("last_error"))
    failed = F.coalesce(F.col("state") == "error", F.lit(False))
    line = failed & is_connectivity(F.col("message"))
    over = line | (failed & F.coalesce(F.contains("message", F.lit("no longer authorised")), F.lit(False)))
    return agents.withColumns({
        "state": F.when(over, "idle").otherwise(F.col("state")), "message": F.when(over, "").otherwise(F.col("message")),
        "last_error": F.when(lost | line, "").otherwise(F.col("last_error")), "cleared": lost | over,
    })


_OWNED = ["account_id", "device_id"]


def create_devices(devices: DataFrame, new: DataFrame) -> DataFrame:
    """devices and those of `new` (the same columns but state) whose id is not taken; they start idle."""
    fresh = new.dropDuplicates(["device_id"]).join(devices.select("device_id"), "device_id", "left_anti")
    return devices.unionByName(fresh.withColumn("state", F.lit("idle")), allowMissingColumns=True)


def rename_devices(devices: DataFrame, requests: DataFrame, most: int = 128) -> DataFrame:
    """devices with the names of requests (account_id, device_id, name) by their owner, cut to `most` bytes; of several the greatest."""
    asked = requests.groupBy(*_OWNED).agg(F.max("name").alias("_asked"))
    return devices.join(asked, _OWNED, "left").withColumn("name", F.coalesce(cut_bytes(F.col("_asked"), most), "name")).select(*devices.columns)


def revoke_devices(devices: DataFrame, requests: DataFrame) -> DataFrame:
    """devices with those of requests (account_id, device_id) by their owner revoked; what they stored stays."""
    asked = requests.select(*_OWNED, F.lit(True).alias("_asked")).distinct()
    out = devices.join(asked, _OWNED, "left").withColumn("revoked", F.coalesce("_asked", "revoked"))
    if "state" in devices.columns:
        out = out.withColumn("state", F.when(F.col("_asked"), "revoked").otherwise(F.col("state")))
    return out.select(*devices.columns)


def delete_devices(devices: DataFrame, requests: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """devices without those of requests by their owner, and each table (device_id) without their rows."""
    gone = devices.join(requests.select(*_OWNED).distinct(), _OWNED, "left_semi").select("device_id")
    return [t.join(gone, "device_id", "left_anti") for t in (devices, *tables)]
