"""Queries over the sample tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import content, devices, diff, folds, retention, rules, store, tree
from .domain import EVENTS_NOW, NOW, domain, with_domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_now, _events_now = datetime.fromisoformat(NOW), datetime.fromisoformat(EVENTS_NOW)


def query(name: str, sql: str | None = None):
    """Register a query; it gets a function that loads tables by name."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir, f=f: f(lambda n, made={}: domain(spark, sf_dir, n))
        if sql:
            ORACLE[name] = with_domain(sql)
        return f

    return add


# --- versioned trees ---------------------------------------------------------------------------------------

_CHAIN = """WITH RECURSIVE walk AS (
  SELECT snapshot_id AS tip, snapshot_id, parent_id, kind, 0 AS depth FROM {trees}
  UNION ALL SELECT w.tip, p.snapshot_id, p.parent_id, p.kind, w.depth + 1 FROM walk w JOIN {trees} p ON w.parent_id = p.snapshot_id WHERE w.kind <> 'full'),
bases AS (SELECT tip, MIN(depth) AS base FROM walk WHERE kind = 'full' GROUP BY tip),
chain AS (SELECT w.tip, w.snapshot_id, b.base - w.depth AS seq FROM walk w JOIN bases b ON w.tip = b.tip WHERE w.depth <= b.base),
newest AS (SELECT c.tip, e.path, MAX(c.seq) AS seq FROM {entries} e JOIN chain c ON e.snapshot_id = c.snapshot_id GROUP BY c.tip, e.path),
gone AS (SELECT c.tip, x.path, MAX(c.seq) AS seq FROM {deletions} x JOIN chain c ON x.snapshot_id = c.snapshot_id GROUP BY c.tip, x.path),
tree AS (SELECT n.tip, n.path, e.type, e.size, e.digest FROM newest n JOIN chain c ON c.tip = n.tip AND c.seq = n.seq JOIN {entries} e ON e.snapshot_id = c.snapshot_id AND e.path = n.path LEFT JOIN gone g ON g.tip = n.tip AND g.path = n.path WHERE g.seq IS NULL OR g.seq < n.seq)
"""


def _trees(t) -> DataFrame:
    return tree.effective_tree(t("entries"), t("deletions"), tree.chains(t("trees")))


def _tip(t, tip: str = "en-7") -> DataFrame:
    # only the tip's own chain is resolved
    snapshots = t("trees")
    return tree.effective_tree(t("entries"), t("deletions"), tree.chains(snapshots).where(F.col("tip") == tip))


query("tree_effective", _CHAIN + "SELECT tip, path, type, size, digest FROM tree")(lambda t: _trees(t).select("tip", "path", "type", "size", "digest"))
query("tree_at_tip", _CHAIN + "SELECT path, type, size, digest FROM tree WHERE tip = 'en-7'")(lambda t: _tip(t).select("path", "type", "size", "digest"))
query("tree_page_keyset", _CHAIN + "SELECT path, (SELECT COUNT(*) FROM tree WHERE tip = 'en-7' AND path > 'd3/f3.txt' AND (path = 'd3' OR (path >= 'd3/' AND path < 'd30'))) > 5 AS has_more FROM tree WHERE tip = 'en-7' AND path > 'd3/f3.txt' AND (path = 'd3' OR (path >= 'd3/' AND path < 'd30')) ORDER BY path LIMIT 5")(
    lambda t: tree.page(_tip(t), "d3", "d3/f3.txt", 5).select("path", "has_more"))
query("tree_children", _CHAIN + """, kids AS (SELECT SPLIT_PART(path, '/', 1) AS child, path, type, size, digest FROM tree WHERE tip = 'en-7')
SELECT child AS path, COALESCE(MAX(CASE WHEN path = child THEN type END), 'dir') AS type, COALESCE(MAX(CASE WHEN path = child THEN size END), 0) AS size, COALESCE(MAX(CASE WHEN path = child THEN digest END), '') AS digest, MAX(CASE WHEN path = child THEN 1 ELSE 0 END) = 0 AS synthetic FROM kids GROUP BY child""")(
    lambda t: tree.children(_tip(t)))
query("tree_children_below", _CHAIN + "SELECT path, type, size, digest, FALSE AS synthetic FROM tree WHERE tip = 'en-7' AND path LIKE 'd1-old/%' AND path > 'd1-old/f2' ORDER BY path LIMIT 3")(
    lambda t: tree.children(_tip(t), "d1-old", "d1-old/f2", 3))
query("tree_lookup", _CHAIN + "SELECT tip, size, digest FROM tree WHERE path = 'd3/f3.txt'")(lambda t: tree.entry(_trees(t), "d3/f3.txt").select("tip", "size", "digest"))
query("find_paths", _CHAIN + "SELECT path FROM tree WHERE tip = 'en-7' AND type = 'file' AND CONTAINS(LOWER(path), '-old/f4') ORDER BY path LIMIT 25")(lambda t: tree.search(_tip(t), "-OLD/F4", 25).select("path"))
query("chain_depth", _CHAIN + "SELECT tip, MAX(seq) AS depth FROM chain GROUP BY tip")(lambda t: tree.chains(t("trees")).groupBy("tip").agg(F.max("seq").alias("depth")))
query("chain_errors", """WITH RECURSIVE walk AS (SELECT snapshot_id AS tip, snapshot_id, parent_id, kind FROM {snapshots} UNION ALL SELECT w.tip, p.snapshot_id, p.parent_id, p.kind FROM walk w JOIN {snapshots} p ON w.parent_id = p.snapshot_id WHERE w.kind <> 'full')
SELECT s.snapshot_id FROM {snapshots} s WHERE s.snapshot_id NOT IN (SELECT tip FROM walk WHERE kind = 'full')""")(lambda t: tree.chain_errors(t("snapshots")))
query("file_versions", _CHAIN + """, whole AS (SELECT snapshot_id, device_id, started_at, ROW_NUMBER() OVER (PARTITION BY device_id ORDER BY started_at DESC, snapshot_id DESC) AS place FROM {trees} WHERE status = 'complete'),
files AS (SELECT DISTINCT w.device_id, t.path FROM tree t JOIN whole w ON t.tip = w.snapshot_id WHERE t.type <> 'dir'),
grid AS (SELECT f.device_id, f.path, w.snapshot_id, w.place, t.digest FROM files f JOIN whole w ON f.device_id = w.device_id LEFT JOIN tree t ON t.tip = w.snapshot_id AND t.path = f.path AND t.type <> 'dir'),
steps AS (SELECT *, LAG(digest) OVER (PARTITION BY device_id, path ORDER BY place) AS before FROM grid),
kept AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY device_id, path ORDER BY place) AS version FROM steps WHERE digest IS NOT NULL AND (before IS NULL OR before <> digest))
SELECT device_id, path, version, snapshot_id, digest AS fingerprint FROM kept WHERE version <= 3""")(
    lambda t: tree.file_versions(_trees(t).withColumn("chunks", F.array(F.col("digest"))), t("trees"), 3).select("device_id", "path", "version", "snapshot_id", "fingerprint"))
query("snapshot_latest", "SELECT device_id, snapshot_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY device_id ORDER BY started_at DESC, snapshot_id DESC) AS nth FROM {snapshots} WHERE status = 'complete') s WHERE nth = 1")(
    lambda t: tree.latest_complete(t("snapshots")).select("device_id", "snapshot_id"))
query("snapshot_list", "SELECT s.snapshot_id, s.status, COALESCE(d.name, 'Removed device') AS name FROM (SELECT * FROM {snapshots} ORDER BY started_at DESC, snapshot_id DESC LIMIT 50) s LEFT JOIN (SELECT * FROM {devices} WHERE NOT revoked) d ON s.device_id = d.device_id")(
    lambda t: tree.snapshot_list(t("snapshots"), t("devices").where("NOT revoked"), 50).select("snapshot_id", "status", "name"))
_REFS = "SELECT CASE device_id % 4 WHEN 0 THEN 'latest' WHEN 1 THEN CAST(MIN(snapshot_id) AS STRING) WHEN 2 THEN LEFT(CAST(MAX(snapshot_id) AS STRING), 2) ELSE 'x9' END AS ref, device_id FROM {snapshots} GROUP BY device_id"
query("snapshot_find", "WITH asked AS (" + _REFS + """), named AS (SELECT device_id, CAST(snapshot_id AS STRING) AS id FROM {snapshots}),
hits AS (SELECT a.ref, a.device_id, COUNT(*) AS n, MIN(n.id) AS one, MAX(CASE WHEN n.id = a.ref THEN 1 ELSE 0 END) AS exact FROM asked a JOIN named n ON a.device_id = n.device_id AND STARTS_WITH(n.id, a.ref) GROUP BY a.ref, a.device_id),
late AS (SELECT device_id, CAST(snapshot_id AS STRING) AS latest FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY device_id ORDER BY started_at DESC, snapshot_id DESC) AS nth FROM {snapshots} WHERE status = 'complete') s WHERE nth = 1),
answers AS (SELECT a.ref, a.device_id, CASE WHEN a.ref = 'latest' THEN l.latest WHEN h.exact = 1 THEN a.ref WHEN h.n = 1 THEN h.one END AS snapshot_id, COALESCE(h.n, 0) AS n FROM asked a LEFT JOIN hits h ON a.ref = h.ref AND a.device_id = h.device_id LEFT JOIN late l ON a.device_id = l.device_id)
SELECT ref, device_id, snapshot_id, CASE WHEN snapshot_id IS NOT NULL THEN '' WHEN n > 1 THEN 'ambiguous' ELSE 'not found' END AS problem FROM answers""")(
    lambda t: tree.find_snapshot(t("snapshots"), t("snapshots").groupBy("device_id").agg(F.min("snapshot_id").cast("string").alias("a"), F.max("snapshot_id").cast("string").alias("b")).select(F.when(F.col("device_id") % 4 == 0, "latest").when(F.col("device_id") % 4 == 1, F.col("a")).when(F.col("device_id") % 4 == 2, F.left("b", F.lit(2))).otherwise("x9").alias("ref"), "device_id")))
query("delta_parent_ok", "SELECT s.snapshot_id, COALESCE(p.account_id = s.account_id AND p.device_id = s.device_id AND p.status = 'complete', FALSE) AS parent_ok FROM {snapshots} s LEFT JOIN {snapshots} p ON s.parent_id = p.snapshot_id WHERE s.parent_id IS NOT NULL")(
    lambda t: tree.delta_parent_ok(t("snapshots")))
query("snapshot_open", "SELECT s.snapshot_id, CASE WHEN s.kind = 'delta' AND p.status = 'complete' THEN 'delta' ELSE 'full' END AS opened_as, CASE WHEN s.kind = 'delta' AND p.status = 'complete' THEN s.parent_id END AS parent_id FROM {snapshots} s LEFT JOIN {snapshots} p ON s.parent_id = p.snapshot_id AND p.account_id = s.account_id AND p.device_id = s.device_id AND p.snapshot_id IN (WITH RECURSIVE w AS (SELECT snapshot_id AS tip, parent_id, kind FROM {snapshots} UNION ALL SELECT w.tip, q.parent_id, q.kind FROM w JOIN {snapshots} q ON w.parent_id = q.snapshot_id WHERE w.kind <> 'full') SELECT tip FROM w WHERE kind = 'full')")(
    lambda t: tree.open_kind(t("snapshots")))
query("descendants", "WITH RECURSIVE down AS (SELECT snapshot_id AS root, snapshot_id FROM {snapshots} WHERE kind = 'full' UNION ALL SELECT d.root, s.snapshot_id FROM down d JOIN {snapshots} s ON s.parent_id = d.snapshot_id) SELECT root, snapshot_id FROM down")(
    lambda t: tree.descendants(t("snapshots"), t("snapshots").where("kind = 'full'")))

# --- blocks, usage, integrity ------------------------------------------------------------------------------

query("chunks_missing_for_snapshot", "SELECT r.snapshot_id, r.digest FROM {refs} r WHERE NOT EXISTS (SELECT 1 FROM {chunks} c WHERE c.digest = r.digest)")(lambda t: store.missing_for_snapshots(t("refs"), t("chunks")))
query("chunks_missing_request", "SELECT l_orderkey AS request_id, MIN(l_linenumber) AS place, l_partkey AS digest FROM {lineitem} WHERE l_partkey NOT IN (SELECT digest FROM {chunks}) GROUP BY l_orderkey, l_partkey")(
    lambda t: _missing_request(t))


def _missing_request(t) -> DataFrame:
    lines = t("lineitem")
    asked = lines.groupBy(F.col("l_orderkey").alias("request_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    out = store.missing_of_request(asked.select("request_id", F.col("x.l_partkey").alias("digests")), t("chunks"))
    place = asked.select("request_id", F.posexplode("x").alias("pos", "y")).select("request_id", "pos", F.col("y.l_linenumber").alias("place"))
    return out.join(place, ["request_id", "pos"]).select("request_id", "place", "digest")


query("snapshot_close", "SELECT s.snapshot_id, COUNT(m.digest) AS missing, CASE WHEN COUNT(m.digest) > 0 THEN 'failed' ELSE 'complete' END AS closes_as FROM {snapshots} s LEFT JOIN (SELECT r.* FROM {refs} r ANTI JOIN {chunks} c ON r.digest = c.digest) m ON s.snapshot_id = m.snapshot_id GROUP BY s.snapshot_id")(
    lambda t: store.close_snapshots(t("snapshots"), t("refs"), t("chunks")))
query("chunks_garbage", "SELECT digest, stored_bytes FROM {chunks} c WHERE NOT EXISTS (SELECT 1 FROM {refs} r WHERE r.digest = c.digest)")(lambda t: store.garbage(t("chunks"), t("refs")).select("digest", "stored_bytes"))
query("garbage_report", "SELECT COUNT(*) AS deleted, CAST(COALESCE(SUM(stored_bytes), 0) AS BIGINT) AS freed_bytes FROM {chunks} WHERE digest NOT IN (SELECT digest FROM {refs})")(lambda t: store.garbage_report(t("chunks"), t("refs")))
query("integrity_report", """SELECT COALESCE(i.digest, c.digest, r.digest) AS digest, CASE WHEN c.digest IS NULL AND r.digest IS NOT NULL THEN 'missing_meta' WHEN c.digest IS NULL THEN 'orphan' WHEN r.digest IS NULL THEN 'garbage' WHEN i.digest IS NULL THEN 'missing_blob' ELSE 'ok' END AS verdict
FROM {inventory} i FULL OUTER JOIN {chunks} c ON i.digest = c.digest FULL OUTER JOIN (SELECT DISTINCT digest FROM {refs}) r ON r.digest = COALESCE(i.digest, c.digest)""")(lambda t: store.integrity(t("inventory"), t("chunks"), t("refs")))
query("unrestorable", "SELECT snapshot_id, digest FROM (SELECT r.snapshot_id, r.digest, ROW_NUMBER() OVER (PARTITION BY r.snapshot_id ORDER BY r.digest) AS nth FROM {refs} r JOIN {snapshots} s ON r.snapshot_id = s.snapshot_id WHERE s.status = 'complete' AND r.digest NOT IN (SELECT c.digest FROM {chunks} c JOIN {inventory} i ON c.digest = i.digest)) x WHERE nth <= 5")(
    lambda t: store.unrestorable(t("snapshots"), t("refs"), t("chunks"), t("inventory")))
query("usage_by_account", """WITH blocks AS (SELECT s.account_id, r.digest, COUNT(*) AS times FROM {refs} r JOIN {snapshots} s ON r.snapshot_id = s.snapshot_id GROUP BY s.account_id, r.digest),
sums AS (SELECT b.account_id, COUNT(*) AS n, SUM(c.stored_bytes) AS stored, SUM(c.plain_bytes) AS plain, SUM(c.plain_bytes * b.times) AS referenced FROM blocks b JOIN {chunks} c ON b.digest = c.digest GROUP BY b.account_id)
SELECT a.account_id, a.quota_bytes, CAST(COALESCE(s.n, 0) AS BIGINT) AS chunk_count, CAST(COALESCE(s.stored, 0) AS BIGINT) AS stored_bytes, CAST(COALESCE(s.plain, 0) AS BIGINT) AS logical_bytes, CAST(COALESCE(s.referenced, 0) AS BIGINT) AS referenced_bytes,
(SELECT COUNT(*) FROM {devices} d WHERE d.account_id = a.account_id AND NOT d.revoked) AS device_count, (SELECT COUNT(*) FROM {snapshots} n WHERE n.account_id = a.account_id AND n.status = 'complete') AS snapshot_count,
CASE WHEN s.stored > 0 THEN ROUND(s.plain / s.stored, 4) ELSE 0.0 END AS compression_ratio, CASE WHEN s.stored > 0 THEN ROUND(s.referenced / s.stored, 4) ELSE 0.0 END AS dedup_ratio, CAST(GREATEST(COALESCE(s.plain, 0) - COALESCE(s.stored, 0), 0) AS BIGINT) AS saved_bytes
FROM {accounts} a LEFT JOIN sums s ON a.account_id = s.account_id""")(lambda t: store.usage(t("accounts"), t("devices"), t("snapshots"), t("refs"), t("chunks")))
query("quota_used", "SELECT account_id, CAST(SUM(stored_bytes) AS BIGINT) AS stored_bytes FROM (SELECT DISTINCT s.account_id, r.digest FROM {refs} r JOIN {snapshots} s ON r.snapshot_id = s.snapshot_id) u JOIN {chunks} c ON u.digest = c.digest GROUP BY account_id")(
    lambda t: store.stored_bytes(t("snapshots"), t("refs"), t("chunks")))
query("upload_history", "SELECT account_id, STRFTIME(started_at, '%Y-%m-%d') AS day, CAST(SUM(uploaded_bytes) AS BIGINT) AS bytes, CAST(SUM(file_count) AS BIGINT) AS files FROM {snapshots} WHERE status = 'complete' GROUP BY ALL")(lambda t: store.upload_history(t("snapshots")))
query("content_dedup", "SELECT SHA256(text) AS digest, COUNT(*) AS copies, MIN(doc_id) AS first_doc FROM {documents} WHERE text IS NOT NULL GROUP BY ALL")(
    lambda t: t("documents").where("text IS NOT NULL").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")))
query("chunks_register", "SELECT digest, created_at FROM (SELECT l_partkey AS digest, MIN(l_orderkey) AS created_at FROM {lineitem} GROUP BY l_partkey) u ANTI JOIN {chunks} c ON u.digest = c.digest")(
    lambda t: store.register_chunks(t("chunks"), t("lineitem").select(F.col("l_partkey").alias("digest"), F.col("l_orderkey").alias("created_at"), "l_quantity")).select("digest", "created_at"))
query("entries_upsert", "SELECT snapshot_id, path, size FROM (SELECT CONCAT(lang, '-', CAST(seq AS STRING)) AS snapshot_id, path, size, ROW_NUMBER() OVER (PARTITION BY lang, seq, path ORDER BY doc_id DESC) AS nth FROM {versions}) u WHERE nth = 1 UNION ALL SELECT snapshot_id, path, size FROM {entries} WHERE type = 'dir'")(
    lambda t: store.upsert_entries(t("entries").select("snapshot_id", "path", F.lit(0).cast("long").alias("size")).where(F.lit(True)), t("versions").select(F.concat("lang", F.lit("-"), F.col("seq").cast("string")).alias("snapshot_id"), "path", "size", "doc_id"), "doc_id"))
query("upload_plan", "SELECT snapshot_id, CAST(SUM(CASE WHEN known THEN 0 ELSE size END) AS BIGINT) AS uploaded_bytes, CAST(SUM(CASE WHEN known THEN size ELSE 0 END) AS BIGINT) AS deduplicated_bytes FROM (SELECT l_orderkey AS snapshot_id, CAST(l_quantity AS BIGINT) AS size, l_partkey IN (SELECT digest FROM {chunks}) AS known FROM {lineitem}) x GROUP BY snapshot_id")(
    lambda t: store.upload_plan(t("lineitem").select(F.col("l_orderkey").alias("snapshot_id"), F.col("l_quantity").cast("long").alias("size"), F.array("l_partkey").alias("chunks")), t("chunks")))

# --- retention and maintenance -----------------------------------------------------------------------------

_KEEP = f"""WITH RECURSIVE seeds AS (SELECT snapshot_id FROM (SELECT s.*, a.retention_days, ROW_NUMBER() OVER (PARTITION BY s.device_id ORDER BY s.started_at DESC, s.snapshot_id DESC) AS nth FROM {{snapshots}} s JOIN {{accounts}} a ON s.account_id = a.account_id WHERE s.status = 'complete') x
  WHERE nth = 1 OR pinned OR retention_days <= 0 OR started_at >= TIMESTAMP '{NOW}' - TO_DAYS(CAST(retention_days AS INTEGER))),
up AS (SELECT snapshot_id FROM seeds UNION SELECT s.parent_id FROM up u JOIN {{snapshots}} s ON u.snapshot_id = s.snapshot_id WHERE s.parent_id IS NOT NULL)"""
query("retention_keep", _KEEP + " SELECT snapshot_id FROM up")(lambda t: retention.keep(t("snapshots"), t("accounts"), _now))
query("retention_expired", _KEEP + ", down AS (SELECT snapshot_id FROM {snapshots} WHERE status = 'complete' AND snapshot_id NOT IN (SELECT snapshot_id FROM up) UNION SELECT s.snapshot_id FROM down d JOIN {snapshots} s ON s.parent_id = d.snapshot_id) SELECT snapshot_id FROM down")(
    lambda t: retention.expired(t("snapshots"), t("accounts"), _now))
query("stale_running", f"SELECT snapshot_id, CASE WHEN status = 'running' AND started_at < TIMESTAMP '{NOW}' - INTERVAL 6 HOUR THEN 'failed' ELSE status END AS status FROM {{snapshots}}")(lambda t: retention.fail_stale(t("snapshots"), _now).select("snapshot_id", "status"))
query("events_prune", f"SELECT event_id FROM {{feed}} WHERE \"at\" >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 20 DAY ORDER BY event_id DESC LIMIT 3000")(lambda t: retention.prune_events(t("feed"), _events_now, 20, 3000).select("event_id"))
query("events_prune_per_account", f"SELECT event_id FROM (SELECT event_id, ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY event_id DESC) AS nth FROM {{feed}} WHERE \"at\" >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 20 DAY) e WHERE nth <= 100")(
    lambda t: retention.prune_events(t("feed"), _events_now, 20, 100, per_account=True).select("event_id"))
query("expired_tokens", f"SELECT code FROM {{codes}} WHERE expires_at < TIMESTAMP '{EVENTS_NOW}'")(lambda t: retention.expired_tokens(t("codes"), _events_now).select("code"))
query("maintenance_pass", _KEEP + f""", down AS (SELECT snapshot_id FROM {{snapshots}} WHERE status = 'complete' AND snapshot_id NOT IN (SELECT snapshot_id FROM up) UNION SELECT s.snapshot_id FROM down d JOIN {{snapshots}} s ON s.parent_id = d.snapshot_id)
SELECT '1 stale_failed' AS step, COUNT(*) AS n FROM {{snapshots}} WHERE status = 'running' AND started_at < TIMESTAMP '{NOW}' - INTERVAL 6 HOUR UNION ALL SELECT '2 snapshots_expired', COUNT(*) FROM down
UNION ALL SELECT '3 chunks_deleted', COUNT(*) FROM {{chunks}} WHERE digest NOT IN (SELECT digest FROM {{refs}} WHERE snapshot_id NOT IN (SELECT snapshot_id FROM down))
UNION ALL SELECT '4 events_kept', COUNT(*) FROM {{feed}} WHERE \"at\" >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY UNION ALL SELECT '5 tokens_expired', COUNT(*) FROM {{codes}} WHERE expires_at < TIMESTAMP '{NOW}'""")(
    lambda t: retention.maintenance(t("snapshots"), t("accounts"), t("refs"), t("chunks"), t("feed"), t("codes"), _now))

# --- devices, events, queues -------------------------------------------------------------------------------

_DEVICES = f"""SELECT d.device_id, d.name, COALESCE(s.n, 0) AS snapshot_count, s.latest_id, COALESCE(s.latest_bytes, 0) AS latest_bytes, CASE WHEN d.last_error <> '' THEN 'error' WHEN s.latest_at IS NULL THEN 'never_run' WHEN s.latest_at < TIMESTAMP '{NOW}' - INTERVAL 48 HOUR THEN 'stale' ELSE 'ok' END AS health
FROM {{devices}} d LEFT JOIN (SELECT device_id, COUNT(*) AS n, ARG_MAX(snapshot_id, (started_at, snapshot_id)) AS latest_id, ARG_MAX(total_bytes, (started_at, snapshot_id)) AS latest_bytes, MAX(started_at) AS latest_at FROM {{snapshots}} WHERE status = 'complete' GROUP BY device_id) s ON d.device_id = s.device_id WHERE NOT d.revoked"""
query("device_list", _DEVICES)(lambda t: devices.device_list(t("devices"), t("snapshots"), _now).select("device_id", "name", "snapshot_count", "latest_id", "latest_bytes", "health"))
query("device_health", f"SELECT health, COUNT(*) AS devices, MIN(name) AS first_device FROM ({_DEVICES}) x GROUP BY health")(lambda t: devices.health_summary(devices.device_list(t("devices"), t("snapshots"), _now)))
query("device_state", "SELECT device_id, ARG_MAX(state, heartbeat_id) AS state, ARG_MAX(NULLIF(agent_version, ''), CASE WHEN agent_version <> '' THEN heartbeat_id END) AS agent_version, ARG_MAX(queued_files, heartbeat_id) AS queued_files, ARG_MAX(CASE WHEN CONTAINS(last_error, 'connection refused') THEN '' ELSE last_error END, heartbeat_id) AS last_error FROM {heartbeats} GROUP BY device_id")(
    lambda t: devices.device_state(t("heartbeats")).select("device_id", "state", "agent_version", "queued_files", "last_error"))
query("device_live", f"SELECT user_id AS device_id, MAX(ts) >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 180 MINUTE AS live FROM {{events}} GROUP BY user_id")(
    lambda t: devices.latest_event(t("feed")).select("device_id", devices.is_live(F.col("latest_at"), _events_now, 180).alias("live")))
query("events_feed", "SELECT f.event_id, f.level, f.message, d.name FROM (SELECT * FROM {feed} WHERE level = 'error' ORDER BY \"at\" DESC, event_id DESC LIMIT 200) f LEFT JOIN {devices} d ON f.device_id = d.device_id")(
    lambda t: devices.feed(t("feed"), t("devices"), level="error").select("event_id", "level", "message", "name"))
query("problems_filter", "SELECT event_id FROM {feed} WHERE level IN ('warn', 'error')")(lambda t: devices.problems(t("feed")).select("event_id"))
query("files_filter", "SELECT event_id FROM {feed} WHERE path <> '' OR REGEXP_MATCHES(message, '(?i)file|folder|upload|backed up')")(lambda t: devices.about_files(t("feed")).select("event_id"))
query("connectivity_class", "SELECT event_id, CONTAINS(LOWER(message), 'no such host') AS lost FROM {feed}")(lambda t: t("feed").select("event_id", devices.is_connectivity(F.col("message")).alias("lost")))
query("latest_event", "SELECT device_id, STRFTIME(MAX(\"at\"), '%Y-%m-%d %H:%M:%S') AS latest FROM {feed} GROUP BY device_id")(lambda t: devices.latest_event(t("feed")).select("device_id", F.date_format("latest_at", "yyyy-MM-dd HH:mm:ss").alias("latest")))
query("command_queue", "SELECT device_id, event_id, n FROM (SELECT device_id, event_id, ROW_NUMBER() OVER (PARTITION BY device_id ORDER BY event_id DESC) AS n FROM {feed}) q WHERE n <= 8")(lambda t: devices.newest_per_key(t("feed"), "device_id", ["event_id"], 8).select("device_id", "event_id", "n"))
query("event_ring", "SELECT account_id, event_id FROM (SELECT account_id, event_id, ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY \"at\" DESC, event_id DESC) AS n FROM {feed}) q WHERE n <= 200")(
    lambda t: devices.newest_per_key(t("feed"), "account_id", ["at", "event_id"], 200).select("account_id", "event_id"))
query("event_sampling", "SELECT device_id, event_id FROM (SELECT device_id, event_id, ROW_NUMBER() OVER (PARTITION BY device_id ORDER BY event_id) AS n FROM {feed}) q WHERE n = 1 OR n % 15 = 0")(lambda t: devices.sampled_events(t("feed"), "device_id", "event_id").select("device_id", "event_id"))
query("codes_consume", "SELECT attempt_id, nth = 1 AND a.\"at\" < expires_at AS accepted FROM (SELECT e.event_id AS attempt_id, e.ts AS \"at\", c.expires_at, ROW_NUMBER() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS nth FROM {events} e JOIN {codes} c ON e.user_id = c.code) a")(
    lambda t: devices.consume_codes(t("events").select(F.col("event_id").alias("attempt_id"), F.col("user_id").alias("code"), F.col("ts").alias("at")), t("codes")))
query("events_store", "SELECT event_id, level, LEFT(message, 8) AS message FROM {feed}")(lambda t: devices.add_events(t("feed"), 8, 4).select("event_id", "level", "message"))
query("policy_overlay", "SELECT account_id, CASE WHEN retention_days > 0 THEN retention_days ELSE 30 END AS retention_days, CASE WHEN quota_bytes > 0 THEN quota_bytes ELSE 1000000 END AS quota_bytes FROM {accounts}")(
    lambda t: t("accounts").select("account_id", devices.policy(F.col("retention_days"), F.lit(30)).alias("retention_days"), devices.policy(F.col("quota_bytes"), F.lit(1_000_000)).alias("quota_bytes")))
query("governor_verdict", "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'fullscreen' WHEN event_id % 7 = 0 THEN 'metered' WHEN event_id % 3 = 0 AND event_id % 100 < 20 THEN 'battery floor' WHEN value > 70 THEN 'cpu' ELSE '' END AS reason, NOT (event_id % 11 = 0 OR event_id % 7 = 0 OR (event_id % 3 = 0 AND event_id % 100 < 20) OR value > 70) AS allowed FROM {events}")(
    lambda t: devices.governor(t("events").select("event_id", (F.col("event_id") % 11 == 0).alias("fullscreen"), (F.col("event_id") % 7 == 0).alias("metered"), F.lit(True).alias("battery_present"), (F.col("event_id") % 3 != 0).alias("charging"), (F.col("event_id") % 100).alias("battery_pct"), F.col("value").alias("cpu_percent")), {"pause_while_fullscreen": True, "pause_on_metered": True, "min_battery_percent": 20, "max_cpu_percent": 70}).select("event_id", "reason", "allowed"))
query("agent_headline", f"SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'agent_stopped' WHEN event_id % 9 = 0 THEN 'paused' WHEN event_type = 'click' THEN 'working' WHEN event_type = 'error' THEN 'error' WHEN value < 3 THEN 'never_run' WHEN ts < TIMESTAMP '{EVENTS_NOW}' - INTERVAL 48 HOUR THEN 'stale' ELSE 'protected' END AS health FROM {{events}}")(
    lambda t: t("events").select("event_id", devices.headline(F.col("event_id") % 10 != 0, F.col("event_id") % 9 == 0, F.when(F.col("event_type") == "click", "scanning").otherwise("idle"), F.when(F.col("event_type") == "error", "x").otherwise(""), F.when(F.col("value") >= 3, F.col("ts")), _events_now).alias("health")))
query("backup_kind", "SELECT snapshot_id, CASE WHEN status = 'running' OR parent_id IS NULL OR nth >= 4 THEN 'full' ELSE 'delta' END AS kind FROM (SELECT s.*, n.nth % 5 AS nth FROM {snapshots} s JOIN {numbered} n ON s.snapshot_id = n.snapshot_id) x")(
    lambda t: t("snapshots").join(t("numbered").select("snapshot_id", (F.col("nth") % 5).alias("chain")), "snapshot_id").select("snapshot_id", devices.backup_kind(F.col("status") == "running", F.col("parent_id"), F.col("chain"), 4).alias("kind")))

query("devices_with_backup", "SELECT s.device_id, COALESCE(d.name, 'Removed device') AS name FROM (SELECT DISTINCT device_id FROM {snapshots} WHERE status = 'complete') s LEFT JOIN {devices} d ON s.device_id = d.device_id AND NOT d.revoked")(
    lambda t: devices.with_backup(t("snapshots"), t("devices").where("NOT revoked")).select("device_id", "name"))
query("run_counters", "SELECT snapshot_id, COUNT(CASE WHEN type = 'file' THEN 1 END) AS files, COUNT(CASE WHEN type = 'dir' THEN 1 END) AS dirs, CAST(SUM(size) AS BIGINT) AS bytes FROM {entries} GROUP BY snapshot_id")(lambda t: store.run_counters(t("entries")))
query("chunks_known", "SELECT DISTINCT l_partkey AS digest, l_partkey IN (SELECT digest FROM {chunks}) AS found FROM {lineitem}")(lambda t: store.lookup(t("chunks"), t("lineitem").select(F.col("l_partkey").alias("digest")), "digest"))
query("account_first", "SELECT account_id, (SELECT COUNT(*) FROM {accounts}) AS accounts FROM {accounts} ORDER BY account_id LIMIT 1")(
    lambda t: t("accounts").orderBy("account_id").limit(1).select("account_id").crossJoin(t("accounts").agg(F.count(F.lit(1)).alias("accounts"))))
query("codes_outstanding", f"SELECT code, CASE WHEN code % 3 = 0 THEN 'used' WHEN expires_at < TIMESTAMP '{EVENTS_NOW}' THEN 'expired' ELSE 'open' END AS state FROM {{codes}} ORDER BY code DESC LIMIT 50")(
    lambda t: devices.outstanding_codes(t("codes").withColumn("created_at", F.col("code")).withColumn("used_at", F.when(F.col("code") % 3 == 0, F.lit(1))), _events_now).select("code", "state"))

# --- change detection and rules ----------------------------------------------------------------------------

_STAMP = lambda c: F.timestamp_seconds(F.col(c))
query("scan_diff", "SELECT COALESCE(s.path, i.path) AS path, CASE WHEN s.path IS NULL THEN 'deleted' WHEN i.path IS NULL THEN 'new' WHEN s.size = i.size AND s.stamp = i.stamp AND (i.held OR s.size = 0) THEN 'unchanged' ELSE 'changed' END AS status FROM {scan} s FULL OUTER JOIN {index_files} i ON s.path = i.path")(
    lambda t: diff.scan_diff(t("scan").withColumn("mtime", _STAMP("stamp")), t("index_files").withColumn("mtime", _STAMP("stamp")).withColumn("chunks", F.when(F.col("held"), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))))
query("index_stats", "SELECT COUNT(*) AS files, CAST(SUM(size) AS BIGINT) AS bytes FROM {index_files}")(lambda t: diff.index_stats(t("index_files")))
query("index_stale", "SELECT path FROM {index_files} WHERE generation < 2 ORDER BY path LIMIT 40")(lambda t: diff.stale_paths(t("index_files"), 2, 40))
query("index_under", "SELECT path FROM {index_files} WHERE STARTS_WITH(path, 'en/')")(lambda t: diff.paths_under(t("index_files"), "en"))
query("index_without_tree", "SELECT path, size FROM {index_files} WHERE NOT STARTS_WITH(path, 'en/')")(lambda t: diff.without_tree(t("index_files"), "en").select("path", "size"))
query("delta_build", "SELECT path, 'delete' AS action FROM {index_files} WHERE STARTS_WITH(path, 'de/') UNION SELECT 'de', 'delete' UNION SELECT path, 'upload' FROM {scan} WHERE NOT STARTS_WITH(path, 'de/')")(
    lambda t: diff.delta(t("scan").where("NOT startswith(path, 'de/')").select("path", F.lit(False).alias("removed"), F.lit(False).alias("is_dir"), F.lit(1).alias("at")).unionByName(t("scan").limit(1).select(F.lit("de").alias("path"), F.lit(True).alias("removed"), F.lit(True).alias("is_dir"), F.lit(2).alias("at"))), t("index_files")))
query("roots_diff", "SELECT DISTINCT lang AS path, 'new' AS status FROM {documents} WHERE doc_id % 8 = 0 AND lang NOT IN ('en', 'xx') UNION ALL SELECT 'xx', 'dropped'")(
    lambda t: diff.roots_diff(t("documents").where("doc_id % 8 = 0").select(F.col("lang").alias("path")).distinct(), t("documents").limit(1).select(F.explode(F.array(F.lit("en"), F.lit("xx"))).alias("path"))))
_RULE = "CASE page_id % 6 WHEN 0 THEN 'node_modules/' WHEN 1 THEN '.git/' WHEN 2 THEN 'Thumbs.db' WHEN 3 THEN '*.iso' WHEN 4 THEN '**/AppData/Local/Temp/' ELSE '' END"
query("rules_default", f"SELECT page_id, page_id % 6 <> 5 AS skip, {_RULE} AS rule FROM {{web_paths}}")(lambda t: rules.decide(t("web_paths").withColumn("is_dir", F.lit(False))).select("page_id", "skip", "rule"))
query("rules_first_match", f"SELECT page_id, CASE WHEN page_id % 6 IN (3, 5) THEN size > 6000 ELSE TRUE END AS skip, CASE WHEN page_id % 6 = 2 THEN 'Thumb?.db' WHEN page_id % 6 IN (3, 5) THEN CASE WHEN size > 6000 THEN 'max-file-size' ELSE '' END ELSE {_RULE} END AS rule FROM {{web_paths}}")(
    lambda t: rules.decide(t("web_paths").withColumn("is_dir", F.lit(False)), include=["!*.iso"], exclude=["Thumb?.db"], max_file_size=6000).select("page_id", "skip", "rule"))
query("rules_hidden", f"SELECT page_id, CASE WHEN page_id % 6 = 1 THEN 'hidden' ELSE {_RULE} END AS rule FROM {{web_paths}}")(lambda t: rules.decide(t("web_paths").withColumn("is_dir", F.lit(False)), skip_hidden=True).select("page_id", "rule"))
query("skip_reasons", "SELECT CASE page_id % 6 WHEN 0 THEN 'reinstallable with npm install' WHEN 1 THEN 'Git object store; source files are backed up, history lives on the remote' WHEN 2 THEN 'Windows thumbnail cache' WHEN 3 THEN 'optical disc image, usually re-downloadable' ELSE 'Windows user temp' END AS reason, COUNT(*) AS n FROM {web_paths} WHERE page_id % 6 <> 5 GROUP BY ALL ORDER BY n DESC, reason LIMIT 5")(
    lambda t: rules.skip_reasons(rules.decide(t("web_paths").withColumn("is_dir", F.lit(False)))))
_PROJECT = "CONCAT(lang, '/p', CAST(doc_id % 5 AS STRING))"
query("projects_detect", f"SELECT root, CASE WHEN MAX(go) = 1 AND MAX(node) = 1 THEN 'go' WHEN MAX(go) = 1 THEN 'go' ELSE 'node' END AS kind, CASE WHEN MAX(go) = 1 AND MAX(node) = 1 THEN 'go.mod, package.json' WHEN MAX(go) = 1 THEN 'go.mod' ELSE 'package.json' END AS marker FROM (SELECT {_PROJECT} AS root, CASE WHEN doc_id % 9 = 1 THEN 1 ELSE 0 END AS go, CASE WHEN doc_id % 9 = 2 THEN 1 ELSE 0 END AS node FROM {{documents}} WHERE doc_id % 5 < 3) x WHERE go = 1 OR node = 1 GROUP BY root")(
    lambda t: rules.detect_projects(_project_files(t)).select("root", "kind", "marker"))
query("rules_project", f"SELECT doc_id, doc_id % 9 IN (3, 4) AND {_PROJECT} IN (SELECT {_PROJECT} FROM {{documents}} WHERE doc_id % 5 < 3 AND doc_id % 9 IN (1, 2)) AS skip FROM {{documents}} WHERE doc_id % 9 <> 0")(
    lambda t: rules.decide(_project_files(t).withColumn("is_dir", F.lit(False)), projects=rules.detect_projects(_project_files(t)), disabled=("ephemeral",)).select("doc_id", "skip"))


def _project_files(t) -> DataFrame:
    k = F.col("doc_id") % 9
    name = F.when((k == 1) & (F.col("doc_id") % 5 < 3), "go.mod").when((k == 2) & (F.col("doc_id") % 5 < 3), "package.json").when(k == 3, "build/a.js").when(k == 4, "vendor/x/y.go").otherwise("src/main.txt")
    return t("documents").where(k != 0).select("doc_id", F.concat("lang", F.lit("/p"), (F.col("doc_id") % 5).cast("string"), F.lit("/"), name).alias("path"))


query("rules_listing", "SELECT 149 AS rules, 5 AS categories")(lambda t: rules.rules_listing(t("region").sparkSession).agg(F.count(F.lit(1)).cast("int").alias("rules"), F.countDistinct("category").cast("int").alias("categories")))
query("system_paths", "SELECT page_id, page_id % 3 = 0 AS is_system, page_id % 3 = 0 AND page_id % 2 = 1 AS forbidden_root FROM {pages}")(
    lambda t: rules.system_paths(t("pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.when(F.col("page_id") % 2 == 1, "/usr/lib/x").otherwise("/mnt/disk")).otherwise("/home/a").alias("path"), F.lit("/home").alias("root"))).select("page_id", "is_system", "forbidden_root"))
query("root_for", "SELECT path, CASE WHEN STARTS_WITH(path, 'en/f1') THEN 'en' ELSE SPLIT_PART(path, '/', 1) END AS root FROM {scan} WHERE STARTS_WITH(path, 'en/') OR STARTS_WITH(path, 'de/')")(
    lambda t: rules.root_for(t("scan").select("path"), t("region").limit(1).select(F.explode(F.array(F.struct(F.lit("en").alias("root"), F.lit("E").alias("name")), F.struct(F.lit("de").alias("root"), F.lit("D").alias("name")), F.struct(F.lit("en/f").alias("root"), F.lit("F").alias("name")))).alias("r")).select("r.*")).select("path", "root"))

# --- paths and texts ---------------------------------------------------------------------------------------

query("path_clean", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL WHEN page_id % 4 = 1 THEN 'a/b' ELSE CONCAT('x', CAST(page_id AS STRING)) END AS path FROM {pages}")(
    lambda t: t("pages").select("page_id", paths.clean(F.when(F.col("page_id") % 4 == 0, "a/../b").when(F.col("page_id") % 4 == 1, "/a\\b/").otherwise(F.concat(F.lit("/x"), F.col("page_id").cast("string")))).alias("path")))
query("path_parent", "SELECT path, CASE WHEN CONTAINS(path, '/') THEN REGEXP_REPLACE(path, '/[^/]*$', '') ELSE '' END AS parent, REGEXP_EXTRACT(path, '[^/]*$') AS base FROM {versions}")(lambda t: t("versions").select("path", paths.parent(F.col("path")).alias("parent"), paths.base_name(F.col("path")).alias("base")))
query("safe_path", "SELECT page_id, page_id % 3 = 2 AS safe FROM {pages}")(lambda t: t("pages").select("page_id", paths.is_safe(F.when(F.col("page_id") % 3 == 0, "a/Con.txt").when(F.col("page_id") % 3 == 1, "../a").otherwise("a/console.txt")).alias("safe")))
query("archive_manifest", _CHAIN + "SELECT CASE WHEN type = 'dir' THEN CONCAT(path, '/') ELSE path END AS name, CASE WHEN type = 'dir' THEN 'store' ELSE 'deflate' END AS method, size FROM tree WHERE tip = 'en-7'")(
    lambda t: _tip(t).select(text.archive_member(F.col("path"), F.col("type"), F.col("size")).alias("m"), "size").select("m.name", "m.method", "size"))
query("human_bytes", "SELECT n_nationkey AS k, CASE WHEN n_nationkey = 0 THEN '0 B' ELSE CASE WHEN n_nationkey < 10 THEN CONCAT(CAST(n_nationkey AS STRING), '.0 MB') ELSE CONCAT(CAST(n_nationkey AS STRING), ' MB') END END AS shown FROM {nation}")(
    lambda t: t("nation").select(F.col("n_nationkey").alias("k"), text.human_bytes(F.col("n_nationkey").cast("long") * (1 << 20)).alias("shown")))
query("parse_bytes", "SELECT n_nationkey AS k, CASE n_nationkey % 3 WHEN 0 THEN CAST(n_nationkey AS BIGINT) * 1048576 WHEN 1 THEN CAST(n_nationkey AS BIGINT) * 1000 END AS bytes FROM {nation}")(
    lambda t: t("nation").select(F.col("n_nationkey").alias("k"), text.parse_bytes(F.concat(F.col("n_nationkey").cast("string"), F.element_at(F.array(F.lit(" MiB"), F.lit("kb"), F.lit(" apples")), F.col("n_nationkey") % 3 + 1))).alias("bytes")))

# --- device and store updates, events of a watcher -----------------------------------------------------------

_asked = lambda t, n: t("devices").select("device_id", (F.col("account_id") + F.when(F.col("device_id") % n == 0, 0).otherwise(1)).alias("account_id"), F.concat(F.lit("new "), F.col("name")).alias("name"))
query("devices_renamed", "SELECT device_id, CASE WHEN device_id % 3 = 0 THEN CONCAT('new ', name) ELSE name END AS name FROM {devices}")(
    lambda t: devices.rename_devices(t("devices"), _asked(t, 3)).select("device_id", "name"))
query("devices_revoked", "SELECT device_id, name, revoked OR device_id % 4 = 0 AS revoked FROM {devices}")(
    lambda t: devices.revoke_devices(t("devices"), _asked(t, 4)).select("device_id", "name", "revoked"))
query("devices_deleted", "SELECT d.device_id, COUNT(s.snapshot_id) AS snapshots FROM {devices} d JOIN {snapshots} s ON s.device_id = d.device_id WHERE d.device_id % 5 <> 0 GROUP BY d.device_id")(
    lambda t: (lambda left: left[0].select("device_id").join(left[1], "device_id").groupBy("device_id").agg(F.count("snapshot_id").alias("snapshots")))(devices.delete_devices(t("devices"), _asked(t, 5), t("snapshots"))))
query("snapshots_pinned", "SELECT snapshot_id, pinned OR snapshot_id % 6 = 0 AS pinned FROM {snapshots}")(
    lambda t: store.pin_snapshots(t("snapshots"), t("snapshots").select("snapshot_id", (F.col("account_id") + F.when(F.col("snapshot_id") % 6 == 0, 0).otherwise(1)).alias("account_id"), F.lit(True).alias("pinned"))).select("snapshot_id", "pinned"))
query("chunk_rows_deleted", "SELECT digest, stored_bytes FROM {chunks} WHERE digest % 7 <> 0")(
    lambda t: store.delete_chunks(t("chunks"), t("chunks").where("digest % 7 = 0")).select("digest", "stored_bytes"))
query("errors_cleared", """SELECT heartbeat_id, CASE WHEN heartbeat_id % 3 = 0 AND heartbeat_id % 5 < 2 THEN 'idle' WHEN heartbeat_id % 3 = 0 THEN 'error' ELSE 'idle' END AS state,
CASE WHEN heartbeat_id % 3 = 0 AND heartbeat_id % 5 < 2 THEN '' ELSE CASE heartbeat_id % 5 WHEN 0 THEN 'Dial TCP: lookup x' WHEN 1 THEN 'device is no longer authorised' ELSE 'quota' END END AS message,
CASE WHEN heartbeat_id % 4 = 0 OR (heartbeat_id % 3 = 0 AND heartbeat_id % 5 = 0) THEN '' ELSE last_error END AS last_error, heartbeat_id % 4 = 0 OR (heartbeat_id % 3 = 0 AND heartbeat_id % 5 < 2) AS cleared FROM {heartbeats}""")(
    lambda t: devices.clear_recovered(t("heartbeats").select("heartbeat_id", F.when(F.col("heartbeat_id") % 3 == 0, "error").otherwise("idle").alias("state"), F.when(F.col("heartbeat_id") % 5 == 0, "Dial TCP: lookup x").when(F.col("heartbeat_id") % 5 == 1, "device is no longer authorised").otherwise("quota").alias("message"), "last_error")))
query("event_filter", """SELECT event_id, CONCAT('/home/u', CAST(user_id % 3 AS STRING), '/docs/f', CAST(event_id % 11 AS STRING), '.txt') AS path, CONCAT('/home/u', CAST(user_id % 3 AS STRING)) AS root,
event_id % 5 IN (1, 2) AND NOT (user_id % 3 = 0 AND event_id % 11 < 5) AS removed, FALSE AS is_dir FROM {events} WHERE event_id % 5 <> 0 AND user_id % 3 < 2 AND event_id % 7 <> 0""")(
    lambda t: diff.event_filter(_watched(t), t("region").where("r_regionkey < 2").select(F.concat(F.lit("/home/u"), F.col("r_regionkey").cast("string")).alias("root"), F.col("r_name").alias("name")), _watched(t).where("path RLIKE '^/home/u0/docs/f[0-4][.]txt$'").select("path", F.lit(False).alias("is_dir"))))
query("text_forms", """SELECT n_nationkey AS k, CONCAT(LOWER(n_name), '@x.org') AS email, n_nationkey % 2 = 0 AS digest, CONCAT('AB1', CAST(n_nationkey AS STRING)) AS code, CAST(n_nationkey AS BIGINT) * 1000 AS millis,
n_nationkey % 3 AS digests, CONCAT('my-docs-', CAST(n_nationkey AS STRING)) AS slug, n_nationkey % 2 = 0 AS overlaps, CONCAT('a-b', CAST(n_nationkey AS STRING), '-2024-03-05-0607.zip') AS archive, CONCAT(CAST(n_nationkey + 1 AS STRING), ',000') AS counted, CONCAT('f', CAST(n_nationkey AS STRING)) AS below FROM {nation}""")(
    lambda t: _forms(t))


def _watched(t) -> DataFrame:
    """Events of a watcher: every kind of operation, ignored paths and paths outside the roots."""
    home = F.concat(F.lit("/home/u"), (F.col("user_id") % 3).cast("string"))
    path = F.when(F.col("event_id") % 7 == 0, F.concat(home, F.lit("/node_modules/a.js"))).otherwise(F.concat(home, F.lit("/docs/f"), (F.col("event_id") % 11).cast("string"), F.lit(".txt")))
    ops = F.array(F.array(F.lit("chmod")), F.array(F.lit("rename")), F.array(F.lit("remove"), F.lit("chmod")), F.array(F.lit("write"), F.lit("chmod")), F.array(F.lit("create")))
    return t("events").select("event_id", path.alias("path"), F.element_at(ops, (F.col("event_id") % 5 + 1).cast("int")).alias("ops"))


def _forms(t) -> DataFrame:
    k, s = F.col("n_nationkey"), F.col("n_nationkey").cast("string")
    lists = F.element_at(F.array(F.lit(""), F.lit('["a"]'), F.lit('["a", "b"]')), (k % 3 + 1).cast("int"))
    return t("nation").select(
        k.alias("k"), text.email(F.concat(F.lit(" "), "n_name", F.lit("@X.org "))).alias("email"), text.is_digest(F.when(k % 2 == 0, "ab" * 32).otherwise("AB" * 32)).alias("digest"),
        text.join_code(F.concat(F.lit("ab-1 "), s)).alias("code"), text.to_millis(text.from_millis(k.cast("long") * 1000)).alias("millis"), F.size(text.digests_of(lists)).alias("digests"),
        paths.root_slug(F.concat(F.lit("/home/My Docs "), s, F.lit("/"))).alias("slug"), paths.overlap(F.lit("/a/B/"), F.when(k % 2 == 0, "/A/b/c").otherwise("/a/bc")).alias("overlaps"),
        paths.archive_name(F.concat(F.lit("a:b"), s), F.lit("2024-03-05 06:07:08").cast("timestamp")).alias("archive"), text.thousands((k + 1) * 1000).alias("counted"), paths.relative(F.concat(F.lit("d/f"), s), "d").alias("below"))


# --- sequences and content ---------------------------------------------------------------------------------
# The oracles of the folds walk every key's rows by number in recursive SQL.

_NTH = "WITH RECURSIVE numbered AS (SELECT *, EPOCH_US(ts) AS us, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {events}), run AS ("
_NEXT = " FROM run r JOIN numbered x ON x.user_id = r.user_id AND x.n = r.n + 1)"
_DAY = 86_400_000_000
_open = f"r.a3 IS NULL OR r.a3 <= x.us - {3 * _DAY}"
query("attempt_limiter", _NTH + f"""SELECT event_id, user_id, n, TRUE AS allowed, us AS a1, CAST(NULL AS BIGINT) AS a2, CAST(NULL AS BIGINT) AS a3 FROM numbered WHERE n = 1
UNION ALL SELECT x.event_id, x.user_id, x.n, {_open}, CASE WHEN {_open} THEN x.us ELSE r.a1 END, CASE WHEN {_open} THEN r.a1 ELSE r.a2 END, CASE WHEN {_open} THEN r.a2 ELSE r.a3 END""" + _NEXT + " SELECT event_id AS attempt_id, allowed FROM run")(
    lambda t: folds.attempt_limiter(t("events").select(F.col("event_id").alias("attempt_id"), F.col("user_id").alias("key"), F.col("ts").alias("at")), limit=3, minutes=3 * 1440).select("attempt_id", "allowed"))
query("token_bucket", """WITH RECURSIVE numbered AS (SELECT event_id, user_id, event_id * 4000 AS us, event_id % 700 AS size, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM {events}),
run AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS sent, CAST(1000 AS DOUBLE) AS tokens, CAST(NULL AS BIGINT) AS last FROM numbered WHERE n = 1
UNION ALL SELECT user_id, n, event_id, CASE WHEN size <= 0 THEN start ELSE sent END, CASE WHEN size <= 0 THEN before ELSE LEAST(1000.0::DOUBLE, tokens + CAST(sent - start AS DOUBLE) / 1e6::DOUBLE * 1000.0::DOUBLE) - size END, CASE WHEN size <= 0 THEN last ELSE sent END
FROM (SELECT *, start + CAST(CEIL(GREATEST(0.0::DOUBLE, (size - tokens) / 1000.0::DOUBLE) * 1e6::DOUBLE) AS BIGINT) AS sent
FROM (SELECT *, CASE WHEN last IS NULL THEN before ELSE LEAST(1000.0::DOUBLE, before + CAST(start - last AS DOUBLE) / 1e6::DOUBLE * 1000.0::DOUBLE) END AS tokens
FROM (SELECT x.user_id, x.n, x.event_id, x.size, GREATEST(x.us, COALESCE(r.last, 0)) AS start, r.last, r.tokens AS before FROM run r JOIN numbered x ON x.user_id = r.user_id AND x.n = r.n + 1) a) b) c)
SELECT event_id AS transfer_id, sent AS sent_at_us FROM run WHERE n > 0""")(
    lambda t: folds.token_bucket(t("events").select(F.col("event_id").alias("transfer_id"), F.col("user_id").alias("key"), F.timestamp_micros(F.col("event_id") * 4000).alias("at"), (F.col("event_id") % 700).alias("bytes")), 1000.0).select("transfer_id", "sent_at_us"))
query("quota_gate", _NTH + """SELECT event_id, user_id, n, TRUE AS accepted, CAST(0 AS BIGINT) AS used_before, CAST(TRUNC(value) AS BIGINT) AS used FROM numbered WHERE n = 1
UNION ALL SELECT x.event_id, x.user_id, x.n, r.used < 200, r.used, r.used + CASE WHEN r.used < 200 THEN CAST(TRUNC(x.value) AS BIGINT) ELSE 0 END""" + _NEXT + " SELECT event_id AS upload_id, accepted, used_before FROM run")(
    lambda t: folds.quota_gate(t("events").select(F.col("event_id").alias("upload_id"), F.col("user_id").alias("account_id"), F.col("ts").alias("at"), F.col("value").cast("long").alias("bytes"), F.lit(200).cast("long").alias("quota_bytes")), size="bytes").select("upload_id", "accepted", "used_before"))
query("change_batches", _NTH + f"""SELECT event_id, user_id, n, us + {_DAY} AS until, CAST(1 AS BIGINT) AS batch FROM numbered WHERE n = 1
UNION ALL SELECT x.event_id, x.user_id, x.n, CASE WHEN x.us >= r.until THEN x.us + {_DAY} ELSE r.until END, r.batch + CASE WHEN x.us >= r.until THEN 1 ELSE 0 END""" + _NEXT + " SELECT event_id AS change_id, batch FROM run")(
    lambda t: folds.change_batches(t("events").select(F.col("event_id").alias("change_id"), F.col("user_id").alias("root"), F.col("ts").alias("at")), seconds=86_400).select("change_id", "batch"))
query("change_sessions", "SELECT root, COUNT(*) AS sessions, CAST(SUM(n) AS BIGINT) AS changes FROM (SELECT root, session, COUNT(*) AS n FROM (SELECT user_id % 4 AS root, SUM(CASE WHEN ts - prev < INTERVAL 300 SECOND THEN 0 ELSE 1 END) OVER (PARTITION BY user_id % 4 ORDER BY ts) AS session FROM (SELECT *, LAG(ts) OVER (PARTITION BY user_id % 4 ORDER BY ts) AS prev FROM {events}) e) s GROUP BY root, session) x GROUP BY root")(
    lambda t: folds.change_sessions(_changes(t), seconds=300).groupBy("root").agg(F.count(F.lit(1)).alias("sessions"), F.sum("changes").alias("changes")))
query("chunk_cdc", "SELECT doc_id, CAST(OCTET_LENGTH(ENCODE(text)) AS BIGINT) AS bytes FROM {documents} WHERE OCTET_LENGTH(ENCODE(text)) > 0")(
    lambda t: content.chunk(t("documents"), id_col="doc_id", content_col="text", sizes=content.Sizes(512, 2048, 8192)).groupBy("doc_id").agg(F.sum("length").alias("bytes")))
query("chunk_verify", "SELECT doc_id AS path, CASE WHEN COALESCE(LENGTH(text), 0) = 0 THEN 'ok' ELSE CASE doc_id % 5 WHEN 1 THEN 'missing_chunk' WHEN 2 THEN 'corrupt_chunk' WHEN 3 THEN 'size_mismatch' WHEN 4 THEN 'digest_mismatch' ELSE 'ok' END END AS verdict FROM {documents}")(lambda t: _verified(t))


def _changes(t) -> DataFrame:
    return t("events").select(F.col("event_id").alias("change_id"), (F.col("user_id") % 4).alias("root"), F.col("ts").alias("at"))


def _verified(t) -> DataFrame:
    docs = t("documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    cut = content.chunk(docs, sizes=content.Sizes(512, 2048, 8192))
    parts = docs.join(cut, "path").select("digest", F.substring("content", F.col("offset").cast("int") + 1, F.col("length").cast("int")).alias("content")).dropDuplicates(["digest"])
    # faults: a lost block, one whose bytes changed, a wrong size, a wrong digest
    bad = parts.sparkSession.range(1).select(F.lit("1" * 64).alias("digest"), F.lit("xx").cast("binary").alias("content"))
    fault = lambda k: (F.col("path") % 5 == k) & (F.col("size") > 0)
    files = content.file_digests(docs, cut).withColumns({
        "chunks": F.when(fault(1), F.concat("chunks", F.array(F.lit("0" * 64)))).when(fault(2), F.concat("chunks", F.array(F.lit("1" * 64)))).otherwise(F.col("chunks")),
        "digest": F.when(fault(4), F.lit("f" * 64)).otherwise(F.col("digest")), "size": F.col("size") + F.when(fault(3), 1).otherwise(0)})
    return content.verify(files, parts.unionByName(bad))
