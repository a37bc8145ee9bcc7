"""Domain tables derived from the sample tables, in SQL that Spark and DuckDB both run.

The derivations fill every branch of the operators: there are dangling references, unreferenced blocks, lost
files, tombstones of the same age as an entry, revived paths, broken chains and expired codes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import table

#: The time queries are asked at.
NOW, EVENTS_NOW = "2001-08-02 00:00:00", "2024-01-31 00:00:00"

DOMAIN = {
    "accounts": "SELECT CAST(n_nationkey AS BIGINT) AS account_id, n_name AS email, n_nationkey % 4 * 400 AS retention_days, CAST(n_nationkey % 3 * 400000 AS BIGINT) AS quota_bytes FROM {nation}",
    "devices": "SELECT c_custkey AS device_id, CAST(c_nationkey AS BIGINT) AS account_id, c_name AS name, c_acctbal < 0 AS revoked, CASE WHEN c_custkey % 11 = 0 THEN 'disk error' ELSE '' END AS last_error FROM {customer}",
    "numbered": "SELECT o_orderkey AS snapshot_id, o_custkey AS device_id, o_orderdate AS started_at, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, CAST(ROUND(o_totalprice) AS BIGINT) AS total_bytes, o_orderpriority = '1-URGENT' AND o_orderkey % 7 = 0 AS pinned, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM {orders}",
    "snapshots": "SELECT n.snapshot_id, n.device_id, d.account_id, n.started_at, n.status, n.total_bytes, n.total_bytes % 1000 AS file_count, n.total_bytes AS uploaded_bytes, n.pinned, CASE WHEN n.nth % 5 = 1 THEN 'full' ELSE 'delta' END AS kind, CASE WHEN n.nth % 5 <> 1 THEN CASE WHEN n.snapshot_id % 97 = 0 THEN -n.previous ELSE n.previous END END AS parent_id FROM {numbered} n JOIN {devices} d ON n.device_id = d.device_id",
    "chunks": "SELECT p_partkey AS digest, CAST(p_size * 1000 AS BIGINT) AS stored_bytes, CAST(ROUND(p_retailprice) * 40 AS BIGINT) AS plain_bytes FROM {part} WHERE p_size > 3",
    "refs": "SELECT DISTINCT l_orderkey AS snapshot_id, l_partkey AS digest FROM {lineitem} WHERE l_quantity > 48",
    "inventory": "SELECT p_partkey AS digest, CAST(p_size * 1000 AS BIGINT) AS size FROM {part} WHERE p_partkey % 11 <> 0 UNION ALL SELECT -p_partkey AS digest, CAST(p_size AS BIGINT) AS size FROM {part} WHERE p_partkey % 50 = 0",
    "versions": "SELECT doc_id, lang, doc_id % 8 AS seq, CONCAT('d', CAST(doc_id % 97 % 7 AS STRING), CASE WHEN doc_id % 97 % 5 = 0 THEN '-old' ELSE '' END, '/f', CAST(doc_id % 97 AS STRING), '.txt') AS path, CAST(LENGTH(text) AS BIGINT) AS size, CONCAT('v', CAST(doc_id % 3 AS STRING)) AS digest FROM {documents}",
    "trees": "SELECT DISTINCT CONCAT(lang, '-', CAST(seq AS STRING)) AS snapshot_id, lang AS device_id, CASE WHEN seq = 0 THEN 'full' ELSE 'delta' END AS kind, CASE WHEN seq > 0 THEN CONCAT(lang, '-', CAST(seq - 1 AS STRING)) END AS parent_id, CASE WHEN seq % 4 = 2 THEN 'failed' ELSE 'complete' END AS status, seq, seq AS started_at FROM {versions}",
    "entries": "SELECT CONCAT(lang, '-', CAST(seq AS STRING)) AS snapshot_id, path, 'file' AS type, size, digest FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang, seq, path ORDER BY doc_id DESC) AS nth FROM {versions}) v WHERE nth = 1 UNION ALL SELECT DISTINCT CONCAT(lang, '-0') AS snapshot_id, CONCAT('d', CAST(doc_id % 97 % 7 AS STRING)) AS path, 'dir' AS type, CAST(0 AS BIGINT) AS size, '' AS digest FROM {versions} WHERE doc_id % 97 % 7 < 4",
    "deletions": "SELECT DISTINCT CONCAT(v.lang, '-', CAST((v.doc_id + 1) % 8 AS STRING)) AS snapshot_id, v.path FROM {versions} v JOIN {labels} l ON v.doc_id = l.doc_id WHERE l.toxic = 1 OR v.doc_id % 5 = 0",
    "feed": "SELECT event_id, user_id AS device_id, user_id % 25 AS account_id, ts AS at, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS level, CASE WHEN event_id % 13 = 0 THEN 'dial tcp: lookup host: no such host' WHEN event_id % 17 = 0 THEN 'Uploaded a File' ELSE event_type END AS message, CASE WHEN event_id % 5 = 0 THEN CONCAT('d/', CAST(event_id % 50 AS STRING)) ELSE '' END AS path FROM {events}",
    "heartbeats": "SELECT event_id AS heartbeat_id, user_id AS device_id, ts AS at, event_type AS state, CASE WHEN event_id % 3 = 0 THEN '' ELSE CONCAT('1.', CAST(event_id % 10 AS STRING)) END AS agent_version, CAST(event_id % 100 AS BIGINT) AS queued_files, CASE WHEN event_id % 4 = 0 THEN 'connection refused' WHEN event_id % 4 = 1 THEN 'quota' ELSE '' END AS last_error FROM {events}",
    "codes": "SELECT DISTINCT user_id AS code, CASE WHEN user_id % 2 = 0 THEN TIMESTAMP '2024-01-01 02:00:00' ELSE TIMESTAMP '2025-01-01 00:00:00' END AS expires_at FROM {events}",
    "scan": "SELECT CONCAT(lang, '/f', CAST(doc_id % 97 AS STRING)) AS path, CAST(MAX(doc_id) % 6 AS BIGINT) AS size, MAX(doc_id) % 5 AS stamp FROM {documents} WHERE doc_id % 8 >= 4 GROUP BY lang, doc_id % 97",
    "index_files": "SELECT CONCAT(lang, '/f', CAST(doc_id % 97 AS STRING)) AS path, CAST(MAX(doc_id) % 6 AS BIGINT) AS size, MAX(doc_id) % 5 AS stamp, MAX(doc_id) % 7 > 0 AS held, MAX(doc_id) % 4 AS generation FROM {documents} WHERE doc_id % 8 < 6 GROUP BY lang, doc_id % 97",
    "web_paths": "SELECT page_id, CONCAT(SUBSTRING(url, POSITION('://' IN url) + 3), CASE page_id % 6 WHEN 0 THEN '/node_modules/x/index.js' WHEN 1 THEN '/.git/HEAD' WHEN 2 THEN '/Thumbs.db' WHEN 3 THEN '/disk.iso' WHEN 4 THEN '/AppData/Local/Temp/a' ELSE '/notes.txt' END) AS path, CAST(LENGTH(html) AS BIGINT) AS size FROM {pages}",
}
_NAME = re.compile(r"\{(\w+)\}")


def domain(spark: SparkSession, sf_dir: str, name: str, made: dict | None = None) -> DataFrame:
    """A domain table, or a sample table of that name."""
    made = {} if made is None else made
    if name not in made:
        made[name] = spark.sql(DOMAIN[name], **{n: domain(spark, sf_dir, n, made) for n in set(_NAME.findall(DOMAIN[name]))}) if name in DOMAIN else table(spark, sf_dir, name)
    return made[name]


def with_domain(sql: str) -> str:
    """An oracle query over {tables}, with the domain tables it needs in front."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in _NAME.findall(text):
            if n in DOMAIN and n not in order:
                need(DOMAIN[n])
                order.append(n)

    need(sql)
    plain = lambda text: _NAME.sub(lambda m: m[1], text)
    head = ", ".join(f"{n} AS ({plain(DOMAIN[n])})" for n in order)
    body = plain(sql).strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[len('WITH RECURSIVE'):]}" if head else body
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}" if head else body
    return f"WITH {head} {body}" if head else body
