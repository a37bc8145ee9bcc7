"""Types of the domain tables (as DDL) and the constants that define their semantics. All times are UTC."""

from __future__ import annotations

ACCOUNT = "account_id long, email string, is_admin boolean, quota_bytes long, retention_days int, max_upload_bytes_per_sec long, require_encryption boolean, created_at timestamp"
DEVICE = "device_id string, account_id string, name string, hostname string, platform string, agent_version string, state string, state_reason string, last_error string, current_path string, created_at timestamp, last_seen timestamp, queued_files long, queued_bytes long, files_done long, files_total long, battery_pct int, on_metered boolean, revoked boolean"
SNAPSHOT = "snapshot_id string, account_id string, device_id string, kind string, status string, parent_id string, error string, started_at timestamp, completed_at timestamp, file_count long, dir_count long, total_bytes long, uploaded_bytes long, skipped_count long, roots array<struct<name:string,path:string>>, pinned boolean"
ENTRY = "snapshot_id string, path string, type string, digest string, link_target string, size long, mode int, mtime timestamp, chunks array<string>"
DELETION = "snapshot_id string, path string"
CHUNK = "digest string, stored_bytes long, plain_bytes long, encrypted boolean, created_at timestamp"
REFERENCE = "snapshot_id string, digest string"
EVENT = "event_id long, account_id string, device_id string, level string, message string, path string, reason string, at timestamp"
INDEX_FILE = "path string, digest string, size long, mtime timestamp, chunks array<string>, mode int, generation long"
BLOB = "digest string, size long"

# Fixed values.
MAX_CHAIN_NODES = 65
AGENT_MAX_CHAIN = 24
MAX_ANCESTOR_HOPS = 1000
STALE_RUNNING_HOURS = 6
EVENT_RETENTION_DAYS, EVENT_MOST_ROWS = 30, 200_000
STALE_DEVICE_HOURS = 48
LIVE_MINUTES = 3
TREE_PAGE, TREE_PAGE_MOST = 1000, 5000
SNAPSHOT_PAGE, SNAPSHOT_PAGE_MOST = 100, 500
VERSIONS, VERSIONS_MOST = 40, 100
EVENT_PAGE, EVENT_PAGE_MOST = 200, 1000
HISTORY_DAYS, HISTORY_DAYS_MOST = 30, 365
INTEGRITY_MOST, INTEGRITY_PER_SNAPSHOT = 1000, 5
LOGIN_ATTEMPTS, LOGIN_WINDOW_MINUTES = 10, 15
COMMAND_QUEUE, EVENT_PENDING, EVENT_RING = 8, 500, 200
STALE_PATHS_PER_PASS = 20_000
CHUNK_MIN, CHUNK_AVG, CHUNK_MAX, CHUNK_NORMAL = 256 << 10, 1 << 20, 4 << 20, 2
