"""Versioned trees: chains of full and delta snapshots, the effective tree of any version, browsing and history.

Snapshots are (snapshot_id, device_id, kind, status, parent_id, started_at), entries (snapshot_id, path, ...),
deletions (snapshot_id, path). Every operator is DataFrame -> DataFrame and works on all snapshots at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.paths import child_of, under
from ..session import checkpoint


def ancestors(parents: DataFrame, hops: int, id_col: str = "snapshot_id", parent_col: str = "parent_id") -> DataFrame:
    """(id, ancestor, depth) with depth 0 for the node itself, up to `hops` steps: a parent forest closed by doubling.

    log2(hops) joins on the narrow parent table, each checkpointed, instead of a row-by-row walk; not limited
    by the recursion limits of a recursive query. A parent that is no row of the table is still an ancestor.
    Cycles are cut at `hops`.
    """
    step = checkpoint(parents.select(F.col(id_col).alias("id"), F.col(parent_col).alias("up")).where("up IS NOT NULL"))
    known = checkpoint(parents.select(F.col(id_col).alias("id"), F.col(id_col).alias("ancestor"), F.lit(0).alias("depth")))
    reach = 1  # known holds all ancestors nearer than `reach`; step jumps `reach` parents up
    while reach <= hops:
        far = known.join(step.toDF("ancestor", "next"), "ancestor").select("id", F.col("next").alias("ancestor"), (F.col("depth") + reach).alias("depth"))
        # ancestors at depth >= reach: everything known, seen from `reach` steps up
        known = checkpoint(known.unionByName(far.where(F.col("depth") <= hops)))
        step = checkpoint(step.alias("a").join(step.alias("b"), F.col("a.up") == F.col("b.id")).select(F.col("a.id").alias("id"), F.col("b.up").alias("up")))
        reach *= 2
        if step.isEmpty():
            break
    return known


def chains(snapshots: DataFrame, most: int = schema.MAX_CHAIN_NODES) -> DataFrame:
    """(tip, snapshot_id, seq): the nodes a tip's tree is made of, from its full base (seq 0) to the tip.

    A tip whose chain misses a node, has a delta without parent or more than `most` nodes has no rows here
    (see chain_errors). Status plays no part.
    """
    walk = _walk(snapshots, most)
    good = walk.groupBy("tip").agg(F.min(F.when(F.col("kind") == "full", F.col("depth"))).alias("base"), F.min(F.when(F.col("kind").isNull(), F.col("depth"))).alias("gap"))
    good = good.where(F.col("base").isNotNull() & (F.col("gap").isNull() | (F.col("gap") > F.col("base"))))
    return walk.join(good, "tip").where("depth <= base").select("tip", "snapshot_id", (F.col("base") - F.col("depth")).alias("seq"))


def chain_errors(snapshots: DataFrame, most: int = schema.MAX_CHAIN_NODES) -> DataFrame:
    """(snapshot_id) of tips whose chain can't be resolved."""
    return snapshots.select("snapshot_id").join(chains(snapshots, most).select(F.col("tip").alias("snapshot_id")), "snapshot_id", "left_anti")


def _walk(snapshots: DataFrame, most: int) -> DataFrame:
    kinds = snapshots.select(F.col("snapshot_id").alias("ancestor"), "kind")
    up = ancestors(snapshots.select("snapshot_id", F.when(F.col("kind") != "full", F.col("parent_id")).alias("parent_id")), most - 1)
    return up.join(kinds, "ancestor", "left").select(F.col("id").alias("tip"), F.col("ancestor").alias("snapshot_id"), "depth", "kind")


def effective_tree(entries: DataFrame, deletions: DataFrame, chain: DataFrame) -> DataFrame:
    """tip + the entry columns: per tip and path the newest entry, unless a tombstone is as new or newer.

    One shuffle on (tip, path): entries and tombstones are united and the greatest (seq, tombstone, row) wins.
    """
    columns = [c for c in entries.columns if c not in ("snapshot_id", "path")]
    rows = entries.join(chain, "snapshot_id").select("tip", "path", "seq", F.lit(0).alias("del"), F.struct(*columns).alias("row"))
    row_type = rows.schema["row"].dataType
    gone = deletions.join(chain, "snapshot_id").select("tip", "path", "seq", F.lit(1).alias("del"), F.lit(None).cast(row_type).alias("row"))
    newest = rows.unionByName(gone).groupBy("tip", "path").agg(F.max_by(F.struct("del", "row"), F.struct("seq", "del")).alias("w"))
    return newest.where("w.del = 0").select("tip", "path", *[F.col(f"w.row.{c}").alias(c) for c in columns])


def page(tree: DataFrame, prefix: str = "", cursor: str = "", limit: int = schema.TREE_PAGE) -> DataFrame:
    """Up to `limit` paths below (and at) the prefix after the cursor, in byte order; has_more tells if others follow."""
    limit = max(1, min(limit or schema.TREE_PAGE, schema.TREE_PAGE_MOST))
    rows = tree.where(under(F.col("path"), prefix) & (F.col("path") > F.lit(cursor))).orderBy("path").limit(limit + 1)
    numbered = rows.withColumn("_n", F.row_number().over(Window.orderBy("path")))  # limit + 1 rows at most
    return numbered.withColumn("has_more", F.max("_n").over(Window.partitionBy()) > limit).where(F.col("_n") <= limit).drop("_n")


def children(tree: DataFrame, prefix: str = "", cursor: str = "", limit: int = schema.TREE_PAGE) -> DataFrame:
    """One level below the prefix: stored rows, and a synthesised directory for every child only seen through deeper paths.

    Each child appears once, whatever sorts between it and its contents, and pages continue after a child's
    name: the documented intent where the original listing repeats or loses children.
    """
    limit = max(1, min(limit or schema.TREE_PAGE, schema.TREE_PAGE_MOST))
    child = child_of(F.col("path"), prefix)
    rows = tree.select(child.alias("child"), F.when(F.col("path") == child, F.struct("type", "size", "digest")).alias("own")).where(F.col("child").isNotNull() & (F.col("child") > F.lit(cursor)))
    one = rows.groupBy("child").agg(F.max("own").alias("own"))
    return one.orderBy("child").limit(limit).select(F.col("child").alias("path"), F.coalesce("own.type", F.lit("dir")).alias("type"), F.coalesce("own.size", F.lit(0)).alias("size"), F.coalesce("own.digest", F.lit("")).alias("digest"), F.col("own").isNull().alias("synthetic"))


def entry(tree: DataFrame, path: str) -> DataFrame:
    return tree.where(F.col("path") == path)


def file_versions(trees: DataFrame, snapshots: DataFrame, limit: int | None = schema.VERSIONS) -> DataFrame:
    """Distinct versions of every (device, path) over complete snapshots, newest first.

    Consecutive snapshots with the same content collapse into the newest of the run; a snapshot without the
    path ends a run (so a deleted and restored copy is a version of its own); directories are skipped without
    ending one; an empty fingerprint never collapses. The limit counts versions.
    """
    limit = limit and max(1, min(limit, schema.VERSIONS_MOST))
    whole = snapshots.where("status = 'complete'").select("snapshot_id", "device_id", "started_at")
    held = trees.join(whole, trees["tip"] == whole["snapshot_id"]).select("device_id", "path", "snapshot_id", "started_at", "type", F.coalesce(F.nullif("digest", F.lit("")), F.array_join("chunks", ",")).alias("print"))
    newest_first = Window.partitionBy("device_id", "path").orderBy(F.desc("started_at"), F.desc("snapshot_id"))
    # instead of a row for every absent (snapshot, path): the rank of each snapshot of the device tells of gaps
    rank = whole.withColumn("rank", F.row_number().over(Window.partitionBy("device_id").orderBy(F.desc("started_at"), F.desc("snapshot_id")))).select("snapshot_id", "rank")
    ordered = held.join(rank, "snapshot_id").withColumn("gap", F.col("rank") - F.coalesce(F.lag("rank").over(newest_first), F.lit(0)) > 1)
    # directories are no versions; what they say about gaps is carried to the next file
    marked = ordered.withColumn("gaps", F.sum(F.col("gap").cast("int")).over(newest_first)).where("type <> 'dir'")
    before = Window.partitionBy("device_id", "path").orderBy(F.desc("started_at"), F.desc("snapshot_id"))
    same = (F.lag("print").over(before) == F.col("print")) & (F.col("print") != "") & (F.lag("gaps").over(before) == F.col("gaps"))
    first = marked.withColumn("_same", F.coalesce(same, F.lit(False))).where("NOT _same").withColumn("version", F.row_number().over(before))
    out = first.select("device_id", "path", "version", "snapshot_id", "started_at", F.col("print").alias("fingerprint"))
    return out.where(F.col("version") <= limit) if limit else out


def latest_complete(snapshots: DataFrame) -> DataFrame:
    """The newest complete snapshot of each device (ties: greater id)."""
    return snapshots.where("status = 'complete'").groupBy("device_id").agg(F.max_by("snapshot_id", F.struct("started_at", "snapshot_id")).alias("snapshot_id"), F.max("started_at").alias("started_at"))


def find_snapshot(snapshots: DataFrame, refs: DataFrame) -> DataFrame:
    """refs (ref, device_id) -> snapshot_id and problem: `latest`, an exact id, or a unique prefix of an id.

    An exact id wins over prefixes; no or several candidates leave snapshot_id null and name the problem.
    """
    ids = snapshots.select("device_id", F.col("snapshot_id").cast("string").alias("snapshot_id"))
    latest = latest_complete(snapshots).select("device_id", F.col("snapshot_id").cast("string").alias("latest"))
    hits = refs.join(ids, "device_id").where(F.col("snapshot_id").startswith(F.col("ref"))).groupBy("ref", "device_id").agg(F.count(F.lit(1)).alias("n"), F.min("snapshot_id").alias("one"), F.max((F.col("snapshot_id") == F.col("ref")).cast("int")).alias("exact"))
    joined = refs.join(hits, ["ref", "device_id"], "left").join(latest, "device_id", "left")
    found = F.when(F.col("ref") == "latest", F.col("latest")).when(F.col("exact") == 1, F.col("ref")).when(F.col("n") == 1, F.col("one"))
    problem = F.when(found.isNotNull(), F.lit("")).when(F.coalesce("n", F.lit(0)) > 1, F.lit("ambiguous")).otherwise(F.lit("not found"))
    return joined.select("ref", "device_id", found.alias("snapshot_id"), problem.alias("problem"))


def snapshot_list(snapshots: DataFrame, devices: DataFrame, limit: int = schema.SNAPSHOT_PAGE) -> DataFrame:
    """Newest first, with the device's name (a removed device has none)."""
    limit = max(1, min(limit or schema.SNAPSHOT_PAGE, schema.SNAPSHOT_PAGE_MOST))
    top = snapshots.orderBy(F.desc("started_at"), F.desc("snapshot_id")).limit(limit)
    return top.join(devices.select("device_id", "name"), "device_id", "left").withColumn("name", F.coalesce("name", F.lit("Removed device")))


def delta_parent_ok(snapshots: DataFrame) -> DataFrame:
    """snapshot_id, parent_ok: is the parent a complete snapshot of the same account and device?"""
    parent = snapshots.select(F.col("snapshot_id").alias("parent_id"), F.col("account_id").alias("_a"), F.col("device_id").alias("_d"), F.col("status").alias("_s"))
    good = (F.col("_a") == F.col("account_id")) & (F.col("_d") == F.col("device_id")) & (F.col("_s") == "complete")
    return snapshots.where("parent_id IS NOT NULL").join(parent, "parent_id", "left").select("snapshot_id", F.coalesce(good, F.lit(False)).alias("parent_ok"))


def open_kind(snapshots: DataFrame, most: int = schema.MAX_CHAIN_NODES) -> DataFrame:
    """snapshot_id, opened_as, parent_id: a delta without a good parent, or whose chain would be too long, opens as full."""
    ok = delta_parent_ok(snapshots)
    depth = chains(snapshots, most).where("tip = snapshot_id").select(F.col("tip").alias("parent_id"), (F.col("seq") + 1).alias("_nodes"))
    joined = snapshots.select("snapshot_id", "kind", "parent_id").join(ok, "snapshot_id", "left").join(depth, "parent_id", "left")
    delta = (F.col("kind") == "delta") & F.coalesce("parent_ok", F.lit(False)) & (F.coalesce("_nodes", F.lit(most)) < most)
    return joined.select("snapshot_id", F.when(delta, "delta").otherwise("full").alias("opened_as"), F.when(delta, F.col("parent_id")).alias("parent_id"))


def descendants(snapshots: DataFrame, roots: DataFrame, hops: int = schema.MAX_ANCESTOR_HOPS) -> DataFrame:
    """(root, snapshot_id): every root (snapshot_id) with itself and all that build on it."""
    up = ancestors(snapshots, hops)
    return up.join(roots.select(F.col("snapshot_id").alias("ancestor")).distinct(), "ancestor").select(F.col("ancestor").alias("root"), F.col("id").alias("snapshot_id")).distinct()


def search(tree: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """Files whose path holds the query, letter case aside, in path order."""
    return tree.where((F.col("type") == "file") & F.contains(F.lower("path"), F.lower(F.lit(query)))).orderBy("path").limit(limit)


def folders_first(rows: DataFrame) -> list[Column]:
    return [F.when(F.col("type") == "dir", 0).otherwise(1), F.col("path")]
