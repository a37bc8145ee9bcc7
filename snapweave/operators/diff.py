"""Change detection: a scan against the last index, deltas from change events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rules


def scan_diff(scan: DataFrame, index: DataFrame) -> DataFrame:
    """path, status: new, changed, unchanged or deleted.

    Unchanged means the same size and the same modification time to the second, with chunks on record unless
    the file is empty. One full outer join on the path.
    """
    left = scan.select("path", F.col("size").alias("s"), F.date_trunc("second", "mtime").alias("t"), F.lit(True).alias("here"))
    right = index.select("path", F.col("size").alias("is"), F.date_trunc("second", "mtime").alias("it"), (F.size("chunks") > 0).alias("held"), F.lit(True).alias("there"))
    same = (F.col("s") == F.col("is")) & (F.col("t") == F.col("it")) & (F.col("held") | (F.col("s") == 0))
    status = F.when(F.col("here").isNull(), "deleted").when(F.col("there").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return left.join(right, "path", "full_outer").select("path", status.alias("status"))


def index_stats(index: DataFrame) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def stale_paths(index: DataFrame, generation: int, limit: int) -> DataFrame:
    """Paths no scan has seen since an older generation, in order."""
    return index.where(F.col("generation") < generation).orderBy("path").limit(limit).select("path")


def next_index(index: DataFrame, diff: DataFrame, scan: DataFrame, generation: int) -> DataFrame:
    """Index after a scan: seen paths are stamped with its generation, changed and new ones replaced, deleted ones gone."""
    kept = index.join(diff.where("status = 'unchanged'").select("path"), "path").withColumn("generation", F.lit(generation).cast("long"))
    fresh = scan.join(diff.where("status IN ('new', 'changed')").select("path"), "path").withColumn("generation", F.lit(generation).cast("long"))
    return kept.unionByName(fresh.select(*kept.columns))


def delta(changes: DataFrame, index: DataFrame) -> DataFrame:
    """changes (path, removed, is_dir, at) -> path, action: the last event per path; a removed path takes all indexed paths below it along; directories are no uploads."""
    last = changes.groupBy("path").agg(F.max_by(F.struct("removed", "is_dir"), "at").alias("c")).select("path", "c.removed", "c.is_dir")
    gone = last.where("removed").select(F.col("path").alias("top"))
    # every indexed path asks for its ancestors, so this is an equi join instead of a prefix join
    parts = F.split("path", "/")
    above = index.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("top"))
    below = above.join(gone, "top").select("path").unionByName(gone.select(F.col("top").alias("path"))).distinct()
    kept = last.where("NOT removed AND NOT is_dir").select("path")
    return below.join(kept, "path", "left_anti").select("path", F.lit("delete").alias("action")).unionByName(kept.select("path", F.lit("upload").alias("action")))


def paths_under(index: DataFrame, prefix: str) -> DataFrame:
    """Indexed paths below a directory, with either kind of slash."""
    return index.where(F.col("path").startswith(prefix + "/") | F.col("path").startswith(prefix + "\\")).select("path")


def without_tree(index: DataFrame, prefix: str) -> DataFrame:
    return index.where((F.col("path") != prefix) & ~F.col("path").startswith(prefix + "/") & ~F.col("path").startswith(prefix + "\\"))


def roots_diff(configured: DataFrame, known: DataFrame) -> DataFrame:
    """path, status of folder roots: new or dropped."""
    a, b = configured.select("path"), known.select("path")
    return a.join(b, "path", "left_anti").select("path", F.lit("new").alias("status")).unionByName(b.join(a, "path", "left_anti").select("path", F.lit("dropped").alias("status")))


def event_filter(events: DataFrame, roots: DataFrame, present: DataFrame, platform: str = "linux", **rules_of) -> DataFrame:
    """Change events worth a backup: events (path, ops array<string>, ...), roots (root, name), present (path, is_dir:
    what exists now) -> the events' columns but ops, with root, removed and is_dir.

    Dropped are events that are only chmod, those outside every root or in a system location, and paths the rules
    skip (`rules_of` are arguments of rules.decide). A removed or renamed path is removed unless it exists.
    An event without ops or path tells nothing and is dropped.
    """
    real = events.where((F.size("ops") > 0) & (F.array_distinct("ops") != F.array(F.lit("chmod"))))
    held = rules.system_paths(rules.root_for(real.select("path").distinct(), roots)).where("NOT outside").select("path", "root")
    seen = present.select("path", "is_dir", F.lit(True).alias("here")).dropDuplicates(["path"])
    below = held.join(seen, "path", "left").select(
        F.col("path").alias("absolute"), "root", F.substr("path", F.length("root") + 2).alias("path"),
        F.coalesce("is_dir", F.lit(False)).alias("is_dir"), F.coalesce("here", F.lit(False)).alias("here"))
    # a name may be a file below one root and a directory below another: one verdict for each kind
    decided = [rules.decide(below.where(F.col("is_dir") == F.lit(kind)), **rules_of) for kind in (False, True)]
    kept = decided[0].unionByName(decided[1]).where("NOT skip").select(F.col("absolute").alias("path"), "root", "is_dir", "here")
    removed = (F.array_contains("ops", "remove") | F.array_contains("ops", "rename")) & ~F.col("here")
    columns = [events[c] for c in events.columns if c not in ("path", "ops", "root", "is_dir", "removed", "here")]
    return real.join(kept, "path").select("path", *columns, kept["root"], removed.alias("removed"), kept["is_dir"])
