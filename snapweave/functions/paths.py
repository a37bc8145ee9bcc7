"""Path columns: validation, parents, children, names in archives and on disk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Device names no restored file may take, and characters no file name keeps.
RESERVED = ("aux", "con", "nul", "prn", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))
UNSAFE_NAME = "/\\:*?\"<>|\n\r"


def clean(path: Column) -> Column:
    """Slashes unified and trimmed at both ends; null for an empty path or one with an empty, `.` or `..` segment."""
    p = F.regexp_replace(F.translate(path, "\\", "/"), "^/+|/+$", "")
    bad = F.exists(F.split(p, "/"), lambda s: s.isin("", ".", ".."))
    return F.when(~bad, p)


def normalised(path: Column) -> Column:
    """clean(), but '' (the whole tree) instead of null."""
    return F.coalesce(clean(path), F.lit(""))


def under(path: Column, prefix: str) -> Column:
    """At or below the prefix: a range, so that Parquet statistics prune ('0' follows '/')."""
    return F.lit(True) if not prefix else (path == prefix) | ((path >= prefix + "/") & (path < prefix + "0"))


def child_of(path: Column, prefix: str) -> Column:
    """The path's ancestor (or itself) one level below the prefix; null outside it and for the prefix itself."""
    if not prefix:
        return F.substring_index(path, "/", 1)
    return F.when(path.startswith(prefix + "/"), F.concat(F.lit(prefix + "/"), F.substring_index(F.substr(path, F.lit(len(prefix) + 2)), "/", 1)))


def parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def relative(path: Column, prefix: str) -> Column:
    """Name below the prefix; the last segment for the prefix itself."""
    if not prefix:
        return path
    return F.when(path == prefix, base_name(path)).when(path.startswith(prefix + "/"), F.substr(path, F.lit(len(prefix) + 2))).otherwise(path)


def is_reserved(path: Column) -> Column:
    """Some segment is a device name, whatever its extension and letter case."""
    return F.exists(F.split(path, "/"), lambda s: F.lower(F.substring_index(s, ".", 1)).isin(*RESERVED))


def is_safe(path: Column) -> Column:
    """Restorable below a folder: relative, without `..` or empty segments, no device names."""
    return F.coalesce((clean(path) == path) & ~is_reserved(path), F.lit(False))


def safe_name(text: Column, most: int = 80) -> Column:
    """Without characters that some file system or header refuses; `backup` if nothing is left."""
    out = F.trim(F.translate(text, UNSAFE_NAME, "-" * 9 + "  "))
    return F.coalesce(F.nullif(F.left(out, F.lit(most)), F.lit("")), F.lit("backup"))


def archive_name(device: Column, started_at: Column, prefix: str = "") -> Column:
    parts = [safe_name(device), F.date_format(started_at, "yyyy-MM-dd-HHmm")] + ([safe_name(base_name(F.lit(prefix)))] if prefix else [])
    return F.concat(F.concat_ws("-", *parts), F.lit(".zip"))


def under_root(absolute: Column, root: Column, name: Column) -> Column:
    """Snapshot path of a file below a root: the root's name and the relative path; null outside the root."""
    below = F.substr(absolute, F.length(root) + 2)
    return F.when(absolute == root, name).when(F.startswith(absolute, F.concat(root, F.lit("/"))), F.concat_ws("/", name, below))


def overlap(a: Column, b: Column) -> Column:
    """One folder is or holds the other."""
    x, y = (F.concat(F.lower(F.regexp_replace(p, "/+$", "")), F.lit("/")) for p in (a, b))
    return F.startswith(x, y) | F.startswith(y, x)


def root_slug(path: Column) -> Column:
    name = F.regexp_replace(F.lower(base_name(F.regexp_replace(path, "/+$", ""))), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(name, "^-+|-+$", ""), F.lit("")), F.lit("root"))


def restored_name(name: Column, n: Column) -> Column:
    """The n-th name tried beside an existing file: `a.txt` -> `a (restored 2).txt`; n = 0 leaves the name."""
    extension = F.regexp_extract(name, r"(\.[^./]*)$", 1)
    stem = F.left(name, F.length(name) - F.length(extension))
    return F.when(n == 0, name).otherwise(F.concat(stem, F.lit(" (restored "), n.cast("string"), F.lit(")"), extension))
