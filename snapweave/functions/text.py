"""Values as people read and write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size suffixes and their factors, longest first.
SUFFIXES = (
    ("KIB", 1 << 10), ("MIB", 1 << 20), ("GIB", 1 << 30), ("TIB", 1 << 40), ("KB", 10**3), ("MB", 10**6), ("GB", 10**9), ("TB", 10**12),
    ("K", 1 << 10), ("M", 1 << 20), ("G", 1 << 30), ("T", 1 << 40), ("B", 1),
)


def human_bytes(n: Column) -> Column:
    """`1.5 MB`: one decimal below 10, none above; units of 1024."""
    out = F.format_string("%.1f EB", n / F.lit(float(1 << 50)) / 1024)
    for k, unit in reversed(list(enumerate(("KB", "MB", "GB", "TB", "PB"), 1))):
        v = n / F.lit(float(1 << (10 * k)))
        shown = F.when(v < 10, F.format_string(f"%.1f {unit}", v)).otherwise(F.format_string(f"%.0f {unit}", F.bround(v)))
        out = F.when(v < 1024, shown).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n)).otherwise(out)


def _count(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))


def roughly(seconds: Column) -> Column:
    whole = lambda by: F.floor(seconds / by).cast("long")
    return (F.when(seconds < 60, "less than a minute").when(seconds < 3600, _count(whole(60), "minute")).when(seconds < 86400, _count(whole(3600), "hour"))
            .when(seconds < 30 * 86400, _count(whole(86400), "day")).otherwise(_count(whole(30 * 86400), "month")))


def relative(seconds: Column) -> Column:
    """Age as on a dashboard; null is `never`, a negative age lies ahead."""
    m = F.round(seconds / 60).cast("long")
    h = F.round(m / 60).cast("long")
    d = F.round(h / 24).cast("long")
    mo = F.round(d / 30).cast("long")
    ago = lambda n, unit: F.concat(_count(n, unit), F.lit(" ago"))
    years = F.concat(F.round(mo / 12).cast("long").cast("string"), F.when(mo < 18, F.lit(" year ago")).otherwise(" years ago"))
    past = F.when(seconds < 60, "just now").when(m < 60, ago(m, "minute")).when(h < 24, ago(h, "hour")).when(d < 30, ago(d, "day")).when(mo < 12, ago(mo, "month")).otherwise(years)
    return F.when(seconds.isNull(), "never").when(seconds < 0, until(-seconds)).otherwise(past)


def until(seconds: Column) -> Column:
    m = F.round(seconds / 60).cast("long")
    h = F.round(m / 60).cast("long")
    d = F.round(h / 24).cast("long")
    ahead = lambda n, unit: F.concat(F.lit("in "), _count(n, unit))
    return F.when(seconds.isNull(), "never").when(seconds < 60, "in under a minute").when(m < 60, ahead(m, "minute")).when(h < 48, ahead(h, "hour")).otherwise(ahead(d, "day"))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def parse_bytes(text: Column) -> Column:
    """`4MiB`, `2 GB`, `512K`, `10` -> bytes; null for anything else."""
    t = F.upper(F.trim(text))
    number = F.regexp_extract(t, r"^([0-9]*\.?[0-9]+)\s*[A-Z]*$", 1)
    unit = F.regexp_extract(t, r"([A-Z]*)$", 1)
    factor = F.lit(None).cast("long")
    for suffix, by in SUFFIXES:
        factor = F.when(unit == suffix, F.lit(by)).otherwise(factor)
    whole = F.when(t.rlike(r"^[0-9]+$"), t.cast("long"))
    return F.coalesce(whole, F.when((number != "") & factor.isNotNull(), (number.cast("double") * factor).cast("long")))


def progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100), F.round(100 * done / total).cast("int"))).otherwise(0)


def is_digest(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def email(text: Column) -> Column:
    return F.lower(F.trim(text))


def join_code(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"[\s-]", ""))


def from_millis(ms: Column) -> Column:
    """0 and null are no time."""
    return F.timestamp_millis(F.nullif(ms, F.lit(0)))


def to_millis(at: Column) -> Column:
    return F.coalesce(F.unix_millis(at), F.lit(0))


def digests_of(json: Column) -> Column:
    return F.coalesce(F.from_json(F.nullif(json, F.lit("")), "array<string>"), F.array().cast("array<string>"))


def archive_member(path: Column, kind: Column, size: Column) -> Column:
    """How an entry stands in an archive: name, stored or deflated. Directories end in `/`, links in `.symlink`, very large files are stored."""
    name = F.when(kind == "dir", F.concat(path, F.lit("/"))).when(kind == "symlink", F.concat(path, F.lit(".symlink"))).otherwise(path)
    return F.struct(name.alias("name"), F.when((kind == "dir") | (size > (1 << 30)), "store").otherwise("deflate").alias("method"))
