"""Inclusion rules with reasons: patterns, decision order, projects, size limits and system locations.

Patterns become regular expressions on the driver (a rule table of a few hundred rows at most); matching is a
broadcast join of the distinct candidates (a path and each of its ancestor directories) with that table, so a
directory that millions of paths share is matched once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rule_data
from ..functions.paths import base_name, parent

DEFAULT_MAX_FILE_SIZE = 8 << 30
STAGES = ("include", "exclude", "hidden", "global", "project")


@dataclass(frozen=True)
class Pattern:
    text: str
    regex: str
    dir_only: bool
    anchored: bool
    negated: bool


def _segment(glob: str) -> str:
    """One path segment: `*`, `?` and classes; an unterminated class matches nothing."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = glob.find("]", i + 3 if glob[i + 1 : i + 2] in ("!", "^") else i + 2)
            if end < 0:
                return r"[^\s\S]"
            body = glob[i + 1 : end]
            negated = body[:1] in ("!", "^")
            body = re.sub(r"([\\\[\]^&~|])", r"\\\1", body[1:] if negated else body)
            out += f"(?:(?!/)[{'^' if negated else ''}{body}])" if body else r"[^\s\S]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out


def parse(raw: str) -> Pattern | None:
    """Null for blank lines, comments and patterns of nothing but `!` or `/`."""
    text = raw.strip().replace("\\", "/")
    if not text or text.startswith("#"):
        return None
    negated, rest = text.startswith("!"), text.lstrip("!") if text.startswith("!") else text
    dir_only, rest = rest.endswith("/"), rest.rstrip("/")
    anchored = rest.startswith("/") or "/" in rest
    rest = rest.strip("/")
    if not rest:
        return None
    segments, regex = rest.split("/"), ""
    segments = [s for i, s in enumerate(segments) if s != "**" or segments[i + 1 : i + 2] != ["**"]]
    if not anchored:
        regex = "(?:.*/)?"
    for i, s in enumerate(segments):
        last = i == len(segments) - 1
        if s == "**":
            regex = regex.removesuffix("/") + ("(?:/.*)?" if i else ".*") if last else regex + "(?:[^/]*/)*"
        else:
            regex += _segment(s) + ("" if last else "/")
    return Pattern(text, f"^{regex}$", dir_only, anchored, negated)


def _rows(text: str) -> list[list[str]]:
    return [[c.strip() for c in line.split("|")] for line in text.strip().splitlines()]


def any_depth(pattern: str) -> str:
    """A pattern of several segments is otherwise bound to the root."""
    inner = pattern.strip("/")
    return pattern if pattern.startswith(("**/", "/")) or "/" not in inner else f"**/{pattern}"


def default_rules() -> list[tuple[str, str, str]]:
    """(category, pattern, reason) in matching order."""
    out = []
    for category, text, deep in (("junk", rule_data.JUNK, False), ("cache", rule_data.CACHE, True), ("virtualisation", rule_data.VIRTUALISATION, False), ("ephemeral", rule_data.EPHEMERAL, True), ("developer", rule_data.DEVELOPER, False)):
        out += [(category, any_depth(p) if deep else p, r) for p, r in _rows(text)]
    return out


def rule_table(include=(), exclude=(), disabled=(), fold: bool = False) -> list[tuple]:
    """(ord, stage, category, pattern, reason, regex, dir_only, keeps) for a matcher's settings."""
    out = []

    def add(stage, category, raw, reason, keeps=False):
        p = parse(raw)
        if p:
            out.append((len(out), stage, category, p.text, reason, ("(?i)" if fold else "") + p.regex, p.dir_only, keeps or p.negated))

    for raw in include:
        add("include", "user", raw.strip().removeprefix("!"), "always included by your rules", True)
    for raw in exclude:
        add("exclude", "user", raw, "excluded by your rules")
    for category, raw, reason in default_rules():
        if category not in disabled:
            add("global", category, raw, reason)
    return out


_TABLE = "ord int, stage string, category string, pattern string, reason string, regex string, dir_only boolean, keeps boolean"


def candidates(paths: DataFrame) -> DataFrame:
    """paths (path, is_dir) -> path, cand (itself or an ancestor), cand_dir, cand_ord (0 is the path itself)."""
    parts = F.split("path", "/")
    at = F.explode(F.sequence(F.size(parts), F.lit(1))).alias("k")
    return paths.select("path", "is_dir", parts.alias("parts"), at).select("path", F.array_join(F.slice("parts", 1, F.col("k")), "/").alias("cand"), (F.col("is_dir") | (F.col("k") < F.size("parts"))).alias("cand_dir"), (F.size("parts") - F.col("k")).alias("cand_ord"))


def decide(paths: DataFrame, *, include=(), exclude=(), disabled=(), skip_hidden: bool = False, fold: bool = False, projects: DataFrame | None = None, max_file_size: int = 0) -> DataFrame:
    """paths (path, is_dir[, size]) -> path, skip, reason, rule, category.

    The first that applies decides: user includes (keep), user excludes in order (a negated one keeps), hidden
    names, the default rules in order, the innermost project's rules, the size limit (0 is the default, below
    0 none). A rule applies to a path if it matches the path or one of its ancestor directories.
    """
    spark = paths.sparkSession
    clean = paths.withColumn("path", F.regexp_replace(F.translate("path", "\\", "/"), "^/+|/+$", ""))
    cands = candidates(clean.select("path", "is_dir").distinct())
    table = rule_table(include, exclude, disabled, fold)
    empty = "path string, stage int, ord int, cand_ord int, reason string, rule string, category string, keeps boolean"
    found = spark.createDataFrame([], empty)
    if table:
        rules = F.broadcast(spark.createDataFrame(table, _TABLE))
        distinct = cands.select("cand", "cand_dir").distinct()
        hits = distinct.join(rules, F.expr("rlike(cand, regex)") & (~F.col("dir_only") | F.col("cand_dir")))
        stage = F.when(F.col("stage") == "include", 0).when(F.col("stage") == "exclude", 1).otherwise(3)
        one = hits.groupBy("cand", "cand_dir").agg(F.collect_list(F.struct(stage.alias("stage"), "ord", "reason", "pattern", "category", "keeps")).alias("hits"))  # no more than there are rules
        found = cands.join(one, ["cand", "cand_dir"]).select("path", "cand_ord", F.explode("hits").alias("h")).select("path", "h.stage", "h.ord", "cand_ord", "h.reason", F.col("h.pattern").alias("rule"), "h.category", "h.keeps")
    if skip_hidden:
        hidden = cands.where(base_name(F.col("cand")).startswith(".") & ~base_name(F.col("cand")).isin(".", ".."))
        found = found.unionByName(hidden.select("path", F.lit(2).alias("stage"), F.lit(0).alias("ord"), "cand_ord", F.lit("hidden entry").alias("reason"), F.lit("hidden").alias("rule"), F.lit("junk").alias("category"), F.lit(False).alias("keeps")))
    if projects is not None and "developer" not in disabled:
        found = found.unionByName(project_hits(cands, projects, fold))
    best = found.groupBy("path").agg(F.min_by(F.struct("reason", "rule", "category", "keeps"), F.struct("stage", "ord", "cand_ord")).alias("b"))
    out = clean.join(best, "path", "left").withColumn("skip", F.coalesce(~F.col("b.keeps"), F.lit(False)) & (F.col("path") != ""))
    limit = DEFAULT_MAX_FILE_SIZE if max_file_size == 0 else max_file_size
    if "size" in paths.columns and limit > 0:
        big = ~F.col("skip") & ~F.col("is_dir") & F.coalesce(F.col("size") > limit, F.lit(False))
    else:
        big = F.lit(False)
    pick = lambda name, for_big: F.when(big, F.lit(for_big)).when(F.col("skip"), F.col(f"b.{name}")).otherwise("")
    return out.select(*paths.columns, (F.col("skip") | big).alias("skip"), pick("reason", "larger than the configured maximum file size").alias("reason"), pick("rule", "max-file-size").alias("rule"), pick("category", "ephemeral").alias("category"))


def markers() -> list[tuple]:
    return [(i, m.removeprefix("*"), m.startswith("*"), kind, dirs.split(), reason) for i, (m, kind, dirs, reason) in enumerate(_rows(rule_data.MARKERS))]


def detect_projects(paths: DataFrame) -> DataFrame:
    """paths (path) of files -> root, kind, marker, excluded, reason: directories with a project marker.

    Several markers in one directory unite their exclusions; kind and reason are the first marker's by name.
    """
    spark = paths.sparkSession
    table = F.broadcast(spark.createDataFrame(markers(), "i int, marker string, suffix boolean, kind string, dirs array<string>, reason string"))
    named = paths.select(parent(F.col("path")).alias("root"), base_name(F.col("path")).alias("name")).distinct()
    exact = named.join(table.where("NOT suffix"), F.col("name") == F.col("marker"))
    ends = named.join(table.where("suffix"), F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)) == F.col("marker"))
    ends = ends.join(table.where("NOT suffix").select(F.col("marker").alias("name")), "name", "left_anti").select(*exact.columns)
    per = exact.unionByName(ends).groupBy("root").agg(F.array_sort(F.collect_list(F.struct("name", "kind", "dirs", "reason"))).alias("m"))
    return per.select("root", F.col("m")[0]["kind"].alias("kind"), F.array_join(F.transform("m", lambda x: x["name"]), ", ").alias("marker"), F.array_distinct(F.flatten(F.transform("m", lambda x: x["dirs"]))).alias("excluded"), F.col("m")[0]["reason"].alias("reason"))


def project_hits(cands: DataFrame, projects: DataFrame, fold: bool = False) -> DataFrame:
    """Matches of the innermost project above each path: its own directories and the rules for any project.

    candidates are tried before rules here: the deepest candidate inside the project first, and for each the
    project's directories, then the shared rules.
    """
    spark = cands.sparkSession
    own = projects.select("root", "marker", F.col("reason").alias("own_reason"), F.posexplode("excluded").alias("own_ord", "dir"))
    anc = cands.where("cand_ord > 0").select("path", F.col("cand").alias("root"), F.col("cand_ord").alias("up"))
    anc = anc.unionByName(cands.where("cand_ord = 0").select("path", F.lit("").alias("root"), F.lit(1 << 30).alias("up")))
    inner = anc.join(projects.select("root"), "root").groupBy("path").agg(F.min_by("root", "up").alias("root"))
    inside = cands.join(inner, "path").withColumn("sub", F.when(F.col("root") == "", F.col("cand")).when(F.startswith("cand", F.concat("root", F.lit("/"))), F.substr("cand", F.length("root") + 2))).where("sub IS NOT NULL")
    flag = "(?i)" if fold else ""
    glob = F.concat(F.lit(f"{flag}^"), F.regexp_replace(F.regexp_replace("dir", r"([.+()\[\]{}^$|\\])", r"\\$1"), r"\*", "[^/]*"), F.lit("$"))
    mine = inside.join(own.withColumn("regex", glob), "root").where(F.expr("rlike(sub, regex)") & F.col("cand_dir"))
    mine = mine.select("path", F.lit(4).alias("stage"), (F.col("cand_ord") * 1000 + F.col("own_ord")).cast("int").alias("ord"), F.lit(0).alias("cand_ord"), F.col("own_reason").alias("reason"), F.concat("marker", F.lit(" -> "), "dir", F.lit("/")).alias("rule"))
    shared = [(500 + i, p, r, flag + parse(p).regex, parse(p).dir_only) for i, (p, r) in enumerate(_rows(rule_data.DEVELOPER_SCOPED))]
    table = F.broadcast(spark.createDataFrame(shared, "o int, pattern string, reason string, regex string, dir_only boolean"))
    any_project = inside.join(table, F.expr("rlike(sub, regex)") & (~F.col("dir_only") | F.col("cand_dir")))
    any_project = any_project.select("path", F.lit(4).alias("stage"), (F.col("cand_ord") * 1000 + F.col("o")).cast("int").alias("ord"), F.lit(0).alias("cand_ord"), "reason", F.col("pattern").alias("rule"))
    return mine.unionByName(any_project).withColumn("category", F.lit("developer")).withColumn("keeps", F.lit(False))


def system_locations(platform: str = "linux") -> list[tuple[str, str, bool]]:
    """(prefix, reason, soft)."""
    text = {"linux": rule_data.SYSTEM_LINUX, "macos": rule_data.SYSTEM_MACOS, "windows": rule_data.SYSTEM_WINDOWS}[platform]
    soft = set(rule_data.SOFT[platform].split())
    return [(p.lower() if platform != "linux" else p, r, p in soft) for p, r in _rows(text)]


def system_paths(paths: DataFrame, platform: str = "linux") -> DataFrame:
    """paths (path, root) -> is_system, forbidden_root, outside: at or below a system location; refused as a root
    (a soft location only itself); a system path unless a location that holds it also holds the accepted root."""
    out, none = [], F.lit(False)
    p = F.regexp_replace(F.translate("path", "\\", "/"), "(?<=.)/+$", "")
    r = F.regexp_replace(F.translate("root", "\\", "/"), "(?<=.)/+$", "")
    p, r = (c if platform == "linux" else F.lower(c) for c in (p, r))
    within = lambda c, prefix: (c == prefix) | c.startswith(prefix + "/")
    is_system = forbidden = outside = none
    for prefix, _, soft in system_locations(platform):
        is_system = is_system | within(p, prefix)
        forbidden = forbidden | ((p == prefix) if soft else within(p, prefix))
        outside = outside | (within(p, prefix) & ~F.coalesce(within(r, prefix), none))
    return paths.select(*paths.columns, is_system.alias("is_system"), forbidden.alias("forbidden_root"), outside.alias("outside"))


def rules_listing(spark) -> DataFrame:
    """The default rules with their reasons."""
    rows = [(i, *r) for i, r in enumerate(default_rules())]
    rows += [(len(rows) + i, "developer", p, r) for i, (p, r) in enumerate(_rows(rule_data.DEVELOPER_SCOPED))]
    return spark.createDataFrame(rows, "ord int, category string, pattern string, reason string")


def skip_reasons(decided: DataFrame, limit: int = 5) -> DataFrame:
    """The most frequent reasons: count down, then by reason."""
    return decided.where("skip").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(limit)


def root_for(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """paths (path), roots (root, name) -> path, root, name: the most specific root that holds the path.

    Every path asks for its ancestors, so this is an equi join at any number of roots.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    held = paths.select("path", F.explode(above).alias("root")).join(roots.select("root", "name"), "root")
    return held.groupBy("path").agg(F.max_by(F.struct("root", "name"), F.struct(F.length("root"), "name")).alias("b")).select("path", "b.root", "b.name")
