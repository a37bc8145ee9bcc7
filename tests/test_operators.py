"""Small fixtures with expected rows, and properties against plain Python."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snapweave.functions import paths, text
from snapweave.operators import content, devices, diff, folds, retention, rules, store, tree

T0 = datetime(2024, 1, 1)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def forest(spark, parents, device="d", kinds=None):
    data = [(i, device, "a", kinds[i] if kinds else ("delta" if p is not None else "full"), "complete", p, T0 + timedelta(hours=k)) for k, (i, p) in enumerate(parents.items())]
    return spark.createDataFrame(data, "snapshot_id string, device_id string, account_id string, kind string, status string, parent_id string, started_at timestamp")


def entries(spark, data):
    return spark.createDataFrame([(s, p, "file", 1, d) for s, p, d in data], "snapshot_id string, path string, type string, size long, digest string")


def test_delta_chain_ties_and_revival(spark):
    snaps = forest(spark, {"S0": None, "S1": "S0", "S2": "S1"})
    e = entries(spark, [("S0", "keep", "k"), ("S0", "change", "1"), ("S0", "gone", "t"), ("S1", "change", "2"), ("S1", "tie", "x"), ("S2", "gone", "again"), ("S0", "dir/x", "d")])
    d = spark.createDataFrame([("S1", "gone"), ("S1", "tie"), ("S1", "dir")], "snapshot_id string, path string")
    t = tree.effective_tree(e, d, tree.chains(snaps))
    assert rows(t, "tip", "path", "digest") == sorted([("S0", "keep", "k"), ("S0", "change", "1"), ("S0", "gone", "t"), ("S0", "dir/x", "d"), ("S1", "keep", "k"), ("S1", "change", "2"), ("S1", "dir/x", "d"), ("S2", "keep", "k"), ("S2", "change", "2"), ("S2", "gone", "again"), ("S2", "dir/x", "d")])


def test_random_chains_equal_a_replay(spark):
    rnd = random.Random(2)
    parents, e, d = {}, {}, set()
    for k in range(12):
        parents[f"s{k:02}"] = f"s{k - 1:02}" if k % 6 else None
        for _ in range(6):
            e[f"s{k:02}", rnd.choice("abcdé")] = str(rnd.random())
        for _ in range(2):
            d.add((f"s{k:02}", rnd.choice("abcdé")))
    want, state = [], {}
    for k in range(12):
        s = f"s{k:02}"
        state = dict(state) if k % 6 else {}
        state.update({p: v for (i, p), v in e.items() if i == s})
        for i, p in d:
            if i == s:
                state.pop(p, None)
        want += [(s, p, v) for p, v in state.items()]
    t = tree.effective_tree(entries(spark, [(s, p, v) for (s, p), v in e.items()]), spark.createDataFrame(sorted(d), "snapshot_id string, path string"), tree.chains(forest(spark, parents)))
    assert rows(t, "tip", "path", "digest") == sorted(want)


@pytest.mark.parametrize("n,bad", [(24, 0), (65, 0), (66, 1), (150, 85)])
def test_chain_limits(spark, n, bad):
    snaps = forest(spark, {f"s{k:03}": f"s{k - 1:03}" if k else None for k in range(n)})
    assert tree.chain_errors(snaps).count() == bad
    assert tree.descendants(snaps, snaps.where("kind = 'full'")).count() == n


def test_chain_cycles_and_gaps(spark):
    snaps = forest(spark, {"a": "b", "b": "a", "c": "lost", "d": None}, kinds={"a": "delta", "b": "delta", "c": "delta", "d": "delta"})
    assert tree.chain_errors(snaps).count() == 4


def pages(t, prefix, limit):
    out, cursor = [], ""
    while True:
        got = tree.children(t, prefix, cursor, limit).collect()
        if not got:
            return out
        out += [(r["path"], r["type"]) for r in sorted(got, key=lambda r: r["path"])]
        cursor = max(r["path"] for r in got)


def test_children_once_and_paged(spark):
    names = ["docs", "docs-old", "docs-old/x", "docs/a", "docs/b", "z"] + [f"d/{i:02}" for i in range(20)] + ["e/one"]
    t = spark.createDataFrame([(p, "file", 1, "x") for p in names], "path string, type string, size long, digest string")
    whole = [("d", "dir"), ("docs", "file"), ("docs-old", "file"), ("e", "dir"), ("z", "file")]
    for limit in (1, 2, 10):
        assert pages(t, "", limit) == whole
    assert [p for p, _ in pages(t, "d", 7)] == [f"d/{i:02}" for i in range(20)]
    got, cursor = [], ""
    while True:
        r = tree.page(t, "d", cursor, 6).collect()
        got += [x["path"] for x in r]
        cursor = got[-1]
        if not r[0]["has_more"]:
            break
    assert got == [f"d/{i:02}" for i in range(20)]


def test_versions_collapse_and_gaps(spark):
    snaps = forest(spark, {k: None for k in "12345"})
    held = spark.createDataFrame([("1", "p", "file", "v1", []), ("2", "p", "file", "v1", []), ("4", "p", "file", "v1", []), ("5", "p", "file", "v2", []), ("1", "q", "file", "", []), ("2", "q", "file", "", []), ("1", "r", "file", "x", []), ("2", "r", "dir", "", []), ("3", "r", "file", "x", [])], "tip string, path string, type string, digest string, chunks array<string>")
    assert rows(tree.file_versions(held, snaps), "path", "version", "snapshot_id") == [("p", 1, "5"), ("p", 2, "4"), ("p", 3, "2"), ("q", 1, "2"), ("q", 2, "1"), ("r", 1, "3")]


def test_maintenance_keeps_every_young_event(spark):
    snaps = forest(spark, {"S0": None}).selectExpr("*", "false AS pinned")
    accounts = spark.createDataFrame([("a", 0)], "account_id string, retention_days int")
    refs, chunks = spark.createDataFrame([("S0", 1)], "snapshot_id string, digest int"), spark.createDataFrame([(1,), (2,)], "digest int")
    events = spark.range(250_000).select(F.col("id").alias("event_id"), F.lit(T0).alias("at"))
    events = events.union(spark.range(5).select(F.col("id"), F.lit(T0 - timedelta(days=31))))
    codes = spark.createDataFrame([("c", T0 - timedelta(days=1))], "code string, expires_at timestamp")
    assert dict(rows(retention.maintenance(snaps, accounts, refs, chunks, events, codes, T0))) == {"1 stale_failed": 0, "2 snapshots_expired": 0, "3 chunks_deleted": 1, "4 events_kept": 250_000, "5 tokens_expired": 1}


def test_retention_keeps_floor_and_ancestors(spark):
    snaps = forest(spark, {"f": None, "d1": "f", "d2": "d1", "g": None}).withColumn("pinned", F.lit(False))
    accounts = spark.createDataFrame([("a", 30)], "account_id string, retention_days int")
    late = T0 + timedelta(days=800)
    assert rows(retention.keep(snaps, accounts, late)) == [("g",)]
    assert rows(retention.expired(snaps, accounts, late)) == [("d1",), ("d2",), ("f",)]
    pinned = snaps.withColumn("pinned", F.col("snapshot_id") == "d2")
    assert rows(retention.keep(pinned, accounts, late)) == [("d1",), ("d2",), ("f",), ("g",)]


def test_blocks_of_two_devices(spark):
    chunks = spark.createDataFrame([("h", 10, 40), ("x", 5, 5)], "digest string, stored_bytes long, plain_bytes long")
    refs = spark.createDataFrame([("s1", "h"), ("s2", "h"), ("s2", "lost")], "snapshot_id string, digest string")
    asked = spark.createDataFrame([(1, ["b", "h", "a", "b"])], "request_id int, digests array<string>")
    assert rows(store.missing_of_request(asked, chunks)) == [(1, 0, "b"), (1, 2, "a")]
    assert rows(store.garbage(chunks, refs), "digest") == [("x",)]
    snaps = spark.createDataFrame([("s1", "a", "complete"), ("s2", "a", "complete")], "snapshot_id string, account_id string, status string")
    use = store.usage(spark.createDataFrame([("a", 0)], "account_id string, quota_bytes long"), spark.createDataFrame([], "device_id string, account_id string, revoked boolean"), snaps, refs, chunks).first()
    assert (use["chunk_count"], use["compression_ratio"], use["dedup_ratio"]) == (1, 4.0, 8.0)


PATTERNS = [("build/", "build", True, True), ("build/", "build", False, False), ("*.log", "a/b.log", False, True), ("/top", "top", False, True), ("/top", "a/top", False, False), ("a/**/z", "a/z", False, True), ("a/**/z", "a/b/c/z", False, True), ("a/*/z", "a/b/c/z", False, False), ("f?o", "foo", False, True), ("f?o", "f/o", False, False), ("x[0-9]", "x7", False, True), ("x[!0-9]", "x7", False, False), ("x[!0-9]", "xa", False, True), ("[ab", "[ab", False, False), ("a/**", "a", True, True), ("a/**", "a/b", False, True), ("**/c/", "a/b/c", True, True), ("a b", "x/a b", False, True), ("x]", "x]", False, True)]


def test_patterns():
    import re

    for raw, path, is_dir, want in PATTERNS:
        p = rules.parse(raw)
        assert (bool(re.match(p.regex, path)) and (is_dir or not p.dir_only)) == want, raw
    assert all(rules.parse(x) is None for x in ("", "  ", "# c", "!", "/"))


def segments_match(pat, path):
    """The pattern semantics, written as a search."""
    if not pat:
        return not path
    if pat[0] == "**":
        return len(pat) == 1 or any(segments_match(pat[1:], path[i:]) for i in range(len(path) + 1))
    return bool(path) and one_segment(pat[0], path[0]) and segments_match(pat[1:], path[1:])


def one_segment(p, n):
    if not p:
        return not n
    if p[0] == "*":
        return any(one_segment(p[1:], n[i:]) for i in range(len(n) + 1))
    return bool(n) and p[0] in ("?", n[0]) and one_segment(p[1:], n[1:])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "*", "a*", "?", "**", "ab"]), min_size=1, max_size=4), st.lists(st.sampled_from(["a", "b", "ab", "aab"]), min_size=1, max_size=4), st.booleans())
def test_patterns_equal_a_segment_search(pat, path, rooted):
    import re

    raw = ("/" if rooted else "") + "/".join(pat)
    p = rules.parse(raw)
    starts = [0] if rooted or len(pat) > 1 else range(len(path))
    assert bool(re.match(p.regex, "/".join(path))) == any(segments_match(pat, path[i:]) for i in starts)


def test_rule_decisions(spark):
    data = [("Code/app/package.json", 1), ("Code/app/src/index.js", 1), ("Code/api/main.go", 1), ("Code/api/go.mod", 1), ("Documents/real.docx", 1), ("Pictures/build/facade.jpg", 1), ("Code/app/node_modules/left-pad/index.js", 1), ("Code/app/dist/bundle.js", 1), ("Code/app/.next/cache/blob", 1), ("Code/api/vendor/github.com/x/y.go", 1), ("Documents/.DS_Store", 1), ("Documents/Thumbs.db", 1), ("AppData/Local/Temp/tmp1234", 1), ("Downloads/keep.iso", 1), ("Downloads/drop.iso", 1), ("big", 9 << 30), ("Documents/node_modules/readme.md", 1)]
    df = spark.createDataFrame([(p, False, s) for p, s in data], "path string, is_dir boolean, size long")
    out = {r["path"]: r for r in rules.decide(df, include=["Downloads/keep.iso"], projects=rules.detect_projects(df)).collect()}
    assert {p for p, r in out.items() if not r["skip"]} == {"Code/app/package.json", "Code/app/src/index.js", "Code/api/main.go", "Code/api/go.mod", "Documents/real.docx", "Pictures/build/facade.jpg", "Downloads/keep.iso"}
    assert out["big"]["rule"] == "max-file-size" and out["Code/api/vendor/github.com/x/y.go"]["rule"] == "go.mod -> vendor/" and out["Documents/Thumbs.db"]["reason"] == "Windows thumbnail cache"
    assert not rules.decide(df, exclude=["!Documents/*", "*.docx"]).where("path = 'Documents/real.docx'").first()["skip"]
    assert rules.decide(df, exclude=["*.docx", "!Documents/*"]).where("path = 'Documents/real.docx'").first()["skip"]


def test_scan_diff_and_delta(spark):
    cols = "path string, size long, mtime timestamp, chunks array<string>"
    index = spark.createDataFrame([("same", 1, T0, ["c"]), ("empty", 0, T0, []), ("nochunks", 1, T0, []), ("bigger", 1, T0, ["c"]), ("gone", 1, T0, ["c"]), ("dir/a", 1, T0, ["c"]), ("dir/b/c", 1, T0, ["c"]), ("dirx", 1, T0, ["c"])], cols)
    scan = spark.createDataFrame([("same", 1, T0 + timedelta(milliseconds=400), []), ("empty", 0, T0, []), ("nochunks", 1, T0, []), ("bigger", 2, T0, []), ("fresh", 1, T0, [])], cols)
    got = dict(rows(diff.scan_diff(scan, index)))
    assert {k: got[k] for k in ("same", "empty", "nochunks", "bigger", "gone", "fresh")} == {"same": "unchanged", "empty": "unchanged", "nochunks": "changed", "bigger": "changed", "gone": "deleted", "fresh": "new"}
    changes = spark.createDataFrame([("dir", True, True, 1), ("same", False, False, 1), ("same", True, False, 2), ("new", False, False, 1), ("newdir", False, True, 1)], "path string, removed boolean, is_dir boolean, at int")
    assert rows(diff.delta(changes, index)) == [("dir", "delete"), ("dir/a", "delete"), ("dir/b/c", "delete"), ("new", "upload"), ("same", "delete")]


def scalar_cuts(data, sizes):
    g, out, start = content.gear_table().tolist(), [], 0
    early, late = (int(x) for x in sizes.limits)
    while start < len(data):
        n = len(data) - start
        end = n if n <= sizes.least else min(n, sizes.most)
        if n > sizes.least:
            v = 0
            for i in range(sizes.least, end):
                v = (2 * v + g[data[start + i]]) % (1 << 64)
                if v < (early if i < min(sizes.average, n) else late):
                    end = i + 1
                    break
        start += end
        out.append(start)
    return out


def test_cut_points_equal_the_scalar_loop():
    rnd = random.Random(1)
    for sizes in (content.Sizes(512, 2048, 8192), content.Sizes(64, 256, 1024)):
        for n in (0, 1, 63, 64, 65, 600, 5000, 60_000):
            data = rnd.randbytes(n)
            assert content.cut_points(data, sizes) == scalar_cuts(data, sizes)
    data = rnd.randbytes(400_000)

    def parts(b):
        ends = content.cut_points(b, content.Sizes(512, 2048, 8192))
        return {b[s:e] for s, e in zip([0, *ends], ends)}

    old, new = parts(data), parts(data[:100_000] + rnd.randbytes(17) + data[100_000:])
    assert len(new - old) <= 0.1 * len(new)
    with pytest.raises(ValueError):
        content.Sizes(100, 50, 10)


def test_block_codec_and_verification(spark):
    blobs = spark.createDataFrame([("a", b"x" * 5000), ("b", random.Random(3).randbytes(300)), ("c", b"")], "digest string, content binary")
    blocks = content.encoded(blobs)
    assert {r["digest"]: r["stored_bytes"] for r in blocks.collect()}["b"] <= 316
    assert rows(content.decoded(blocks).selectExpr("digest", "content", "problem")) == sorted((r["digest"], r["content"], "") for r in blobs.collect())
    broken = spark.createDataFrame([("m", b"\x01"), ("v", b"\x09\x00\x01x"), ("k", b"\x01\x02\x01x"), ("l", b"\x01\x00\x05x"), ("z", b"\x01\x01\x05xyz")], "digest string, block binary")
    assert dict(rows(content.decoded(broken), "digest", "problem")) == {"m": "malformed block", "v": "unknown block version", "k": "block needs a key", "l": "block length mismatch", "z": "malformed block"}
    sha = lambda b: __import__("hashlib").sha256(b).hexdigest()
    stored = spark.createDataFrame([(sha(b"ab"), b"ab"), (sha(b"cd"), b"cd"), (sha(b"ef"), b"xx")], "digest string, content binary")
    expected = spark.createDataFrame([("ok", 4, sha(b"abcd"), [sha(b"ab"), sha(b"cd")]), ("order", 4, sha(b"abcd"), [sha(b"cd"), sha(b"ab")]), ("bad", 2, sha(b"ef"), [sha(b"ef")]), ("gone", 2, "", ["0" * 64]), ("short", 9, sha(b"ab"), [sha(b"ab")]), ("empty", 0, "", [])], "path string, size long, digest string, chunks array<string>")
    assert dict(rows(content.verify(expected, stored))) == {"ok": "ok", "order": "digest_mismatch", "bad": "corrupt_chunk", "gone": "missing_chunk", "short": "size_mismatch", "empty": "ok"}


def test_folds(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    tries = spark.createDataFrame([(i, "k", at(s)) for i, s in enumerate([0, 1, 2, 3, 60, 61, 62])], "attempt_id int, key string, at timestamp")
    assert [r[1] for r in rows(folds.attempt_limiter(tries, limit=3, minutes=1), "attempt_id", "allowed")] == [True, True, True, False, True, True, True]
    sends = spark.createDataFrame([(0, "k", at(0), 1000), (1, "k", at(0), 100), (2, "k", at(10), 4 << 20), (3, "k", at(10), 100)], "transfer_id int, key string, at timestamp, bytes long")
    us = [r[1] - int(T0.timestamp()) * 0 for r in rows(folds.token_bucket(sends, 1000.0), "transfer_id", "sent_at_us")]
    assert [u - us[0] for u in us] == [0, 100_000, 10_000_000, 10_100_000]
    ups = spark.createDataFrame([(i, "a", at(i), 4096, 1024) for i in range(3)] + [(9, "b", at(0), 10, 0)], "upload_id int, account_id string, at timestamp, bytes long, quota_bytes long")
    assert rows(folds.quota_gate(ups, size="bytes"), "upload_id", "accepted") == [(0, True), (1, False), (2, False), (9, True)]
    changes = spark.createDataFrame([(i, "r", at(s)) for i, s in enumerate([0, 5, 14, 16, 29, 31])], "change_id int, root string, at timestamp")
    assert [r[1] for r in rows(folds.change_batches(changes), "change_id", "batch")] == [1, 1, 1, 2, 2, 3]
    assert rows(folds.change_sessions(changes), "root", "changes") == [("r", 6)]


def test_folds_keep_nulls_and_longs(spark):
    big = (1 << 53) + 1
    ups = spark.createDataFrame([(big, None, T0, None, None), (big + 1, None, T0, 5, 3), (big + 2, "a", None, 7, 5), (big + 3, "a", T0, 1, 5)], "upload_id long, account_id string, at timestamp, bytes long, quota_bytes long")
    assert rows(folds.quota_gate(ups), "upload_id", "bytes", "accepted", "used_before") == [(big, None, True, 0), (big + 1, 5, True, 0), (big + 2, 7, True, 0), (big + 3, 1, False, 7)]
    changes = ups.select(F.col("upload_id").alias("change_id"), F.col("account_id").alias("root"), "at")
    assert rows(folds.change_batches(changes), "change_id", "batch") == [(big, 1), (big + 1, 1), (big + 2, None), (big + 3, 1)]
    assert folds.change_batches(changes.where("false")).collect() == []


def test_devices_by_their_owner(spark):
    table = spark.createDataFrame([(1, 7, "a", False, "idle"), (2, 8, "b", False, "error")], "device_id int, account_id int, name string, revoked boolean, state string")
    ask = spark.createDataFrame([(1, 7, "né" + "x" * 200), (2, 7, "stolen"), (9, 7, "nobody")], "device_id int, account_id int, name string")
    assert rows(devices.rename_devices(table, ask), "device_id", "name") == [(1, "né" + "x" * 125), (2, "b")]
    assert rows(devices.revoke_devices(table, ask), "device_id", "revoked", "state") == [(1, True, "revoked"), (2, False, "error")]
    assert [rows(x, "device_id") for x in devices.delete_devices(table, ask, table)] == [[(2,)], [(2,)]]
    new = table.where("device_id = 1").drop("state").unionByName(table.where("device_id = 2").drop("state").withColumn("device_id", F.lit(3)))
    assert rows(devices.create_devices(table, new), "device_id", "state") == [(1, "idle"), (2, "error"), (3, "idle")]


def test_event_filter_of_mixed_roots(spark):
    roots = spark.createDataFrame([("/r", "R"), ("/r/in", "I")], "root string, name string")
    events = spark.createDataFrame([(1, "/r/a", ["chmod"]), (2, "/r/a", ["rename"]), (3, "/r/b", ["rename"]), (4, "/r/in/a", ["write"]), (5, "/x/a", ["write"]), (6, None, ["write"]), (7, "/r/a", None), (8, "/r/in", ["create"]), (9, "/r/node_modules/q", ["create"])], "event_id int, path string, ops array<string>")
    here = spark.createDataFrame([("/r/a", False), ("/r/in", True), ("/r/in/a", True)], "path string, is_dir boolean")
    got = diff.event_filter(events, roots, here)
    assert rows(got, "event_id", "root", "removed", "is_dir") == [(2, "/r", False, False), (3, "/r", True, False), (4, "/r/in", False, True), (8, "/r/in", False, True)]


def test_texts_and_paths(spark):
    one = spark.range(1)
    got = one.select(text.human_bytes(F.lit(1536)), text.human_bytes(F.lit(20 << 20)), text.roughly(F.lit(7200)), text.roughly(F.lit(90)), text.relative(F.lit(None).cast("double")), text.relative(F.lit(3 * 86400)), text.until(F.lit(7200)), text.parse_bytes(F.lit(" 4MiB")), text.parse_bytes(F.lit("2 GB")), text.parse_bytes(F.lit("x")), text.progress(F.lit(3), F.lit(2)), paths.restored_name(F.lit("a.tar.gz"), F.lit(2)), paths.child_of(F.lit("a/b/c"), "a"), paths.relative(F.lit("a/b"), "a/b"), paths.safe_name(F.lit(" a/b:c ")), devices.cut_bytes(F.lit("aéz"), 2), paths.under_root(F.lit("/h/d/x"), F.lit("/h/d"), F.lit("Docs")), paths.root_slug(F.lit("/home/My Docs/"))).first()
    assert tuple(got) == ("1.5 KB", "20 MB", "2 hours", "1 minute", "never", "3 days ago", "in 2 hours", 4 << 20, 2 * 10**9, None, 100, "a.tar (restored 2).gz", "a/b", "b", "a-b-c", "a", "Docs/x", "my-docs")
