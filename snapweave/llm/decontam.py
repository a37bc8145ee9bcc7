"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are `[0-9a-z or any non-ASCII]+` after lower-casing A-Z. A window is n consecutive words of a
benchmark item; an item of fewer words, but not none, is one window. A document word inside any
occurrence of any window is hit. Window hashes only nominate; every nomination is verified word by word.

Size of what is broadcast: the benchmark's words, counted first. Up to `max_broadcast_words` they go out
as one hash set (flat arrays) and the documents are read once without a shuffle. A larger benchmark is dealt by item
into as many sets of that size as it needs; one set at a time is gathered, sent and scanned for, and the
rows with hits are written and merged by row at the end. No item, window or document is dropped in either case.

Null text and text without words: n_words 0, nothing hit. Repeated doc_ids: one result row per input row.
Benchmark rows with null text or null id take no part. Empty tables give empty results / no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

from .common import bound_batches, odd_constants, slices, words_of, written

MAX_BROADCAST_WORDS = 1_000_000


class WindowIndex:
    """Hash set of item windows by length, with the items of each window."""

    def __init__(self, items: list[tuple[object, bytes]], n: int):
        vocab: dict[bytes, int] = {}
        self.vocab, self.n = vocab, n
        self.item_ids = [str(i) for i, _ in items]
        lengths: dict[int, list[tuple[int, np.ndarray]]] = {}
        for at, (_, text) in enumerate(items):
            words = np.array([vocab.setdefault(w, len(vocab)) for w in words_of(text)], np.int32)
            if len(words):
                lengths.setdefault(min(n, len(words)), []).append((at, words))
        self.tables = []  # per length: hash constants, hashes of the windows, the windows, where their owners begin, owners
        for k, held in sorted(lengths.items()):
            windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(w, k) for _, w in held])
            owner = np.repeat(np.array([at for at, _ in held], np.int32), [len(w) - k + 1 for _, w in held])
            for seed in range(1, 100):
                c = odd_constants(k, seed)
                hashes = self.hashed(windows.T, c)
                order = np.lexsort((owner, hashes))
                equal = hashes[order][1:] == hashes[order][:-1]
                same = (windows[order][1:] == windows[order][:-1]).all(axis=1)
                if not (equal & ~same).any():
                    break
            first = np.append(True, ~equal)
            new = first | np.append(True, owner[order][1:] != owner[order][:-1])
            begins = np.append(np.cumsum(new)[first] - 1, new.sum())
            self.tables.append((k, c, hashes[order][first], windows[order][first], begins, owner[order][new]))

    @staticmethod
    def hashed(columns, c: np.ndarray) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for col, k in zip(columns, c):
            h += (np.asarray(col).astype(np.uint64) + np.uint64(1)) * k
            h ^= h >> np.uint64(29)
        return h

    def scan(self, texts: list[bytes | None]) -> tuple[list[int], list[np.ndarray], list[set[int]]]:
        """Per text: number of words, mask of hit words, indexes of items with an occurring window."""
        get, counts, parts = self.vocab.get, [], []
        for t in texts:
            words = words_of(t)
            counts.append(len(words))
            parts.append(np.fromiter((get(w, -1) for w in words), np.int64, len(words)))
            parts.append(np.array([-1], np.int64))  # windows never cross texts
        ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
        starts = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)])
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        edge = np.zeros(len(ids) + 1, np.int64)
        found: list[set[int]] = [set() for _ in texts]
        for k, c, hashes, windows, begins, owners in self.tables:
            at = np.nonzero(known[k:] - known[:-k] == k)[0] if len(ids) >= k else np.empty(0, np.int64)
            if not len(at):
                continue
            h = self.hashed([ids[at + j] for j in range(k)], c)
            slot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            nominated = hashes[slot] == h
            at, slot = at[nominated], slot[nominated]
            same = np.ones(len(at), bool)
            for j in range(k):
                same &= ids[at + j] == windows[slot, j]
            at, slot = at[same], slot[same]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + k, -1)
            for doc, s in zip(np.searchsorted(starts, at, "right") - 1, slot):
                found[doc].update(owners[begins[s] : begins[s + 1]].tolist())
        hit = np.cumsum(edge)[:-1] > 0
        return counts, [hit[s : s + n] for s, n in zip(starts, counts)], found


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()


def _sets(items: DataFrame, max_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """Benchmark items in sets of at most about max_words words (bytes bound words), one set at a time."""
    size = items.agg(F.sum(F.octet_length("t")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    sets = max(1, -(-int(size["b"] or 0) // (2 * max_words)))
    for k in range(sets):
        part = items if sets == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(sets)) == k)
        yield [(r["i"], r["t"].encode("utf-8", "surrogatepass")) for r in part.collect()]


_FOUND = (("n_words", LongType()), ("hit_starts", ArrayType(IntegerType())), ("hit_ends", ArrayType(IntegerType())), ("item_ids", ArrayType(StringType())))


def _scan(rows: DataFrame, items: list[tuple[str, bytes]], n: int) -> DataFrame:
    """rows (row, text) -> row and what of the items is found in text."""
    index = rows.sparkSession.sparkContext.broadcast(WindowIndex(items, n))

    def scan(batches):
        for batch, texts in slices(batches):
            counts, masks, found = index.value.scan(texts)
            starts, ends = [], []
            for m in masks:
                d = np.diff(np.concatenate([[0], m.astype(np.int8), [0]]))
                starts.append(np.nonzero(d == 1)[0].tolist())
                ends.append(np.nonzero(d == -1)[0].tolist())
            names = [sorted({index.value.item_ids[i] for i in f}) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(counts, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))],
                ["row", "n_words", "hit_starts", "hit_ends", "item_ids"],
            )

    schema = rows.select("row").schema
    for name, kind in _FOUND:
        schema = schema.add(name, kind)
    return rows.mapInArrow(scan, schema)


def _found(docs: DataFrame, benchmark: DataFrame, keep: list[str], n: int, text_col: str, item_id_col: str, item_text_col: str, max_words: int) -> DataFrame:
    """row (a struct of the columns to keep), n_words, hit_starts, hit_ends, item_ids."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text_col).alias("text"))
    sets = _sets(_items(benchmark, item_id_col, item_text_col), max_words)
    first, second = next(sets), next(sets, None)
    if second is None:
        return _scan(rows, first, n)
    # several sets: the rows are numbered once in the shared folder and scanned set by set; only rows with hits are written
    numbered = written(rows.withColumn("number", F.monotonically_increasing_id()))
    plain = numbered.select(F.struct("number").alias("row"), "text")
    hits = None
    for items in chain([first, second], sets):
        got = written(_scan(plain, items, n).where(F.size("hit_starts") > 0).select("row.number", "hit_starts", "hit_ends", "item_ids"))
        hits = got if hits is None else hits.unionByName(got)
    merged = hits.groupBy("number").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("hit_starts", "hit_ends")), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    words = _scan(numbered.select(F.struct("number", "row").alias("row"), "text"), [], n).select("row.number", F.col("row.row").alias("row"), "n_words")
    none = [F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("hit_starts", "array<int>"), ("hit_ends", "array<int>"), ("item_ids", "array<string>"))]
    return words.join(merged, "number", "left").select("row", "n_words", *none)


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id_col: str = "item_id", item_text_col: str = "text", max_broadcast_words: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """`keep` columns + n_words, hit spans (word positions, end exclusive) and ids of the items found."""
    found = _found(docs, benchmark, list(keep), n, text_col, item_id_col, item_text_col, max_broadcast_words)
    return found.select("row.*", "n_words", "hit_starts", "hit_ends", "item_ids")


def n_hit_words() -> F.Column:
    """Number of distinct words covered by the spans (spans of different sets may overlap)."""
    spans = F.array_sort(F.arrays_zip("hit_starts", "hit_ends"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(acc, s):
        a, b = s["hit_starts"].cast("long"), s["hit_ends"].cast("long")
        return F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), b - F.greatest(a, acc["end"]))).alias("n"), F.greatest(acc["end"], b).alias("end"))

    return F.aggregate(spans, start, add)["n"]


def contamination_report(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(docs, benchmark, **kw)
    return found.select(
        "doc_id", "n_words", n_hit_words().alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit_starts") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", max_broadcast_words: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """The documents without any benchmark window, columns unchanged, whatever their names."""
    found = _found(docs, benchmark, docs.columns, n, text_col, item_id_col, item_text_col, max_broadcast_words)
    return found.where(F.size("hit_starts") == 0).select("row.*")
