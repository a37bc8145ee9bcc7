"""Bounded tiles of large buckets, and the comparison of the rows of a tile.

Rows (key, id, label, side, sketch, size): rows of one key are mates; label is the component that id already belongs to.
Mates of one component need no comparison, so the rows of a bucket's largest component ("bulk") are never compared
with each other, only with the others: they are dealt into blocks that each meet the blocks of the others. A bucket
of n rows with r others makes n + r * (n - r) / block + r * r / block rows, at most.

In a tile, rows i and j are compared if their sides differ or both are 0 (sides: 0 others, 1 bulk or a star's
members, 2 others that meet only bulk, or a star's centre), their labels differ and they pass the gate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release_memory

#: Rows of a block and bytes of contents that are compared with another block in one task at a time.
BLOCK, TILE_BYTES = 4096, 16 << 20
#: Bytes of small tiles that are looked at together.
RUN_BYTES = 4 << 20
#: Pairs of a tile that are looked at together.
PAIRS = 1 << 17
#: Tiles of fewer rows are looked at together.
SMALL = 48


@dataclass(frozen=True)
class Gate:
    """Pairs to compare: sketches within `limit` bits (whatever they are, if both sizes are under `free`), sizes within `ratio`."""

    limit: int
    ratio: float
    free: int = 0

    def passed(self, d: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        large = np.maximum(x, y)
        return ((d <= self.limit) | (large < self.free)) & (np.minimum(x, y) >= self.ratio * large - 1e-9)


def deal(rows: DataFrame, weight: Column, bound: int, large: Column | None = None) -> DataFrame:
    """rows (key, id, label, side, sketch, size) -> the same with tile for key; the weights of a side of a tile sum to about `bound` at most.

    large: which rows can belong to a key of over `bound`, where that is known.
    """
    sums = (rows if large is None else rows.where(large)).withColumn("_w", weight.cast("long")).groupBy("key").agg(
        F.coalesce(F.sum(F.when(F.col("side") != 1, F.col("_w"))), F.lit(0)).alias("_others"), F.coalesce(F.sum(F.when(F.col("side") == 1, F.col("_w"))), F.lit(0)).alias("_bulk")
    ).where(F.col("_others") + F.col("_bulk") > bound)
    rows = rows.join(sums, "key", "left")
    n, m = (F.ceil(F.col(c) / bound).cast("long") for c in ("_others", "_bulk"))
    whole = F.array(F.struct(F.col("key").alias("tile"), F.col("side").cast("int").alias("side")))

    def tile(kind: str, a: Column, b: Column, side: Column) -> Column:
        return F.struct(F.xxhash64(F.col("key"), F.lit(kind), a, b).alias("tile"), side.cast("int").alias("side"))

    def upto(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))

    block = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1).cast("long"), F.when(F.col("side") == 1, m).otherwise(n)))
    others = F.transform(upto(n), lambda o: tile("o", F.least(block, o), F.greatest(block, o), F.when(o == block, 0).when(o > block, 1).otherwise(2)))
    with_bulk = F.transform(upto(m), lambda c: tile("b", block, c, F.lit(2)))
    bulk = F.transform(upto(n), lambda o: tile("b", o, block, F.lit(1)))
    places = F.when(F.col("_others").isNull(), whole).when(F.col("side") == 1, bulk).when(F.col("side") == 2, with_bulk).otherwise(F.concat(others, with_bulk))
    lead = [F.when(F.col("_others").isNull(), F.col("lead")).otherwise(F.col("_place.tile")).alias("lead")] if "lead" in rows.columns else []
    return rows.withColumn("_place", F.explode(places)).select(F.col("_place.tile").alias("tile"), "id", "label", F.col("_place.side").alias("side"), "sketch", "size", *lead)


def runs(batches: Iterator[pa.RecordBatch], rows: int = 8192, size: int = RUN_BYTES) -> Iterator[pa.Table]:
    """Whole runs of equal tiles of sorted batches, of about so many rows or bytes, or one tile."""
    held: list[pa.RecordBatch] = []

    def large() -> bool:
        return sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tile = batch.column("tile").to_numpy()
        if held and tile[0] != last and large():
            yield pa.Table.from_batches(held)
            held = []
        # up to its last tile, which may go on in the next batch
        cut = int(np.searchsorted(tile != tile[-1], False)) if tile[0] == tile[-1] else int(np.nonzero(tile != tile[-1])[0][-1]) + 1
        if cut:
            held.append(batch.slice(0, cut))
            if large():
                yield pa.Table.from_batches(held)
                held = []
        held.append(batch.slice(cut))
        last = tile[-1]
    if held:
        yield pa.Table.from_batches(held)
    held = batch = None
    release_memory()


def _numpy(t: pa.Table) -> tuple[np.ndarray, ...]:
    ids, labels, sides, sizes = (t.column(c).to_numpy() for c in ("id", "label", "side", "size"))
    words = pa.concat_arrays([c.slice(0) for c in t.column("sketch").chunks]).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(ids), -1)
    return ids, labels, sides, sizes, words


def near(labels: np.ndarray, sides: np.ndarray, sizes: np.ndarray, words: np.ndarray, gate: Gate, step: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of the pairs i < j of a tile that have to be compared, a few rows i at a time."""
    for a in range(0, len(labels), step):
        i = slice(a, min(len(labels), a + step))
        d = np.zeros((i.stop - a, len(labels) - a), np.int32)
        for w in range(words.shape[1]):
            d += np.bitwise_count(words[i, None, w] ^ words[None, a:, w])
        ok = (labels[i, None] != labels[None, a:]) & ((sides[i, None] != sides[None, a:]) | (sides[i, None] == 0))
        ok &= gate.passed(d, sizes[i, None], sizes[None, a:])
        x, y = np.nonzero(np.triu(ok, 1))
        yield x + a, y + a, d[x, y]


def _tiles(run: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tiles of a run that have at least two rows."""
    tile = run.column("tile").to_numpy()
    edges = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1], [True]]))
    some = np.diff(edges) > 1
    return edges[:-1][some], edges[1:][some]


def mates(run: pa.Table, gate: Gate) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of the pairs i < j of rows of a run that share a tile and have to be compared."""
    _, labels, sides, sizes, words = _numpy(run)
    starts, ends = _tiles(run)
    for s, e in zip(starts[ends - starts >= SMALL].tolist(), ends[ends - starts >= SMALL].tolist()):
        for i, j, d in near(labels[s:e], sides[s:e], sizes[s:e], words[s:e], gate):
            yield i + s, j + s, d
    starts, n = starts[ends - starts < SMALL], (ends - starts)[ends - starts < SMALL]
    row = np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())
    left = np.repeat(starts + n, n) - row - 1  # rows of its tile after each row
    cut = np.searchsorted(np.cumsum(left), np.arange(PAIRS, left.sum() + PAIRS, PAIRS))
    for a, b in zip([0, *(cut[:-1] + 1).tolist()], (cut + 1).tolist()):
        i = np.repeat(row[a:b], left[a:b])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(left[a:b]) - left[a:b], left[a:b])
        ok = (labels[i] != labels[j]) & ((sides[i] != sides[j]) | (sides[i] == 0))
        i, j = i[ok], j[ok]
        d = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int32)
        ok = gate.passed(d, sizes[i], sizes[j])
        yield i[ok], j[ok], d[ok]


def wanted(rows: DataFrame, gate: Gate) -> DataFrame:
    """The rows that have a mate of another component which passes the gate, with the least such id of their tile as lead."""

    def work(batches):
        for run in runs(batches):
            ids = run.column("id").to_numpy()
            want = np.zeros(len(ids), bool)
            for i, j, _ in mates(run, gate):
                want[i] = want[j] = True
            if want.any():
                tile = run.column("tile").to_numpy()
                first = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
                least = np.minimum.reduceat(np.where(want, ids, np.iinfo(np.int64).max), first)
                lead = np.repeat(least, np.diff(np.append(first, len(ids))))
                yield from run.append_column("lead", pa.array(lead)).filter(pa.array(want)).to_batches()

    names = ["tile", "id", "label", "side", "sketch", "size"]
    schema = rows.select(*names, F.lit(0).cast("long").alias("lead")).schema
    return rows.select(*names).repartition("tile").sortWithinPartitions("tile").mapInArrow(work, schema)


class Union:
    """Components known inside one task."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def joined(self, a: int, b: int) -> bool:
        """Unite; True if they were apart."""
        a, b = self.top(a), self.top(b)
        self.up[a] = b
        return a != b


def _rank(group: np.ndarray) -> np.ndarray:
    """Each row's place among the rows of its group, in the given order."""
    order = np.argsort(group, kind="stable")
    out = np.empty(len(group), np.int64)
    out[order] = np.arange(len(group)) - np.searchsorted(group[order], group[order])
    return out


def _gathered(pairs: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    held, n = [], 0
    for part in pairs:
        held.append(part)
        n += len(part[0])
        if n >= PAIRS:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held))


def spanning(ids, labels, pairs, contents: list, same: Callable, sift: Callable | None = None) -> Iterator[tuple[int, int]]:
    """Links between the contents of some tiles that join whatever components are linked; pairs as from mates().

    In every round each component tries its nearest few partners, more from round to round; pairs that have come
    into one component meanwhile are not tried.
    """
    known = Union()
    labels = labels.tolist()
    may = sift(contents) if sift else None
    for i, j, d in _gathered(pairs):
        if may:
            maybe = may(i, j)
            i, j, d = i[maybe], j[maybe], d[maybe]
        a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        order = order[np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))] if len(order) else order
        i, j, d = i[order], j[order], d[order]
        order = np.argsort(d, kind="stable")
        i, j, few = i[order], j[order], 1
        while len(i):
            top = np.array([known.top(x) for x in labels])
            apart = top[i] != top[j]
            i, j = i[apart], j[apart]
            now = (_rank(top[i]) < few) | (_rank(top[j]) < few)
            x, y = i[now].tolist(), j[now].tolist()
            if x:
                for a, b, yes in zip(x, y, same([contents[k] for k in x], [contents[k] for k in y])):
                    if yes and known.joined(labels[a], labels[b]):
                        yield int(ids[a]), int(ids[b])
            i, j, few = i[~now], j[~now], 2 * few


def settle(rows: DataFrame, contents: DataFrame, same: Callable, gate: Gate, sift: Callable | None = None) -> DataFrame:
    """Links (a, b) found by comparing contents within each tile.

    sift(contents) may give a function that says of rows i and j which pairs can be the same; the others are not compared.
    """

    def work(batches):
        for run in runs(batches):
            ids, labels = run.column("id").to_numpy(), run.column("label").to_numpy()
            found = list(spanning(ids, labels, mates(run, gate), run.column("content").to_pylist(), same, sift))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    # tiles of one lead often hold the same pairs: they are looked at together, so that these are compared once
    both = rows.join(contents, "id").select("lead", "tile", "id", "label", "side", "sketch", "size", "content")
    return both.repartition("lead").sortWithinPartitions("lead", "tile").mapInArrow(work, "a long, b long")
