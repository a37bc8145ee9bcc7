"""Nearest neighbours by a block matrix join with int8 tiles and exact recomputation.

Queries go to every executor in chunks of bounded bytes, one chunk at a time; the candidates are scanned where they
lie, without a shuffle. A tile is a block of queries against a block of candidates: both sides are int8-quantised
per vector (after scaling by a power of two, so that no magnitude over- or underflows), tile products give inner
products with an error bound (|x-x'||y'| + |x||y-y'|), and pairs whose upper bound reaches the query's bar are
recomputed in double precision on the original vectors. The bar is the k-th best lower bound seen so far: within the task, and
before that among a share of the candidates chosen by a hash of the id, which is searched first, so that tasks
emit few rows. A task keeps the k best of each query; they are merged by rank. No candidate that could count is
skipped, so the result is exact. What is sent of a chunk doesn't grow with the table; the rows emitted grow
with the queries.

Vectors that are null, zero, or hold null or non-finite components take no part; vectors of another
length than a query's are no candidates of it. Rows with the query's own id are not its candidates. An id that
stands in several query rows is one query, asked with the least of their vectors; candidate rows count one by one. Ties go
to the smaller id. Sums that overflow are infinite; such that are no number rank last. Fewer than k candidates: all of them. Empty
table: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bytes of the doubles of a chunk of queries, rows of the sides of a tile, candidates searched first.
QUERY_BYTES, QUERY_BLOCK, CANDIDATE_BLOCK, FIRST = 16 << 20, 1024, 2048, 1 << 16


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return named.where(F.col("id").isNotNull() & F.col("v").isNotNull() & good & F.exists("v", lambda x: x != 0))


class Quantised:
    """int8 codes (as float32, for exact BLAS products) of scaled vectors, and what their error bounds need."""

    def __init__(self, x: np.ndarray):
        self.exponent = np.frexp(np.abs(x).max(axis=1))[1]
        x = np.ldexp(x, -self.exponent[:, None])
        self.scale = np.abs(x).max(axis=1) / 127
        codes = np.rint(x / self.scale[:, None])
        back = codes * self.scale[:, None]
        self.codes = codes.astype(np.float32)
        self.norm, self.error, self.full = (np.linalg.norm(v, axis=1) for v in (back, x - back, x))


def bounds(q: Quantised, c: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products, in units of each query's power of two."""
    step = (1 << 24) // (127 * 127)  # products of more components could leave float32's exact integers
    product = sum((q.codes[:, d : d + step] @ c.codes[:, d : d + step].T).astype(np.float64) for d in range(0, q.codes.shape[1], step))
    product *= q.scale[:, None]
    product *= c.scale[None, :]
    slack = (q.full[:, None] * c.error[None, :] + q.error[:, None] * c.norm[None, :]) * (1 + 1e-9) + 1e-12 * q.full[:, None] * c.full[None, :]
    with np.errstate(over="ignore", under="ignore"):
        return np.ldexp(product - slack, c.exponent[None, :]), np.ldexp(product + slack, c.exponent[None, :])


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, the same for equal rows wherever they stand."""
    with np.errstate(all="ignore"):
        return np.ascontiguousarray(x * y).sum(axis=1)


class Best:
    """The k best candidates so far of each of a block of queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, bar: np.ndarray | None = None):
        self.ids, self.x, self.k, self.q = ids, x, k, Quantised(x)
        self.row, self.found, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.bar = np.full(len(ids), -np.inf) if bar is None else bar.copy()  # in units of the query's power of two

    def look(self, ids: np.ndarray, y: np.ndarray, c: Quantised) -> None:
        low, high = bounds(self.q, c)
        own = self.ids[:, None] == ids[None, :]
        if len(ids) > self.k:
            low[own] = -np.inf
            np.maximum(self.bar, np.partition(low, len(ids) - self.k, axis=1)[:, len(ids) - self.k], out=self.bar)
        rows, cols = np.nonzero(~(high < self.bar[:, None]) & ~own)
        if not len(rows):
            return
        score = np.concatenate([exact(self.x[rows[i : i + 65536]], y[cols[i : i + 65536]]) for i in range(0, len(rows), 65536)])
        row, found, score = np.append(self.row, rows), np.append(self.found, ids[cols]), np.append(self.score, score)
        order = np.lexsort((found, -np.nan_to_num(score, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.isnan(score), row))
        row, found, score = row[order], found[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.row, self.found, self.score = row[keep], found[keep], score[keep]
        last = place == self.k - 1
        # scores at the edge of what a double holds are rounded too coarsely to be compared with bounds
        sure = last & (np.abs(score) < 1e290) & (np.abs(score) > 1e-290)
        at = row[sure]
        with np.errstate(over="ignore"):
            worth = np.ldexp(score[sure], -self.q.exponent[at])
        np.maximum.at(self.bar, at, worth - 1e-12 * np.abs(worth))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch):
    """(ids, matrix) of the rows of each vector length, in blocks."""
    v, sizes = batch.column("v"), np.asarray(pc.list_value_length(batch.column("v")))
    ids = batch.column("id").to_numpy()
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        for s in range(0, len(at), CANDIDATE_BLOCK):
            part = at[s : s + CANDIDATE_BLOCK]
            yield ids[part], _matrix(v.take(pa.array(part)))


def _search(chunk: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]], candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): each task's best candidates of the chunk's queries."""
    shared = candidates.sparkSession.sparkContext.broadcast(chunk)

    def work(batches):
        best = [Best(ids[s : s + QUERY_BLOCK], x[s : s + QUERY_BLOCK], k, None if bar is None else bar[s : s + QUERY_BLOCK]) for ids, x, bar in shared.value for s in range(0, len(ids), QUERY_BLOCK)]
        for batch in batches:
            for ids, y in _by_length(batch):
                c = None
                for b in best:
                    if b.x.shape[1] == y.shape[1]:
                        c = c or Quantised(y)
                        b.look(ids, y, c)
        for b in best:
            yield pa.RecordBatch.from_arrays([pa.array(b.ids[b.row]), pa.array(b.found), pa.array(b.score)], ["query_id", "vec_id", "score"])

    return candidates.mapInArrow(work, "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, candidates: DataFrame, *, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", query_bytes: int = QUERY_BYTES, first: int = FIRST) -> DataFrame:
    """query_id, rank, vec_id, score."""
    q, c = usable(queries, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v")), usable(candidates, id_col, vec_col)
    size = q.agg(F.sum(F.size("v").cast("long") * 8)).first()[0] or 0
    chunks, parts = max(1, -(-size // query_bytes)), max(1, c.count() // first)
    found = None
    for n in range(chunks):
        t = (q if chunks == 1 else q.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(chunks)) == n)).toArrow().combine_chunks()
        chunk = [(ids, x, None) for batch in t.to_batches() for ids, x in _by_length(batch)]
        if parts > 1:
            some = _top(_search(chunk, c.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(parts)) == 0), k), k)
            bars = {r["query_id"]: r["score"] for r in some.where((F.col("rank") == k) & (F.abs("score") < 1e290) & (F.abs("score") > 1e-290)).collect()}
            chunk = [(ids, x, np.array([_bar(bars.get(i), v) for i, v in zip(ids.tolist(), x)])) for ids, x, _ in chunk]
        got = _search(chunk, c, k)
        got = got if chunks == 1 else written(_top(got, k).drop("rank"))
        found = got if found is None else found.unionByName(got)
    return _top(found, k).select("query_id", "rank", "vec_id", "score")


def _bar(score: float | None, v: np.ndarray) -> float:
    """A score as a bar in units of the query's power of two, a little below it."""
    if score is None:
        return -np.inf
    worth = np.ldexp(score, -int(np.frexp(np.abs(v).max())[1]))
    return float(worth - 1e-12 * abs(worth))


def self_search(vectors: DataFrame, *, every: int = 20, k: int = 20, **kw) -> DataFrame:
    """Queries: the rows whose vec_id is divisible by `every`; candidates: every row."""
    return nearest(vectors.where(F.col("vec_id") % every == 0), vectors, k=k, **kw)
