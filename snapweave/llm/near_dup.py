"""MinHash near-duplicates with odd sketches.

A document's set: distinct hashes of its k-word shingles over `[^ \\t-\\r]+` words, A-Z lower-cased; fewer
words are one shingle; no words or null text: an empty set, linked with nothing. Documents are linked when
100 * |A & B| >= percent * |A | B|, decided on full sets. MinHash bands nominate; the odd sketch (parity
bitmap of the MinHash samples; the population count of an XOR estimates the distance) rejects what is five
standard deviations of the estimate below the threshold before any full set is fetched.

Documents with equal sets form a class, found by grouping on a 128-bit digest; only class
representatives enter the bands, so thousands of copies cost one row each. Every representative is first
compared with the centre it shares most bands with; buckets that then still hold several components are
settled in place, in tiles of bounded rows and bytes (linking.py). Components are therefore those of
the full link graph, up to the bands' miss probability ((1 - s^rows)^bands: at most MISS just at the threshold,
1e-7 at 0.9) and the sketch's.

Ties and repeats: rows that share a doc_id are one node. Null doc_id: such rows may lend their text to no
one; component_id null, kept false. Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, checkpoint, mix, odd_constants, shingle_sets, slices
from .linking import connect
from .tiles import Gate

SHINGLE, ROWS, SKETCH_BITS = 5, 7, 1024
#: Chance that a pair just at the threshold shares no band.
MISS = 5e-6
#: Ids sent to every executor at most (a long each); more are joined by shuffle.
MAX_BROADCAST_IDS = 2_000_000


def bands_for(percent: int) -> int:
    return int(np.ceil(np.log(MISS) / np.log1p(-((percent / 100) ** ROWS)))) if percent < 100 else 1


def max_sketch_distance(percent: int, deviations: float = 5.0) -> int:
    """Largest XOR population count of a pair at the threshold, that many standard deviations out."""
    k, n, far = bands_for(percent) * ROWS, SKETCH_BITS, 1 - percent / 100
    left = np.exp(-4 * k * far / n)
    expected = n / 2 * (1 - left)
    by_samples = 2 * k * left * (far * (1 - far) / k) ** 0.5
    by_folding = (expected * (1 - expected / n)) ** 0.5
    return int(np.ceil(expected + deviations * np.hypot(by_samples, by_folding)))


class Signer:
    """MinHash with a permutation of its own for every sample, so that samples are independent for sets of every size."""

    def __init__(self, percent: int):
        self.n_bands = bands_for(percent)
        k = self.n_bands * ROWS
        self.add, self.times = odd_constants(k, 21)[:, None], odd_constants(k, 22)[:, None]
        self.c = odd_constants(ROWS, 23)
        self.band = odd_constants(self.n_bands, 24)
        self.slot = odd_constants(k, 25)

    def samples(self, s: np.ndarray) -> np.ndarray:
        out = np.full(len(self.add), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(s), 256):  # a block stays in the cache
            x = s[i : i + 256] + self.add
            x *= self.times
            x ^= x >> np.uint64(32)
            x *= self.times
            np.minimum(out, x.min(axis=1), out=out)
        return out

    def bands(self, samples: np.ndarray) -> np.ndarray:
        m = samples.reshape(-1, self.n_bands, ROWS)
        return mix((mix(m + self.c) * self.c).sum(axis=2, dtype=np.uint64) + self.band).astype(np.int64)

    def sketch(self, samples: np.ndarray) -> np.ndarray:
        at = (mix(samples * self.slot + self.slot) % np.uint64(SKETCH_BITS)).astype(np.int64)
        return np.packbits((np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.uint64)


def _signatures(docs: DataFrame, percent: int, shingle: int, text_col: str) -> DataFrame:
    """doc_id, n_shingles, digest of the set, and for non-empty sets bands and sketch."""

    def work(batches):
        signer = Signer(percent)
        for batch, texts in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            n, digests, bands, sketches = [], [], [], []
            for i, s in zip(ids, shingle_sets(texts, shingle)):
                n.append(len(s))
                if len(s):
                    low = signer.samples(s)
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(signer.bands(low)[0])
                    sketches.append(signer.sketch(low).view(np.int64))
                else:
                    digests.append(b"empty:" + str(i).encode())
                    bands.append(None)
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", "bands", "sketch"],
            )

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return columns.mapInArrow(work, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, ids: DataFrame, shingle: int, text_col: str) -> DataFrame:
    """(id, content) of the documents named in ids: their sets, hashed anew from their whole texts."""
    wanted = checkpoint(ids.select(F.col("id").alias("doc_id")).distinct())
    if wanted.count() <= MAX_BROADCAST_IDS:
        wanted = F.broadcast(wanted)

    def work(batches):
        for batch, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(texts, shingle)], pa.binary())], ["id", "content"])

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return columns.join(wanted, "doc_id", "left_semi").mapInArrow(work, "id long, content binary").dropDuplicates(["id"])


def similar(xs: list[bytes], ys: list[bytes], percent: int) -> list[bool]:
    """Which pairs of sets (sorted, distinct longs as bytes) reach the similarity."""
    out = []
    for x, y in zip(xs, ys):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = np.sort(np.concatenate([x, y]), kind="stable")
        both = int((both[1:] == both[:-1]).sum())
        out.append(100 * both >= percent * (len(x) + len(y) - both))
    return out


def near_duplicates(docs: DataFrame, *, percent: int = 80, shingle: int = SHINGLE, text_col: str = "text", **kw) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept. kw: the bounds of connect()."""
    bound_batches(docs.sparkSession)
    signed = checkpoint(_signatures(docs, percent, shingle, text_col))
    # written, so that joins on the digest of many copies read plain exchanges, which can be split where they are skewed
    classes = checkpoint(signed.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    reps = (
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL").join(classes.withColumnRenamed("rep", "doc_id"), ["digest", "doc_id"], "left_semi")
        .select(F.col("doc_id").alias("id"), "bands", "sketch", F.col("n_shingles").cast("int").alias("size")).dropDuplicates(["id"])
    )
    reps = checkpoint(reps)
    labels = connect(
        reps.select("id", F.explode("bands").alias("key")), reps.select("id", "sketch", "size"), words=SKETCH_BITS // 64, gate=Gate(max_sketch_distance(percent), percent / 100),
        contents=lambda ids: _sets(docs, ids, shingle, text_col), same=lambda xs, ys: similar(xs, ys, percent), unit=8, **kw,
    )
    member = signed.select("doc_id", "n_shingles", "digest").join(classes, "digest")
    if labels is None:
        out = member.withColumn("component_id", F.col("rep"))
    else:
        out = member.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **kw) -> DataFrame:
    """One row of each group stays: the one with the smallest doc_id (of rows that share it, all). Rows with a null doc_id stay. Columns unchanged."""
    gone = near_duplicates(docs, **kw).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
