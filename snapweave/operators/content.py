"""Content kernels: content-defined chunking, block codec, verification.

Bytes cross into Python once, by the Arrow batch; offsets and digests come out. The rolling value depends on
the last 64 bytes only, so all values of a buffer are built by six doubling passes over a numpy array, and
cut points are looked up instead of walked byte by byte. Content addresses are SHA-256.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema

#: Fixed value: the rule's seed and multipliers; the table follows from them.
GEAR_SEED = 0x9E3779B97F4A7C15


def gear_table(seed: int = GEAR_SEED) -> np.ndarray:
    """256 values of the SplitMix64 sequence."""
    z = np.uint64(seed) + np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@dataclass(frozen=True)
class Sizes:
    least: int = schema.CHUNK_MIN
    average: int = schema.CHUNK_AVG
    most: int = schema.CHUNK_MAX
    normal: int = schema.CHUNK_NORMAL

    def __post_init__(self):
        if not 64 <= self.least < self.average < self.most:
            raise ValueError("chunk sizes must satisfy 64 <= least < average < most")

    @property
    def limits(self) -> tuple[np.uint64, np.uint64]:
        """Below the first a cut is made before the average size, below the second after it."""
        bits = self.average.bit_length() - 1
        return np.uint64(1 << (64 - bits - self.normal)), np.uint64(1 << (64 - bits + self.normal))


_GEAR = gear_table()


def cut_points(data: bytes, sizes: Sizes) -> list[int]:
    """End offsets of the chunks of a buffer."""
    n, ends, start = len(data), [], 0
    if n == 0:
        return ends
    g = _GEAR[np.frombuffer(data, np.uint8)]
    rolled = g.copy()
    for k in range(6):
        w = 1 << k
        rolled[w:] = rolled[w:] + (rolled[:-w] << np.uint64(w))
    early, late = sizes.limits
    early_at, late_at = np.nonzero(rolled < early)[0], np.nonzero(rolled < late)[0]
    while start < n:
        if n - start <= sizes.least:
            ends.append(n)
            break
        first, middle, last = start + sizes.least, min(start + sizes.average, n), min(start + sizes.most, n)
        end = 0
        # the rolling value starts at zero at `first`: its first 63 values are not those of the whole buffer
        value = 0
        for i in range(first, min(first + 63, last)):
            value = (2 * value + int(g[i])) & 0xFFFFFFFFFFFFFFFF
            if value < (int(early) if i < middle else int(late)):
                end = i + 1
                break
        if not end:
            for where, lo, hi in ((early_at, first + 63, middle), (late_at, max(middle, first + 63), last)):
                k = np.searchsorted(where, lo)
                if k < len(where) and where[k] < hi:
                    end = int(where[k]) + 1
                    break
        end = end or last
        ends.append(end)
        start = end
    return ends


def chunk(files: DataFrame, *, id_col: str = "path", content_col: str = "content", sizes: Sizes = Sizes()) -> DataFrame:
    """id, ord, offset, length, digest: every chunk of every file. Empty or null content has no chunks."""
    id_type = dict(files.dtypes)[id_col]

    def work(batches):
        for batch in batches:
            for i, data in enumerate(batch.column("_content").to_pylist()):
                ends = cut_points(data or b"", sizes)
                starts = [0, *ends[:-1]]
                if ends:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(id_col).take(pa.array([i] * len(ends), pa.int32())), pa.array(range(len(ends)), pa.int32()), pa.array(starts, pa.int64()), pa.array([e - s for s, e in zip(starts, ends)], pa.int64()), pa.array([hashlib.sha256(data[s:e]).hexdigest() for s, e in zip(starts, ends)])],
                        [id_col, "ord", "offset", "length", "digest"],
                    )

    rows = files.select(id_col, F.col(content_col).cast("binary").alias("_content"))
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= 256:
        conf.set(name, 256)  # whole files: few per batch
    return rows.mapInArrow(work, f"`{id_col}` {id_type}, ord int, offset long, length long, digest string")


def file_digests(files: DataFrame, chunks: DataFrame, *, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """id, size, digest of the whole content, ordered digests of the chunks."""
    ordered = chunks.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "digest"))), lambda x: x["digest"]).alias("chunks"))
    whole = files.select(id_col, F.octet_length(content_col).cast("long").alias("size"), F.sha2(F.col(content_col).cast("binary"), 256).alias("digest"))
    return whole.join(ordered, id_col, "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<string>")))


def verify(expected: DataFrame, blobs: DataFrame) -> DataFrame:
    """expected (path, size, digest, chunks), blobs (digest, content) -> path, verdict.

    In order: a chunk is missing, a chunk's content has another digest, the ordered whole has another digest,
    another size, ok.
    """
    parts = expected.select("path", F.posexplode("chunks").alias("ord", "chunk")).join(blobs.select(F.col("digest").alias("chunk"), "content"), "chunk", "left")
    bad = F.sha2("content", 256) != F.col("chunk")
    whole = F.array_sort(F.collect_list(F.struct("ord", F.coalesce("content", F.lit(b"")).alias("content"))))
    joined = F.aggregate(whole, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["content"]))
    seen = parts.groupBy("path").agg(F.count_if(F.col("content").isNull()).alias("missing"), F.count_if(bad).alias("corrupt"), joined.alias("whole"))
    rows = expected.join(seen, "path", "left").withColumn("whole", F.coalesce("whole", F.lit(b"").cast("binary")))
    verdict = F.when(F.col("missing") > 0, "missing_chunk").when(F.col("corrupt") > 0, "corrupt_chunk").when((F.coalesce("digest", F.lit("")) != "") & (F.sha2("whole", 256) != F.col("digest")), "digest_mismatch").when(F.octet_length("whole") != F.col("size"), "size_mismatch").otherwise("ok")
    return rows.select("path", verdict.alias("verdict"))


# Block format: version, flags (1: compressed), length of the plain bytes as a variable-length integer, payload.
VERSION, COMPRESSED, MOST_PLAIN = 1, 1, 64 << 20


def encode(plain: bytes) -> bytes:
    import zstandard

    packed = zstandard.ZstdCompressor().compress(plain)
    small = len(packed) < len(plain)
    n, size = len(plain), bytearray()
    while n >= 0x80:
        size.append(n & 0x7F | 0x80)
        n >>= 7
    size.append(n)
    return bytes([VERSION, COMPRESSED if small else 0]) + bytes(size) + (packed if small else plain)


def decode(block: bytes) -> bytes:
    import zstandard

    if len(block) < 3:
        raise ValueError("malformed block")
    if block[0] != VERSION:
        raise ValueError("unknown block version")
    if block[1] & ~COMPRESSED:
        raise ValueError("block needs a key")
    n = shift = 0
    at = 2
    while True:
        if at >= len(block) or shift > 63:
            raise ValueError("malformed block")
        n |= (block[at] & 0x7F) << shift
        shift, at = shift + 7, at + 1
        if not block[at - 1] & 0x80:
            break
    if n > MOST_PLAIN:
        raise ValueError("malformed block")
    plain = zstandard.ZstdDecompressor().decompress(block[at:], max_output_size=n or 1) if block[1] & COMPRESSED else block[at:]
    if len(plain) != n:
        raise ValueError("block length mismatch")
    return plain


def encoded(blobs: DataFrame) -> DataFrame:
    """blobs (digest, content) -> digest, block, plain_bytes, stored_bytes."""

    def work(batches):
        for batch in batches:
            blocks = [encode(c or b"") for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(blocks, pa.binary())], ["digest", "block"])

    out = blobs.select("digest", F.col("content").cast("binary").alias("content")).mapInArrow(work, "digest string, block binary")
    return out.withColumn("stored_bytes", F.octet_length("block").cast("long"))


def decoded(blocks: DataFrame) -> DataFrame:
    """blocks (digest, block) -> digest, content, problem ('' if the block is sound)."""

    def work(batches):
        for batch in batches:
            contents, problems = [], []
            for b in batch.column("block").to_pylist():
                try:
                    contents.append(decode(b or b""))
                    problems.append("")
                except Exception as e:  # a damaged payload raises the library's own error
                    contents.append(None)
                    problems.append(str(e) if isinstance(e, ValueError) else "malformed block")
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(contents, pa.binary()), pa.array(problems)], ["digest", "content", "problem"])

    return blocks.select("digest", "block").mapInArrow(work, "digest string, content binary, problem string")
