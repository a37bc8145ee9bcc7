"""Helpers shared by the corpus operators: word splitting, hashing, checkpoints, bounded batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Every other byte as a space, so that translate and split give the same words faster.
WORD_BYTES = bytes(b if b >= 128 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: The same class for the JVM, over text in which A-Z are already lower case.
NOT_WORD_JAVA = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of one Arrow batch and bytes of text handled together inside a task; bytes of text whose shingles are hashed together (with arrays of ten times that and more).
BATCH_ROWS, BATCH_BYTES, GROUP_BYTES = 512, 8 << 20, 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: a few hundred rows of very long texts must fit a Python worker."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows for what is run meanwhile: a few numbers a row need no small batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, "10000")
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's shared folder if it names one; a temporary one only where none is set (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="snapweave-"))


def checkpoint(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Collect the driver's garbage: only then Spark removes the shuffle files and checkpoints of what is done, and unloads its generated classes."""
    spark.range(0, 1, 1, 1).count()  # the scheduler holds its last job, and with it that job's shuffle files
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def new_table(spark: SparkSession) -> str:
    """A path of its own in the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete what was written to a path of new_table(), when nothing reads it any more: Spark only cleans its own checkpoints."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """A checkpoint in columns: written to the checkpoint folder (path: of new_table()) as Parquet and read again, at a third of the bytes."""
    path = path or new_table(df.sparkSession)
    df.write.parquet(path)
    let_go(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(text: str | bytes | None) -> bytes:
    """UTF-8 with only A-Z lower-cased; null is empty."""
    if text is None:
        return b""
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).lower()


def words_of(text: str | bytes | None) -> list[bytes]:
    """WORD.findall of the folded text."""
    if text is None:
        return []
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).translate(WORD_BYTES).split()


def column_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def release_memory() -> None:
    """Give freed memory back to the system: Python workers live on from task to task, and would hold the most that any task took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Batches cut so that the texts handled together stay near BATCH_BYTES, however long they are."""
    for batch in batches:
        texts = column_bytes(batch.column(text))
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t or b"")
            if size >= BATCH_BYTES:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0
        if start < len(texts):
            yield batch.slice(start), texts[start:]
    batch = texts = None
    release_memory()


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (murmur3's constants)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Bytes as they are but A-Z lower-cased and white space as one kind: words are `[^ \t-\r]+`.
SPACE_BYTES = bytes(32 if b in b" \t\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_ROLL = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(41).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[32] = 0
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_ROLL ** i and its inverse, modulo 2 ** 64, for i < n."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_ROLL, pow(_ROLL, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run values[start:end] (order matters, place doesn't)."""
    up, down = powers(len(values) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes | None], table: bytes = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and each text's number of words. table maps separators to a space."""
    data = np.frombuffer(b" %b " % b" ".join(t or b"" for t in texts).translate(table), np.uint8)
    space = data == 32
    turn = np.flatnonzero(space[1:] != space[:-1]) + 1  # starts and ends by turns
    starts, ends = turn[::2], turn[1::2]
    edges = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    counts = np.diff(np.searchsorted(starts, edges + 1))
    return rolled(_VALUES[data], starts, ends), counts


def groups(texts: list, most: int = 1 << 20):
    """Index ranges of texts of about `most` bytes together."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"") + 1
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Per text the distinct 64-bit hashes of its n-word shingles, sorted; fewer words are one shingle, none for no words."""
    out = []
    for a, b in groups(texts, GROUP_BYTES):
        h, counts = word_hashes(texts[a:b], SPACE_BYTES)
        long = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for j in range(n):
            long = (long + h[j : j + len(long)]) * np.uint64(_ROLL)
        long = mix(long)
        at = 0
        for m in counts.tolist():
            out.append(np.unique(long[at : at + m - n + 1]) if m >= n else rolled(h[at : at + m], np.array([0]), np.array([m])) if m else np.empty(0, np.uint64))
            at += m
    return out
