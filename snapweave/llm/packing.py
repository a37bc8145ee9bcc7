"""Shortest-pack-first packing over the length histogram.

A document's ids are its tokens and one end id; null text counts as empty. Documents are cut every
`size` ids; the pieces' lengths are counted, and only that histogram (at most `size` rows) reaches the
driver. There lengths are placed longest first, always into the packs with most room, updating counts of
packing patterns instead of single packs. Patterns are joined back to pieces by rank: the r-th piece of a
length takes the r-th place that the patterns offer for it. Ranks are dealt in salted buckets (length,
bucket), with a running count over buckets, so one very common length does not land in one task.

Repeated rows are packed each; ties in rank are broken by a row number fixed in a checkpoint. An empty
table gives no sequence.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, checkpoint, slices

SIZE, END_ID, TOKENIZER = 2048, 1, "word_bpe_49k.json"
#: Pieces of one (length, bucket) on average at most, and buckets at least.
BUCKET_ROWS, MIN_BUCKETS = 200_000, 64


class WordIds(dict):
    """Chunk between white space -> its ids as little-endian uint32 bytes.

    Tokens never cross white space, so chunks can be encoded apart and remembered; at most MOST are kept.
    A closing . or , after a letter is a token by itself (no contraction ends so).
    """

    MOST = 400_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode

    def __missing__(self, chunk: bytes) -> bytes:
        if len(chunk) > 1 and chunk[-1] in b".," and chunk[-2:-1].isalpha() and len(chunk) < 64:
            ids = self[chunk[:-1]] + self[chunk[-1:]]
        else:
            ids = np.array(self.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) < self.MOST and len(chunk) < 64:
            self[chunk] = ids
        return ids


_word_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One cache per Python worker, kept between its tasks."""
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, *, size: int = SIZE, end_id: int = END_ID, tokenizer: str = TOKENIZER, text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: documents cut every `size` ids."""
    bound_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    id_type = dict(docs.dtypes)["doc_id"]

    def work(batches):
        ids_of = word_ids(tokenizer_path(tokenizer))
        get = ids_of.__getitem__
        for batch, texts in slices(batches):
            row, start, length, crc, total = [], [], [], [], []
            for i, t in enumerate(texts):
                ids = memoryview(b"".join(map(get, (t or b"").lower().split())) + end)
                n = len(ids) // 4
                for s in range(0, n, size):
                    part = ids[4 * s : 4 * min(n, s + size)]
                    row.append(i)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", F.col(text_col).alias("text")).mapInArrow(work, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """length -> pieces  =>  patterns (packs of this kind, [(length, times), ...] in order)."""
    open_by_room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for length in range(size, 0, -1):
        left = histogram.get(length, 0)
        while left:
            room = max((r for r in open_by_room if r >= length), default=None)
            if room is None:
                per = size // length
                for packs, times in ((left // per, per), (int(left % per > 0), left % per)):
                    if packs:
                        open_by_room.setdefault(size - times * length, []).append((packs, [(length, times)]))
                break
            packs, pattern = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
            used = min(packs, left)
            if used < packs:
                open_by_room.setdefault(room, []).append((packs - used, pattern))
            longer = [*pattern[:-1], (length, pattern[-1][1] + 1)] if pattern[-1][0] == length else [*pattern, (length, 1)]
            open_by_room.setdefault(room - length, []).append((used, longer))
            left -= used
    return [p for _, ps in sorted(open_by_room.items()) for p in ps]


class Places:
    """For the r-th piece of a length: the sequence and the offset in it."""

    def __init__(self, patterns: list[tuple[int, list[tuple[int, int]]]]):
        by_length: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        sequence = 0
        for packs, pattern in patterns:
            offset = 0
            for length, times in pattern:
                first = taken.get(length, 0)
                by_length.setdefault(length, []).append((first, sequence, times, offset))
                taken[length] = first + packs * times
                offset += length * times
            sequence += packs
        self.by_length = {k: np.array(v, np.int64).T for k, v in by_length.items()}
        self.sequences = sequence

    def at(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for k in np.unique(length):
            mine = np.nonzero(length == k)[0]
            first, base, times, start = self.by_length[int(k)]
            p = np.searchsorted(first, rank[mine], "right") - 1
            r = rank[mine] - first[p]
            sequence[mine] = base[p] + r // times[p]
            offset[mine] = start[p] + r % times[p] * k
        return sequence, offset


def pack(docs: DataFrame, *, size: int = SIZE, **kw) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece."""
    spark = docs.sparkSession
    cut = checkpoint(pieces(docs, size=size, **kw).withColumn("piece", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(shortest_pack_first(histogram, size)))
    buckets = max(MIN_BUCKETS, -(-max(histogram.values(), default=0) // BUCKET_ROWS))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("piece"), F.lit(buckets)))
    counts = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "piece"))
    ranked = cut.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def work(batches):
        for batch in batches:
            sequence, offset = places.value.at(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    types = dict(cut.dtypes)
    return ranked.select(*names, "rank").mapInArrow(work, ", ".join(f"{c} {types[c]}" for c in names) + ", sequence_id long, offset long")
