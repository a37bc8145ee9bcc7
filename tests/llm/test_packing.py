import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from snapweave.llm import packing


def ids_of(text):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def check(docs, got, size):
    """Every id lies in exactly one piece; sequences are gapless and no longer than size."""
    want = defaultdict(int)
    for d, t in docs:
        want[d, tuple(ids_of(t))] += 1
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for (d, ids), times in want.items():
        spans = sorted((r["start"], r["length"]) for r in pieces[d])
        assert spans == sorted((s, min(size, len(ids) - s)) for s in range(0, len(ids), size) for _ in range(times))
        for r in pieces[d]:
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert sum(len(p) for p in pieces.values()) == len(got)
    for spans in places.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end += n
        assert end <= size
    assert sorted(places) == list(range(len(places)))


def test_round_trip_small(spark):
    docs = [(1, "Hello, World! don't 'S it's 12 345"), (2, None), (3, ""), (4, "a. b, c."), (5, "É è ñ — “x”. don’t ß… é. İ ſ x.y, ..."), (6, "tab\tnew\nline\x0b\x0c\r\x1c x\x85y z"), (7, "<|endoftext|> x<|startoftext|>."), (8, "word " * 700)]
    docs += [(i, "same text") for i in range(9, 60)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, length string")
    got = packing.pack(df, size=64).collect()
    check(docs, got, 64)
    assert packing.pack(df.limit(0)).collect() == []


def test_given_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = packing.pack(df).collect()
    check([(r["doc_id"], r["text"]) for r in df.collect()], got, 2048)
    total, n = sum(r["length"] for r in got), len({r["sequence_id"] for r in got})
    assert n * 2048 - total < 0.03 * total + 2048


def test_shortest_pack_first():
    rnd = random.Random(1)
    for _ in range(50):
        size = rnd.choice([1, 7, 64])
        histogram = {rnd.randint(1, size): rnd.randint(1, 50) for _ in range(rnd.randint(0, 12))}
        patterns = packing.shortest_pack_first(histogram, size)
        placed = defaultdict(int)
        for packs, pattern in patterns:
            assert packs > 0 and sum(length * times for length, times in pattern) <= size
            for length, times in pattern:
                placed[length] += packs * times
        assert placed == histogram
    assert packing.shortest_pack_first({}, 8) == []
