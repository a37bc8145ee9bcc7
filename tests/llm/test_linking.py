"""Which rows share keys, and which pairs of a tile are looked at."""

import numpy as np
import pyarrow as pa

from snapweave.llm import linking, tiles


def test_shared_keys_hold_every_id_once(spark):
    rows = [(1, 7), (1, 7), (1, 7), (2, 8), (3, 8), (2, 8), (4, 9), (5, 5), (4, 5), *((i, 1) for i in range(50)), *((i, 1) for i in range(50))]
    want = {(8, 2, 2), (8, 3, 2), (5, 4, 4), (5, 5, 4)} | {(1, i, 0) for i in range(50)}
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    for size in (1, 2, 3, 1000):  # a key may go on in the next batches
        spark.conf.set(name, size)
        got = [tuple(r) for r in linking.shared(spark.createDataFrame(rows, "id long, key long")).collect()]
        assert len(got) == len(want) and set(got) == want
    spark.conf.set(name, before)


def test_small_tiles_together_give_the_pairs_of_each(monkeypatch):
    rnd = np.random.default_rng(1)
    n = 3000
    tile = np.sort(np.where(rnd.random(n) < 0.1, 0, rnd.integers(0, 900, n)))
    run = pa.table({
        "tile": tile, "id": rnd.integers(0, 2000, n), "label": rnd.integers(0, 9, n), "side": rnd.integers(0, 3, n).astype(np.int32),
        "sketch": pa.array([x.tolist() for x in rnd.integers(0, 1 << 62, (n, 2))], pa.list_(pa.int64())), "size": rnd.integers(90, 100, n).astype(np.int32),
    })
    gate = tiles.Gate(62, 0.95, 92)
    _, labels, sides, sizes, words = tiles._numpy(run)
    want = []
    for s, e in zip(*tiles._tiles(run)):
        want += [(i + s, j + s, d) for x in tiles.near(labels[s:e], sides[s:e], sizes[s:e], words[s:e], gate) for i, j, d in zip(*x)]
    for pairs in (1 << 17, 300):
        monkeypatch.setattr(tiles, "PAIRS", pairs)
        got = [p for x in tiles.mates(run, gate) for p in zip(*x)]
        assert sorted(got) == sorted(want) and want
