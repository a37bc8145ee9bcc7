"""What a Python worker takes while it hashes texts, and that runs of tiles are bounded."""

import tracemalloc

import numpy as np
import pyarrow as pa

from snapweave.llm import common, lang_id, tiles


def test_hashing_takes_little_beside_the_sets():
    text = b" ".join(b"w%d" % i for i in range(18000))  # about 120 kB
    texts = [text[i:] for i in range(16)]
    common.shingle_sets(texts[:1], 5)
    tracemalloc.start()
    sets = common.shingle_sets(texts, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(sets) == 16 and all(len(s) > 17000 for s in sets)
    assert peak - sum(s.nbytes for s in sets) < 24 << 20


def test_runs_are_whole_tiles_of_few_bytes():
    content = pa.array([bytes(1 << 20)] * 24, pa.binary())
    tile = np.repeat(np.arange(12), 2)
    batches = pa.RecordBatch.from_arrays([pa.array(tile), content], ["tile", "content"])
    got = list(tiles.runs(iter([batches.slice(i, 3) for i in range(0, 24, 3)])))
    assert np.concatenate([r.column("tile").to_numpy() for r in got]).tolist() == tile.tolist()
    assert all(r.column("tile").to_numpy().tolist().count(t) == 2 for r in got for t in set(r.column("tile").to_numpy().tolist()))
    assert max(r.num_rows for r in got) <= 8


def test_training_gives_the_drivers_memory_back(spark, monkeypatch):
    given = []
    monkeypatch.setattr(lang_id, "release_memory", lambda: given.append(1))
    docs = [(i, lang, text) for i in range(20) for lang, text in (("en", f"the house and the river {i}"), ("de", f"das haus und der fluss {i}"))]
    assert lang_id.learn(spark.createDataFrame(docs, "doc_id long, lang string, text string")) is not None and given == [1]
