import numpy as np

from snapweave.llm import ann


def brute(rows, queries, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, x in good:
        if q in queries:
            near = sorted(((-float((x * y).sum()), i) for i, y in good if i != q and len(y) == len(x)))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return out


def test_against_brute_force(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(size=16) * (10.0 ** rnd.integers(-3, 3))]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 360)] + [(400, [0.0] * 16), (401, None), (402, [1.0] * 15 + [None]), (403, [float("nan")] * 16), (404, [float("inf")] * 16), (None, [1.0] * 16), (420, [1.0, 2.0]), (440, [3.0, -1.0]), (460, [])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, v int")
    want = brute(rows, {i for i, _ in rows if i is not None and i % 20 == 0}, 20)
    for blocks in ({}, {"query_bytes": 600, "first": 64}):
        got = sorted(tuple(r) for r in ann.self_search(df, **blocks).collect())
        assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
        assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], rtol=1e-12)
    assert ann.self_search(df.limit(0)).collect() == []


def test_given_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = sorted(brute(rows, {i for i, _ in rows if i % 20 == 0}, 20))
    got = sorted(tuple(r) for r in ann.self_search(df, first=100).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_extreme_magnitudes_lose_nobody(spark):
    rows = [(20, [1e300, 1.0]), (1, [1e300, 1e-320]), (2, [1e-320, 0.0]), (3, [1.0, 2.0]), (4, [-1e300, 5.0]), (5, [1e-300, 1e-300]), (40, [1e-320, -1e-320])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for first in (1, 1 << 16):
        got = ann.self_search(df, first=first).collect()
        assert {(r["query_id"], r["vec_id"]) for r in got} == {(q, i) for q in (20, 40) for i, _ in rows if i != q}
        top = {(r["query_id"], r["rank"]): r for r in got}
        assert top[20, 1]["vec_id"] == 1 and top[20, 1]["score"] == float("inf") and top[20, 6]["vec_id"] == 4 and top[40, 6]["vec_id"] == 4


def test_repeated_ids(spark):
    df = spark.createDataFrame([(0, [2.0, 0.0]), (0, [1.0, 0.0]), (1, [3.0, 1.0]), (1, [4.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in ann.self_search(df).collect()) == [(1, 1, 4.0), (2, 1, 3.0), (3, 2, 0.0)]
