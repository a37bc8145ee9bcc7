import random

from snapweave.llm import near_dup
from snapweave.llm.components import components


def shingles(text, k=5):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, percent):
    sets = [shingles(t) for _, t in docs]
    comp = list(range(len(docs)))

    def root(i):
        while comp[i] != i:
            comp[i] = comp[comp[i]]
            i = comp[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                comp[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[root(i)] = min(low.get(root(i), d), d)
    return {(d, len(sets[i]), low[root(i)], d == low[root(i)]) for i, (d, _) in enumerate(docs)}


def corpus():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    docs = [None, "", " \n ", "one", "One", "two words", "a b c", "a b c", "x " * 3000]
    for _ in range(12):
        base = [word() for _ in range(rnd.choice([8, 60, 200]))]
        for _ in range(12):
            w = list(base)
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(len(w))] = word()
            docs.append(" ".join(w))
    rnd.shuffle(docs)
    return [(i * 3 + 1, t) for i, t in enumerate(docs)]


def test_against_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, 1, b"x") for d in docs], "doc_id long, text string, digest int, sketch binary")
    for percent in (80, 85):
        assert {tuple(r) for r in near_dup.near_duplicates(df, percent=percent).collect()} == brute(docs, percent)


def test_large_bucket_in_small_tiles(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in near_dup.near_duplicates(df, percent=85, block=4, tile_bytes=4000).collect()} == brute(docs, 85)


def test_given_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()], 85)
    got = {tuple(r) for r in near_dup.near_duplicates(df, percent=85).collect()}
    assert got == want and any(not r[3] for r in want)


def test_empty_nulls_repeats(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, None), (2, "a b")], "doc_id long, text string")
    got = sorted(map(str, near_dup.near_duplicates(df).collect()))
    assert got == sorted(map(str, near_dup.near_duplicates(df).collect())) and len(got) == 5
    assert sorted(r["doc_id"] for r in near_dup.near_duplicates(df).where("kept").collect()) == [1, 1]
    assert near_dup.near_duplicates(df.limit(0)).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)] + [(500, x) for x in range(501, 560)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, **{i: 500 for i in range(500, 560)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
