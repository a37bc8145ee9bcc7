import zlib

import numpy as np

from snapweave.llm import lang_id, lm_score, quality
from snapweave.llm.sampling import held_out


def test_fold_is_the_crc(spark):
    for r in spark.range(50).withColumnRenamed("id", "doc_id").withColumn("h", held_out()).collect():
        assert r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    rows = lang_id.identify(docs, keep=("doc_id", "lang")).withColumn("h", held_out()).where("h").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98 and len(rows) > 100
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(9001, None, "en"), (9002, "", None), (9003, "123 !?", "fr"), (9004, "Z", None), (9004, "Z", None), (None, "the of and", None), (9005, "ab " * 400_000, None)], "doc_id long, text string, lang string")
    model = lang_id.learn(docs)
    got = lang_id.identify(odd.withColumn("score", odd["doc_id"]), model=model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 7 and [by[i]["lang_pred"] for i in (9001, 9002, 9003)] == ["und"] * 3 and by[9004]["lang_pred"] in model.langs and by[9005]["lang_pred"] in model.langs
    unlabelled = odd.withColumn("lang", odd["lang"].substr(9, 1))
    assert {r["lang_pred"] for r in lang_id.identify(odd.where("lang is null").select("doc_id", "text", "lang")).collect()} == {"und"} and unlabelled.count() == 7
    assert lang_id.identify(docs.limit(0)).collect() == []
    assert {r["doc_id"] for r in lang_id.drop_unidentified(odd, model=model).collect()} == {r["doc_id"] for r in got if not r["ambiguous"]}


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9, 30):
        code = lang_id.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n == 2 else 2) and not (code == code[0]).all(axis=0).any()


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return (pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean()


def test_quality_held_out(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = {r["doc_id"]: r for r in quality.score(docs, labels).collect()}
    rows = [(r["quality"], scored[r["doc_id"]]) for r in labels.collect() if scored[r["doc_id"]]["held_out"]]
    y, s = np.array([r[0] for r in rows]), np.array([r[1]["score"] for r in rows])
    assert auc(y, s) > 0.97 and ((s >= 0.3) == y).mean() > 0.95
    assert len(scored) == docs.count() and all(r["predicted"] == (r["score"] >= 0.3) for r in scored.values())


def test_quality_edges(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(9001, None, None), (9002, "", 0), (9003, "w " * 300_000, 5), (9003, "w", -1), (None, "x", 1)], "doc_id long, text string, n_chars long")
    model = quality.learn(docs, labels)
    got = quality.score(odd, labels, model=model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.score(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.score(docs.limit(0), labels).collect() == []


def test_sum_of_squares_identity():
    rnd = np.random.default_rng(1)
    d = quality.BUCKETS + len(quality.STATS) + quality.LENGTHS
    fm = quality.FactorisationMachine(0.3, rnd.normal(size=d), rnd.normal(size=(d, quality.FACTORS)), np.zeros(len(quality.STATS)), np.ones(len(quality.STATS)))
    x = np.zeros((1, d))
    some = rnd.choice(d, 12, replace=False)
    x[0, some] = rnd.normal(size=12)
    pairs = sum(x[0, i] * x[0, j] * fm.factors[i] @ fm.factors[j] for a, i in enumerate(some) for j in some[:a])
    assert np.allclose(fm.margin(x)[0], 0.3 + x[0] @ fm.linear + pairs)


def test_language_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    words, counts = lm_score.vocabulary(docs)
    net = lm_score.train(docs, words, counts)
    texts = [r["text"].encode() for r in docs.limit(100).collect()]
    ids, n = lm_score.Ids(words).of(texts)
    at = np.flatnonzero(ids < lm_score.SIZE)
    plain = lm_score.Network.first(counts)
    assert net.log_probs(ids, at).mean() > plain.log_probs(ids, at).mean()
    # probabilities of all words in one place add up to one
    probe = np.tile(ids[:5], (lm_score.SIZE, 1)).copy()
    probe[:, 2] = np.arange(lm_score.SIZE)
    total = np.exp([net.log_probs(p, np.array([2]))[0] for p in probe]).sum()
    assert abs(total - 1) < 1e-3
    # order matters: shuffled words are less likely on the whole
    rows = {r["doc_id"]: r for r in lm_score.score(docs).collect()}
    assert len(rows) == docs.count() and all(r["log_prob"] <= 0 for r in rows.values())


def test_language_model_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "one"), (4, "one"), (None, "two one"), (5, "w " * 200_000)], "doc_id long, text string")
    got = lm_score.score(docs.withColumn("n_words", docs["doc_id"])).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 7 and by[1]["n_words"] == by[2]["n_words"] == by[3]["n_words"] == 0 and by[1]["perplexity"] is None and by[5]["n_words"] == 200_000
    assert lm_score.score(docs.limit(0)).collect() == []
