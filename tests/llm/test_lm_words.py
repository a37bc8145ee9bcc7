import numpy as np

from snapweave.llm import lm_score
from snapweave.llm.common import word_hashes


def test_words_in_buckets_cost_their_share_of_the_bucket(spark):
    common = " ".join(" ".join([f"w{i}"] * 9) for i in range(lm_score.SIZE - lm_score.HASHED))
    rare = [f"r{i}" for i in range(300)]
    docs = [(1, common), (2, " ".join(rare)), (3, "r0 r0 w1"), (3, "r0 r0 w1"), (4, "w5 w6"), (5, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    words, counts = lm_score.vocabulary(df)
    net = lm_score.train(df, words, counts)
    got = {r["doc_id"]: r["log_prob"] for r in lm_score.score(df).collect()}
    seen = {w: 1 + 4 * (w == "r0") for w in rare}
    bucket = {w: int((word_hashes([w.encode()])[0][0] >> np.uint64(32)) % np.uint64(lm_score.HASHED)) for w in rare}
    size = {b: sum(seen[w] for w in rare if bucket[w] == b) for b in bucket.values()}
    for d, text in dict(docs).items():
        ids, _ = lm_score.Ids(words).of([(text or "").encode()])
        base = net.log_probs(ids, np.flatnonzero(ids < lm_score.SIZE)).sum()
        assert np.isclose(got[d], base + sum(np.log(seen[w] / size[bucket[w]]) for w in (text or "").split() if w in bucket), rtol=1e-4)
    assert len(lm_score.score(df).collect()) == 6
