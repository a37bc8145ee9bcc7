import numpy as np

from snapweave.llm import lm_score


def test_every_position_is_trained_on(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"a{(i * j) % 50}" for j in range(37))) for i in range(1, 30)], "doc_id long, text string")
    words, counts = lm_score.vocabulary(docs)
    got, full = lm_score.train(docs, words, counts), lm_score.train(docs, words, counts, stride=1)
    assert np.allclose(got.flat(), full.flat(), atol=1e-4)
