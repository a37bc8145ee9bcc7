import os
import shutil

import corpus_pipeline
from snapweave.llm import decontam
from snapweave.llm.common import words_of


def test_run(spark, sf_dir, tmp_path):
    folder = str(tmp_path)
    for t in ("documents", "benchmark"):
        shutil.copy(f"{sf_dir}/{t}.parquet", os.path.join(folder, f"{t}.parquet"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    now, before = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, folder).write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        assert now.columns == docs.columns and 0 < now.count() <= before
        before = now.count()
    assert not any(r["contaminated"] for r in decontam.contamination_report(now, bench).collect())
    seen = [b" ".join(words_of(x)) for r in now.collect() for x in r["text"].split("\n") if words_of(x)]
    assert len(seen) == len(set(seen))
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in now.collect()}
    # original texts only lose lines
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(set(r["text"].split("\n")) <= set(text[r["doc_id"]].split("\n")) for r in now.collect())
