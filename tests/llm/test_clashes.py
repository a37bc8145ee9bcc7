"""Pipeline stages leave columns alone, whatever their names, and have defined results for odd inputs."""

from pyspark.sql import functions as F

from snapweave.llm import decontam, lang_id, line_dedup, near_dup

NAMES = "row text_ n_words hit_starts hit_ends item_ids number lang_pred score ambiguous letters gone k at parts n_lines n_kept id key tile lead side label sketch size digest bands component rep first line".split()


def wide(spark):
    rows = [(i, t, lang, "s", 1) for i, (t, lang) in enumerate([("the one and the other thing", "en"), ("der eine und das andere ding", "de"), ("the one and the other thing", "en"), (None, "en"), ("12 34", None), ("und der dinge viele", "de")] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"{c}!").alias(c) for c in NAMES])


def test_stages_with_clashing_columns(spark):
    df = wide(spark)
    bench = spark.createDataFrame([("i", "viele"), (None, "x")], "item_id string, text string")
    for out in (lang_id.drop_unidentified(df), line_dedup.dedup_documents(df), near_dup.drop_near_duplicates(df), decontam.drop_contaminated(df, bench)):
        assert out.columns == df.columns
        got = out.collect()
        assert got and all(r[c] == f"{c}!" for r in got for c in NAMES)


def test_language_stage_without_labels(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, None, None), (3, "7 8", None), (4, "é", None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in lang_id.drop_unidentified(df).collect()) == [1, 4]
    assert lang_id.drop_unidentified(df.limit(0)).collect() == []


def test_language_stage_follows_the_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in lang_id.drop_unidentified(docs).collect()}
    want = lang_id.identify(docs, keep=("doc_id", "lang")).collect()
    assert kept == {r["doc_id"] for r in want if not r["ambiguous"] and not (r["lang"] is not None and r["lang"] != r["lang_pred"] and r["score"] >= 0.99)}
    # a wide margin makes more of them ambiguous
    assert len(lang_id.drop_unidentified(docs, min_margin=1.0).collect()) < len(kept)


def test_several_benchmark_sets_give_what_one_gives(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one = sorted(map(str, decontam.contamination_report(docs, bench).collect()))
    assert one == sorted(map(str, decontam.contamination_report(docs, bench, max_broadcast_words=300).collect()))
    assert sorted(r["doc_id"] for r in decontam.drop_contaminated(docs, bench, max_broadcast_words=300).collect()) == sorted(r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect())
