"""The corpus pipeline: language ID, line dedup, MinHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as
Parquet to the shared folder and read again as the next one's docs. All but the last return the columns of
documents: a document is removed or its text shortened, nothing is added.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from snapweave.llm import decontam, lang_id, line_dedup, near_dup, packing
from snapweave.llm.common import ensure_checkpoint_dir, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and those whose language the codes leave ambiguous or whose label they contradict."""
    return lang_id.drop_unidentified(docs)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of (nearly) equal ones stays; documents that lose all their lines go."""
    return line_dedup.dedup_documents(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (80 % of five-word shingles)."""
    return near_dup.drop_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language), ("line_dedup", remove_repeated_lines), ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_benchmark), ("packing", pack_sequences),
]
#: The stages learn a model, link similar texts and run a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
