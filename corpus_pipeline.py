"""The corpus pipeline: each stage works on all that its predecessor kept.

Toxic documents go, one document of each near-duplicate group stays, documents with benchmark windows go, personal data
is replaced by its kind, and what is left is packed into token sequences.

Defined results: every stage takes an empty table to an empty one, treats a null text as empty, and carries further columns
along under any name, except that the last returns the columns of its pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tablescope.llm import decontaminate, near_copies, packing, pii, toxicity
from tablescope.llm.common import shared_folder, table


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score stays under 0.5; rows without text or id are scored like any other, equal rows alike."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id; rows without id stand last, and of equal rows one stays."""
    return near_copies.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no window of a benchmark item; equal rows share their fate, and an empty benchmark keeps all."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind in brackets; of spans that overlap the first is replaced whole."""
    return pii.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of at most 4096 tokens; an empty text still gives its end token, equal rows a piece each."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", civil),
    ("simhash", near_duplicates),
    ("decontaminate", benchmark),
    ("pii", personal_data),
    ("packing", sequences),
]

# Stages learn from labels and use a public tokenizer, which SQL cannot express; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
