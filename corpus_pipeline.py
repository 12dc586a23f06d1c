"""From raw documents to token ids: quality, copies, personal data, mixture, encoding.

STAGES are (name, function) in order; each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. Every stage works on all rows it gets, whatever their number: an empty table gives an empty one. Null
and empty texts are documents without words, very long texts are read whole, repeated rows are rows, and columns beside those of
documents are passed through by all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from readgrain.llm import forest, mix, pieces, pii, quality
from readgrain.llm.common import documents, remove, shared_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go. Null texts are judged as empty ones; ties at the cut stay."""
    return quality.good_documents(spark, docs, sf_dir)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near or exact copies the document of the smallest doc_id stays, and one of rows with equal id and text. All null texts and texts without words stay."""
    return forest.distinct_documents(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data becomes its kind in brackets; n_chars follows. Null and empty texts, and their n_chars, stay."""
    return pii.redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture takes them. A null source is one source, the last; rows without words cost nothing."""
    return mix.mix_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens and round_trip, a row per row; null and empty texts have no ids."""
    return pieces.encode(docs, pieces.model_path(), ["doc_id", "source"])


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: No stage but the mixture can be written in SQL; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are written to the shared folder and read again. What a stage has read is deleted once its own rows are written."""
    docs, done = documents(spark, sf_dir), None
    at = f"{shared_dir(spark)}/readgrain/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if done:
            remove(spark, done)
        done = f"{at}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
