"""A corpus pipeline: five operators, each stage's result written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from byteplan.llm.common import shared_dir, table
from byteplan.llm.decontaminate import drop_leaks
from byteplan.llm.mixing import mix_documents
from byteplan.llm.pii import redact_pii
from byteplan.llm.simhash import drop_near_duplicates
from byteplan.llm.toxicity import CUT, toxicity_model, toxicity_score


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxic score; the classifier learns from the labelled documents.

    Every row is judged by its text alone: null and empty texts get the score of no words, equal texts go or stay
    together, a score at the cut goes. An empty table stays empty; columns are as they were.
    """
    model = toxicity_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.filter(toxicity_score(model, F.col("text")) < CUT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id, null last.

    Null and empty texts are one group. Of rows that agree in id and text one stays, the same in every run. An empty
    table stays empty; columns are as they were.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty texts contain none; equal texts go or stay together; coverage at the threshold goes. An empty table,
    or an empty benchmark, changes nothing; columns are as they were.
    """
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind; n_chars follows.

    Null texts stay null, texts without personal data and other columns as they were; no row goes.
    """
    return redact_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: text with how many words and copies of it are taken.

    Null texts have no words and stay, with nothing taken; a null source is a source of its own. Rows that agree in id,
    source and text are one row with their number. An empty table gives an empty mix.
    """
    return mix_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("pii", pii),
    ("source mixing", mixing),
]

#: SQL cannot express the classifier, the fingerprints or the tiling; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
