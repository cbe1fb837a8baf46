"""A training-data pipeline over ``documents``: five stages, each written and read again.

1. ``quality`` drops documents that the neighbour vote rejects.
2. ``near_duplicates`` keeps one document of every group of similar ones.
3. ``decontamination`` drops documents that share a window of words with ``benchmark``.
4. ``personal_data`` masks personal data in the texts.
5. ``mixture`` schedules what is left by source; a document may come several times.

Stages 1 to 4 return the columns of documents; the last adds ``mix_epoch``, the
pass that a row belongs to, and ``mix_block`` and ``mix_place``, which order it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import decontaminate, jaccard, mixing, pii, quality
from codeloom.llm.queries import fold
from codeloom.plans.registry import Query
from codeloom.session import checkpoint_dir
from codeloom.sources.tables import table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), fold(5, 0))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

# Two of the stages learn a model, which SQL cannot say; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the shared folder."""
    at = f"{checkpoint_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs


QUERIES = {"pipeline": Query("pipeline", run, ORACLE_SQL)}
