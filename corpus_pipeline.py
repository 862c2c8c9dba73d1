"""The corpus pipeline: five training-data operators one after another.

Each stage works on every row its predecessor kept and returns a DataFrame; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.llm import toxicity
from plyframe.llm.common import documents, save
from plyframe.llm.exact_dedup import drop_duplicates
from plyframe.llm.mixture import mixed_rows
from plyframe.llm.queries import piece_digests, toxic_scores
from plyframe.llm.simhash import drop_near_duplicates
from plyframe.session import ship_package


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents scored 0.7 or more go.  The model learns from the labelled rows of ``sf_dir``."""
    ship_package(spark)
    return toxic_scores(spark, docs, sf_dir).filter(F.col("_score") < toxicity.THRESHOLD).drop("_score")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the row with the smallest id stays."""
    return drop_duplicates(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each component the row with the smallest id stays."""
    ship_package(spark)
    return drop_near_duplicates(spark, docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each row as often as its source's target takes it (0, 1 or 2 times), shuffled in its shard."""
    ship_package(spark)
    return mixed_rows(spark, docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: the ids and the decoded text of every row, as digests."""
    ship_package(spark)
    return piece_digests(docs)


STAGES = [("toxicity", clean), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixture", mixed),
          ("sentencepiece", encoded)]

#: SQL has no trained model, XXH64 with a seed or SentencePiece; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = save(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
