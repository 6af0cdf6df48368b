"""From raw documents to token ids, in five stages.

Every stage takes all that the one before it kept and returns the columns of
``documents``; the last returns the encoded documents.  Rows that repeat are judged
alike.  Near-duplicate search takes rows of one id for one document and keeps one of
them, the same in every run; rows without an id pass it.  Of ties the smallest id
stays.  No rows in, no rows out; columns beyond those of ``documents`` go along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwell.llm import bpe, decontaminate, language_id, near_dup, quality_classifier
from tarnwell.sources.scratch import stored

#: A text of one language scores far above this; an even guess among four scores 0.25.
LEAST_LANGUAGE_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; null, letterless and undecided texts go."""
    return language_id.accepted(docs, language_id.fit(docs), LEAST_LANGUAGE_SCORE)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, scores 0.7 or more."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates."""
    return near_dup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to."""
    import public_tokenizers

    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("language id", identify_language),
    ("quality classifier", classify_quality),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: Trained models and sketches can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
