"""Corpus pipeline: quality filter, near-duplicate removal, decontamination, mixing and sharding of ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.llm import decontamination, mixing, ngram_join, quality, sharding
from filinglens.llm.base import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The columns that stages read; the others travel as one, so that no name of theirs meets one of an operator's.
OWN = ["doc_id", "text", "source"]


def _packed(docs: DataFrame) -> DataFrame:
    return docs.select(*OWN, F.struct(*[F.col(c) for c in docs.columns if c not in OWN]).alias("_rest"))


def _unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    return df.select(*[F.col(c) if c in OWN else F.col("_rest")[c].alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects (score under 0.3) go."""
    scored = quality.classify(_packed(docs), _table(spark, sf_dir, "labels"))
    return _unpacked(scored.where("predicted = 1"), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked ones stays: that of the smallest doc_id. Full copies of a row are one."""
    return ngram_join.keep_first(docs, ngram_join.link_classes(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that mostly consists of them goes."""
    cut = decontamination.contamination(_packed(docs), _table(spark, sf_dir, "benchmark"), cut=True)
    kept = cut.where(~F.col("drop"))
    n = F.when(F.col("n_hit") > 0, F.length("text").cast("long")).otherwise(F.col("_rest.n_chars"))
    return _unpacked(kept.withColumn("_rest", F.col("_rest").withField("n_chars", n)), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated towards the target entropy; every document is kept at least once."""
    return _unpacked(mixing.mix(_packed(docs)), docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards of the same mixture and of row counts at most one apart."""
    return sharding.interleave(docs, shards=8)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: A learned model and a randomised join are not SQL; a test compares the stages after the model with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``, each written and read again."""
    docs = _table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        df = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return df
        path = f"{base}/{k}-{name}"
        df.write.parquet(path)
        docs = spark.read.parquet(path)
    raise AssertionError("STAGES is empty")
