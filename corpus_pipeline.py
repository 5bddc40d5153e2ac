"""From raw documents to token ids: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memoria.llm.common import documents, materialize
from memoria.llm.decontamination import decontaminate
from memoria.llm.near_duplicates import keep_one
from memoria.llm.quality import keep_quality
from memoria.llm.repeats import PASSAGE, remove_repeats
from memoria.llm.sentencepiece import encode_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold go. Null and empty texts have a score like others; repeated rows and null ids count each; without positive labels, and in an empty table, all scores are one half."""
    return keep_quality(docs, documents(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the least doc_id stays, and one of repeated rows. Null texts and texts under five words are linked to equal ones at most; null ids stay; an empty table stays empty."""
    return keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a passage of PASSAGE bytes (some fifty words) that also starts elsewhere leave the texts, wherever it stands. Null texts stay null, a text that is one repeat becomes empty; no row is lost or added."""
    return remove_repeats(docs, length=PASSAGE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and blank texts hold none; repeated rows go or stay together; an empty benchmark takes nothing."""
    return decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text: doc_id, ids. A null or empty text has none; rows repeat as they do in ``docs``."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: A trained classifier and byte-level repeats are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
