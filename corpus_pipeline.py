"""A corpus pipeline over ``documents``: each stage works on what its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All stages but the last return the columns of
``documents``; ``n_chars`` is that of the text as the stage leaves it.

Nulls, empty texts, repeated rows and extra columns are handled as each operator states; an empty table
passes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetsweep.llm import decontam, ngram_join, pii, quality_rules, sampled_pieces
from assetsweep.llm.common import stored, table
from assetsweep.llm.queries import tokenizer_path
from assetsweep.session import checkpoint_dir, ship_package


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the present text, if the table has that column."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without boilerplate lines."""
    return _with_length(quality_rules.apply_quality_rules(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return ngram_join.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that stand in the benchmark."""
    return _with_length(decontam.remove_contamination(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked and disclosing terms generalised or removed."""
    return _with_length(pii.sanitise(docs))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, pieces and lossless: a sampled segmentation of every text."""
    return sampled_pieces.sample_pieces(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontamination), ("PII", personal_data),
          ("SentencePiece", pieces)]
# Sampled segmentation and near duplicates have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    checkpoint_dir(spark)
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k + 1}")
    return docs
