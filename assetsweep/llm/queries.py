"""Registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetsweep.llm import chat_format, decontam, fill_middle, lexical, ngram_join, pii, quality_mil, quality_rules, sampled_pieces, secret_scan, token_counts, token_files, warc
from assetsweep.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return deco


@query(quality_rules.SQL)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


@query()
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


@query(decontam.SQL)
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(warc.SQL)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archive(warc.write_archive(table(spark, sf_dir, "pages")), payloads=False)
    return records.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
                          "record_type", F.col("refers_to").cast("long").alias("refers_to"))


@query()
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_report(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query()
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query(chat_format.SQL)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with one of its replies cut short."""
    gathered = chat_format.gather_turns(table(spark, sf_dir, "conversations"))
    return chat_format.format_pairs(chat_format.cut_reply(gathered))


@query()
def op7_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_pieces.sample_pieces(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query()
def op5_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_mil.score_quality(docs, quality_mil.train(docs, table(spark, sf_dir, "labels")))


@query(ngram_join.SQL)
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query(fill_middle.SQL)
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.report(fill_middle.transform(table(spark, sf_dir, "documents")))


@query()
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return token_files.report(token_files.read_token_files(files))


@query(lexical.SQL)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
