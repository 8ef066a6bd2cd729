"""Queries of the corpus operators over the whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import filter_audit, line_dedup, vector_codes
from .common import table


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_recurring_lines

    return drop_recurring_lines(table(spark, sf_dir, "documents"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import digest, find_contamination

    return digest(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents").select("doc_id", "source")).select("row.doc_id", "source", "block", "slot", "position")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op7_secret_scan": op7_secret_scan, "op2_line_dedup": op2_line_dedup, "op6_toxicity": op6_toxicity, "op4_html_text": op4_html_text, "op10_mixing": op10_mixing, "op1_ngram_join": op1_ngram_join, "op3_token_output": op3_token_output, "op5_quality": op5_quality, "op8_decontaminate": op8_decontaminate, "op9_token_counts": op9_token_counts, "op11_filter_audit": op11_filter_audit, "op12_vector_codes": op12_vector_codes, "op13_simhash": op13_simhash}

ORACLE_SQL: dict[str, str] = {"op2_line_dedup": line_dedup.oracle_sql(), "op11_filter_audit": filter_audit.oracle_sql(), "op12_vector_codes": vector_codes.oracle_sql()}
