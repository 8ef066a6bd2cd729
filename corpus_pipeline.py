"""A corpus from raw documents to token files: five stages, each over all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's documents. All stages but the last return the columns of documents. Verdicts are carried by row, never by id alone,
as ids may be missing or shared: what follows from a text goes by the text's hash, and copies are told apart by id and hash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm.common import shared_dir, table
from aerolith.llm.decontamination import digest, find_contamination
from aerolith.llm.mixing import mix
from aerolith.llm.ngram_join import keep_one
from aerolith.llm.quality import quality
from aerolith.llm.queries import public_tokenizer
from aerolith.llm.token_output import encode_documents


def _text_key() -> Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def _keyed(docs: DataFrame) -> DataFrame:
    """The text's hash in place of the id, for verdicts that follow from the text: it is never null, and of one text only."""
    return docs.withColumn("doc_id", _text_key())


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of the documents has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    gone = _free(docs, "gone_key")
    return docs.join(keys.select(F.col("doc_id").alias(gone)).distinct(), _text_key() == F.col(gone), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return _without(docs, quality(_keyed(docs)).where(~F.col("kept")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the smallest id, or any if none has an id."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", _text_key().alias("text_key"))
    row_id = _free(docs, "row_id")
    return keep_one(docs.withColumn(row_id, row), id_col=row_id).drop(row_id)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return _without(docs, digest(find_contamination(_keyed(docs), table(spark, sf_dir, "benchmark"))).where("contaminated"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: files and rows are in that order."""
    return mix(docs).orderBy("position").select("row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mix: doc_id, start, n_tokens, ids_crc32 as read from them."""
    name = F.col("_metadata.file_name")
    # doc_id and text only: no other column's name is met
    placed = docs.select("doc_id", "text", F.regexp_extract(name, r"part-(\d+)", 1).cast("long").alias("file_number"), name.alias("file_name"), F.col("_metadata.row_index").alias("row_number"))
    return encode_documents(placed, public_tokenizer("byte_bpe_50k.json"), order=["file_number", "file_name", "row_number"])


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", token_output),
]

#: The language model and the range coder can't be put in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
