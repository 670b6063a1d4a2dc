"""A training-data pipeline over ``documents``: language ID, near-duplicates, personal data, mixing, packing.

Each stage works on all rows that the one before it kept; all but the last give the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.llm import mix, packing, pii, queries, simhash
from seqweave.llm.common import materialize, small

#: Words whose ids a worker keeps while packing; fewer than alone, as the stages before leave the executors' heaps grown.
WORDS = 450_000

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in some language. Those without letters, or unlike any language, go.

    Rows are told apart by all that decides (key, text, language, source), so what shares a key with a rejected row stays,
    and null keys are judged like others. Repeated rows share their fate; an empty table gives no rows.
    """
    told = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text", "lang", "source")]
    rows = docs.withColumn("_row", F.struct(F.xxhash64(*told), F.hash(*told)))
    found = queries.identify_documents(rows, "_row")
    gone = materialize(found.filter("not kept").select("_row").distinct(), "rejected")
    return rows.join(small(gone), "_row", "left_anti").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share four fifths of their five-word shingles: that with its smallest
    doc_id (nulls last). Rows that share a doc_id but not the text are told apart; an empty table gives no rows."""
    return simhash.one_of_each(docs.select(COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    return pii.replace_pii(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each time that a document, or a part of it, is taken. Documents without words aren't;
    null keys and sources and repeated rows are taken like others; an empty table gives no rows."""
    sized = docs.select(*COLUMNS, mix.words_of(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content"))
    return mix.mixed_texts(mix.mix(sized, content="content")).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences. Null texts count as empty, rows with null or repeated keys are packed each
    for itself, an empty table gives no rows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False, words=WORDS)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("packing", packed)]

#: The models, patterns and tokenizers of the stages are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
