"""A training corpus in five stages, each over all that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datumgate.llm import bpe, decontaminate, language_id, line_dedup, ngram_join
from datumgate.llm.queries import MIN_SITES, VOCABULARY
from datumgate.llm.scratch import written
from datumgate.session import configure

MIN_LANGUAGE_SCORE = 0.4
#: SQL cannot express the stages; tests/llm compares them with plain implementations.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus; those without letters or without a clear language go."""
    found = language_id.identify(docs, language_id.train(docs))
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return found.where(known).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site boilerplate; documents that were nothing else go."""
    cleaned = line_dedup.without_emptied(line_dedup.dedup_lines(docs, MIN_SITES))
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return ngram_join.one_per_class(docs, ngram_join.ngram_join(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_leaks(docs, items)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them."""
    path = public_tokenizers.path(VOCABULARY)
    decoded = bpe.encode_texts(docs, path, decode=True)
    return decoded.select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def _configured(stage):
    return lambda spark, docs, sf_dir: stage(configure(spark), docs, sf_dir)


STAGES = [(stage.__name__, _configured(stage)) for stage in (language, lines, near_duplicates, decontamination, tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
