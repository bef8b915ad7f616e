"""The registered queries of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import table
from ..session import configure, scratch_dir
from . import (
    bpe,
    decontaminate,
    language_id,
    licenses,
    line_dedup,
    ngram_join,
    periodic_runs,
    quality_rules,
    secrets,
    url_filter,
    warc,
    whitening,
    winnowing,
)

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = "byte_bpe_50k.json"
MIN_SITES = 10

# The rules (host, path, verdict) every URL is judged by.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
SPAM_HOST = r"(^|[.-])spam"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.dedup_lines(docs, MIN_SITES).select("doc_id", "text", "n_lines", "n_removed")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(~held_out))
    found = language_id.identify(docs, model, ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join.ngram_join(table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "class_id", "text_id", "n_links")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    decoded = bpe.encode_texts(table(spark, sf_dir, "documents"), path, decode=True)
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "warc")
    warc.write_warc(warc.page_records(table(spark, sf_dir, "pages")), path)
    return warc.archived_pages(spark, path)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(table(spark, sf_dir, "documents")).drop("cleaned_text")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(_joined_spans(F.col("base_spans")), 256).alias("base_sha256"),
        _joined_spans(F.col("spans")).alias("spans"),
    )


def listed_urls(pages: DataFrame) -> DataFrame:
    """The fixed rules, and the canonical URLs of all pages on spam hosts as listed ones."""
    rules = pages.sparkSession.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    rules = rules.withColumn("kind", F.lit(url_filter.RULE))
    key = url_filter.canonical_url(F.col("url"))
    spam = pages.where(url_filter.host_of(F.col("url")).rlike(SPAM_HOST)).select(
        F.regexp_extract(key, "^[^/?]*", 0).alias("host"),
        F.regexp_extract(key, "(?s)^[^/?]*(.*)$", 1).alias("path"),
        F.lit(url_filter.BLOCK).alias("verdict"),
        F.lit(url_filter.EXACT).alias("kind"),
    )
    return rules.unionByName(spam)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge_urls(pages, listed_urls(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    white = whitening.whiten(vectors)
    return white.select(
        "vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "pair")
    ).select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "pair.whitened", "pair.explained", "identity_error"
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    planted = docs.withColumn("text", periodic_runs.with_planted_run(F.col("text"), F.col("doc_id")))
    found = periodic_runs.detect_runs(planted)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    start, length, period = -F.col("best.col2"), F.col("best.length"), -F.col("best.col3")
    return found.withColumn("best", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(F.lit(1000) * length / period).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return winnowing.compare_with_edited(docs).select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        winnowing.as_text("marks").alias("fingerprint"),
        winnowing.as_text("edited_marks").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def _configured(query: Query) -> Query:
    return lambda spark, sf_dir: query(configure(spark), sf_dir)


def llm_queries() -> dict[str, Query]:
    return {
        f.__name__: _configured(f)
        for f in (
            op1_line_dedup,
            op2_language_id,
            op3_ngram_jaccard_join,
            op4_bpe,
            op5_warc,
            op6_license_scan,
            op7_quality_rules,
            op8_decontamination,
            op9_secret_scan,
            op10_url_filter,
            op11_embedding_whitening,
            op12_periodic_runs,
            op13_winnowing,
        )
    }
