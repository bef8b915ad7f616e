"""Cross-site line dedup in DataFrame expressions only.

The number of distinct sites of every line comes from HyperLogLog sketches
merged by aggregation; lines whose estimate is near the threshold get an exact
distinct count. A line found on ``min_sites`` sites or more is boilerplate: its
first occurrence (smallest document, then position) stays, all others go.

Defined results: lines are compared without white space at their ends; blank
lines are never counted or removed. A null site is no site. A null text stays
null with no lines, an empty text stays empty. Rows equal in doc_id and text are
one document: all of them keep or lose the same lines. A null doc_id sorts
first. An empty table gives an empty result. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import free_names

TRIMMED = " \t\r\x0b\f"
NO_ID = -(2**63)
SALTS = 16


def _document_key(id_col: str, text_col: str) -> list[Column]:
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("_row"),
    ]


def occurrences(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """One row per non-blank line: document key, position, site, line hash."""
    lines = docs.select(
        *_document_key(id_col, text_col),
        F.col(site_col).cast("string").alias("_site"),
        F.posexplode(F.split(F.col(text_col), "\n")).alias("_pos", "_line"),
    ).withColumn("_line", F.btrim("_line", F.lit(TRIMMED)))
    return lines.where(F.col("_line") != "").select("_id", "_row", "_pos", "_site", F.xxhash64("_line").alias("_hash"))


def _salted(lines: DataFrame, few: DataFrame) -> DataFrame:
    """Occurrences of the lines in ``few``; a line with a third of all rows is spread."""
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("_salt", F.pmod("_row", F.lit(SALTS)).cast("int")).join(spread, ["_hash", "_salt"])


def boilerplate_lines(lines: DataFrame, min_sites: int, lg_k: int = 10) -> DataFrame:
    """Hash and first occurrence of each line on ``min_sites`` sites or more.

    The sketch's relative standard error is 1.04 / sqrt(2^lg_k); estimates
    within three of these (and one site at least) of the threshold are replaced by
    exact counts.
    """
    margin = max(1.0, 3 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    spread = (
        lines.groupBy("_hash")
        .agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(lg_k))).alias("_sites"),
            F.min(F.struct("_id", "_row", "_pos")).alias("_first"),
        )
        .where(F.col("_sites") >= min_sites - margin)
    )
    near = spread.where(F.col("_sites") <= min_sites + margin)
    exact = (
        _salted(lines, near.select("_hash", "_first"))
        .where(F.col("_site").isNotNull())
        .select("_hash", "_first", "_site")
        .distinct()
        .groupBy("_hash", "_first")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= min_sites)
        .select("_hash", "_first")
    )
    return spread.where(F.col("_sites") > min_sites + margin).select("_hash", "_first").unionByName(exact)


def dedup_lines(
    docs: DataFrame,
    min_sites: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
) -> DataFrame:
    """``docs`` with its text cleaned, ``n_lines`` and ``n_removed`` (of non-blank lines).

    Where ``docs`` has columns of these names, the new ones take their place.
    """
    lines = occurrences(docs, id_col, text_col, site_col)
    removed = (
        _salted(lines, boilerplate_lines(lines, min_sites))
        .where(F.struct("_id", "_row", "_pos") != F.col("_first"))
        .groupBy("_id", "_row")
        .agg(F.collect_set("_pos").alias("_drop"))
    )
    id_name, row_name, drop, parts = free_names(docs, "_id", "_row", "_drop", "_lines")
    removed = removed.select(F.col("_id").alias(id_name), F.col("_row").alias(row_name), F.col("_drop").alias(drop))
    id_key, row_key = _document_key(id_col, text_col)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(drop))
    cleaned = F.array_join(F.transform(kept, lambda i: F.get(F.col(parts), i)), "\n")
    n_removed = F.coalesce(F.size(drop), F.lit(0)).cast("long")
    n_lines = F.size(F.filter(parts, lambda x: F.btrim(x, F.lit(TRIMMED)) != "")).cast("long")
    return (
        docs.drop("n_lines", "n_removed")
        .withColumns({id_name: id_key, row_name: row_key})
        .join(removed, [id_name, row_name], "left")
        .withColumn(parts, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
        .withColumn("n_lines", n_lines)
        .withColumn("n_removed", n_removed)
        .withColumn(text_col, F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(cleaned))
        .drop(id_name, row_name, drop, parts)
    )


def without_emptied(cleaned: DataFrame, text_col: str = "text") -> DataFrame:
    """Drops documents all of whose lines went, and the two counts."""
    return cleaned.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))).drop("n_lines", "n_removed")
