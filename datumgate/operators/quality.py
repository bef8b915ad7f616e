"""Quality rules evaluated on a column profile."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ref
from ..model import MaxNullPercentage, MinRowCount, NonEmptyColumn, QualityRule
from .profile import profile_with_summary

MIN_ROWS, MAX_NULLS, NON_EMPTY = "min_row_count", "max_null_percentage", "non_empty_column"

# Above this many rules the join is left to the optimizer instead of a hint.
BROADCAST_RULES = 10_000


def rules_frame(spark: SparkSession, rules: Sequence[QualityRule]) -> DataFrame:
    """Rules as rows, in the order given. Row-count rules have a null column."""
    rows = []
    for index, rule in enumerate(rules):
        if isinstance(rule, MinRowCount):
            rows.append((index, MIN_ROWS, None, float(rule.minimum), rule.minimum, str(rule.minimum)))
        elif isinstance(rule, MaxNullPercentage):
            rows.append((index, MAX_NULLS, rule.column, float(rule.max_allowed), None, f"{rule.max_allowed:.1f}"))
        elif isinstance(rule, NonEmptyColumn):
            rows.append((index, NON_EMPTY, rule.column, None, None, None))
        else:
            raise TypeError(f"not a quality rule: {rule!r}")
    schema = pa.schema(
        [
            ("rule_index", pa.int32()),
            ("kind", pa.string()),
            ("rule_column", pa.string()),
            ("limit", pa.float64()),
            # Counts are compared as integers; doubles miss differences beyond 2^53.
            ("least_rows", pa.int64()),
            ("limit_text", pa.string()),
        ]
    )
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema))


def violations_of(profile: DataFrame, rules: Sequence[QualityRule]) -> DataFrame:
    """Violations of ``rules`` on a profile that has its summary row.

    The profile has one row per column, so the join is small on both sides. A
    rule on an unknown column finds no partner and raises no violation.
    """
    frame = rules_frame(profile.sparkSession, rules)
    if len(rules) <= BROADCAST_RULES:
        frame = F.broadcast(frame)
    kind, limit, total = F.col("kind"), F.col("limit"), F.col("total_count")
    nulls, pct = F.col("null_count"), F.col("null_percentage")
    name, text = F.col("rule_column"), F.col("limit_text")
    broken = (
        ((kind == MIN_ROWS) & (total < F.col("least_rows")))
        | ((kind == MAX_NULLS) & (pct > limit))
        | ((kind == NON_EMPTY) & (nulls == total) & (total > 0))
    )
    # format_number rounds the exact binary value, halves to even.
    shown = F.expr("format_number(null_percentage, '0.00')")
    # The wording of descriptions and details is part of the results.
    description = (
        F.when(kind == MIN_ROWS, F.concat(F.lit("Minimum row count requirement of "), text))
        .when(kind == MAX_NULLS, F.concat(F.lit("Max null threshold of "), text, F.lit("% for column '"), name, F.lit("'")))
        .otherwise(F.concat(F.lit("Non-empty column requirement for '"), name, F.lit("'")))
    )
    details = (
        F.when(
            kind == MIN_ROWS,
            F.concat(F.lit("Dataset contains "), total.cast("string"), F.lit(" rows, expected at least "), text),
        )
        .when(
            kind == MAX_NULLS,
            F.concat(
                F.lit("Column '"), name, F.lit("' has "), shown, F.lit("% nulls, exceeding limit of "), text, F.lit("%")
            ),
        )
        .otherwise(F.concat(F.lit("Column '"), name, F.lit("' is 100% null")))
    )
    joined = profile.join(frame, F.col("column").eqNullSafe(F.col("rule_column")), "inner")
    return joined.where(broken).select(
        "rule_index",
        description.alias("rule_description"),
        name.alias("column"),
        details.alias("details"),
        F.when(kind == MIN_ROWS, total.cast("double")).otherwise(pct).alias("actual"),
        F.coalesce(limit, F.lit(100.0)).alias("limit"),
    )


def quality_violations(df: DataFrame, rules: Sequence[QualityRule]) -> DataFrame:
    """Violations of ``rules`` on ``df``, from one pass over the data.

    Only the columns a rule names are profiled, so the scan reads no others.
    """
    named = {r.column for r in rules if not isinstance(r, MinRowCount)}
    kept = [c for c in df.columns if c in named]
    narrow = df.select(*[ref(c) for c in kept])
    return violations_of(profile_with_summary(narrow, bounds=False), rules)


def unmatched_rules(df: DataFrame, rules: Sequence[QualityRule]) -> DataFrame:
    """Rules that name a column ``df`` does not have."""
    frame = rules_frame(df.sparkSession, rules)
    known = F.col("rule_column").isin(df.columns) | F.col("rule_column").isNull()
    return frame.where(~known).select("rule_index", "kind", F.col("rule_column").alias("column"))


@dataclass(frozen=True)
class DatasetProfile:
    row_count: int
    column_count: int
    columns: DataFrame
    quality_violations: DataFrame


def profile_dataset(df: DataFrame, rules: Sequence[QualityRule] = (), **options) -> DatasetProfile:
    """Profile ``df`` and check ``rules`` in a single job.

    The profile (one row per column of the schema) is brought to the driver
    once, so that looking at it again does not read the data again.
    """
    whole = profile_with_summary(df, **options)
    spark = df.sparkSession
    kept = spark.createDataFrame(whole.toArrow(), schema=whole.schema)
    [summary] = kept.where("column is null").select("total_count").collect()
    return DatasetProfile(
        row_count=summary.total_count,
        column_count=len(df.columns),
        columns=kept.where("column is not null").orderBy("position"),
        quality_violations=violations_of(kept, rules).orderBy("rule_index"),
    )
