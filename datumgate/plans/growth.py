"""Registered queries on datasets and logs that grow, and on work that is cancelled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cancellation import Cancellation
from ..errors import Cancelled
from ..model import PARQUET, IngestionSource
from ..operators.ingest import ingest
from ..operators.manifests import Manifests
from ..operators.registry import Registry
from ..operators.stored_profiles import StoredProfiles
from ..session import scratch_dir
from .tables import TABLES, path_of, table

NAMESPACE = "registry"
# Calls of a segment in ``registry_segments``, so that its calls fill several.
FEW_CALLS = 2


def ingest_grown_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in three folders of one dataset: one there from the start, one written again, one that came later.

    Shows the fingerprint beside the one of a full hash, and how many files the second ingestion hashed that were there.
    """
    folder = scratch_dir(spark, "grown")
    orders = table(spark, sf_dir, "orders")
    finished, pending = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P"
    manifests = Manifests(spark, scratch_dir(spark, "manifests"))
    registry = Registry(spark, scratch_dir(spark, "registry"), NAMESPACE)
    sources = [IngestionSource("orders", folder)]
    orders.where(finished).write.parquet(f"{folder}/stays")
    orders.where(pending).write.parquet(f"{folder}/again")
    ingest(spark, registry, sources, manifests=manifests)
    before = manifests.generation()
    orders.where(pending).write.mode("overwrite").parquet(f"{folder}/again")
    orders.where(~finished & ~pending).write.parquet(f"{folder}/later")
    ingest(spark, registry, sources, manifests=manifests)
    # The fingerprint of a dataset covers the files a scan reads.
    plain = Registry(spark, scratch_dir(spark, "registry"), NAMESPACE)
    full = ingest(spark, plain, sources).first().fingerprint
    first, second = manifests.files(before), manifests.files()
    stays = F.split("relative_path", "/")[0] == "stays"
    both = first.join(second, ["relative_path", "modified_at", "fingerprint"])
    return registry.list().select(
        "name",
        "row_count",
        "version_count",
        (F.col("fingerprint") == full).alias("equals_full"),
        F.lit(both.where(stays).count() == first.where(stays).count()).alias("keeps_what_stayed"),
        F.lit(both.where(~stays).count()).cast("int").alias("wrongly_kept"),
    )


def profile_stored_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem by return flag: profiled, then returned rows go and the rest is profiled from the states held."""
    folder = scratch_dir(spark, "flags")
    lineitem = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    lineitem.where(flag == "R").write.parquet(f"{folder}/returned")
    lineitem.where(flag == "N").write.parquet(f"{folder}/new")
    stored = StoredProfiles(spark, scratch_dir(spark, "states"), Manifests(spark, scratch_dir(spark, "manifests")))
    stored.profile(folder)
    lineitem.where(flag == "A").write.parquet(f"{folder}/accepted")
    lineitem.limit(0).write.mode("overwrite").parquet(f"{folder}/returned")
    return stored.profile(folder).withColumn("distinct_count_approx", F.lit(None).cast("bigint"))


def customer_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ord"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("/data/"), F.col("c_name")).alias("path"),
        F.lit(PARQUET).alias("format"),
        F.lit('{"fields":[]}').alias("schema_json"),
        F.sha2(F.col("c_mktsegment"), 256).alias("fingerprint"),
        F.lit(0).cast("bigint").alias("row_count"),
        F.lit(False).alias("row_count_is_sampled"),
        F.col("c_custkey").alias("byte_size"),
        "c_mktsegment",
    )


def registry_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers registered by market segment, a call each; one market segment is registered twice."""
    registry = Registry(spark, scratch_dir(spark, "registry"), NAMESPACE, calls_per_segment=FEW_CALLS)
    rows = customer_entries(spark, sf_dir)
    # A market segment is one of a few names.
    for (segment,) in rows.select("c_mktsegment").distinct().collect():
        registry.register(rows.where(F.col("c_mktsegment") == segment).drop("c_mktsegment"))
    again = rows.where(F.col("c_mktsegment") == "BUILDING").drop("c_mktsegment")
    registry.register(again.withColumn("row_count", F.lit(7).cast("bigint")))
    return registry.list().drop("created_at", "updated_at")


def ingest_cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables registered, then an ingestion of them that is cancelled: each keeps its one version."""
    registry = Registry(spark, scratch_dir(spark, "registry"), NAMESPACE)
    sources = [IngestionSource(name, path_of(sf_dir, name)) for name in TABLES]
    ingest(spark, registry, sources)
    work = Cancellation(spark)
    work.cancel()
    try:
        ingest(spark, registry, sources, cancellation=work)
        outcome = "registered"
    except Cancelled as failure:
        outcome = failure.code
    return registry.list().select("name", "row_count", "version_count", F.lit(outcome).alias("outcome"))


GROWTH = (ingest_grown_folder, profile_stored_states, registry_segments, ingest_cancelled)
