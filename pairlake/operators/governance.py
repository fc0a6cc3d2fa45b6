"""Licences, release gates, tiers. What isn't registered needs a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validate import codes

RELEASABLE = ("approved", "conditional")


def decisions(rows: DataFrame, registry: DataFrame, aliases: DataFrame, dataset: str) -> DataFrame:
    """rows with source, status, license, terms_url, attribution. The registry has a row for each source; Spark
    broadcasts it while it is small by its own measure."""
    reg = registry.withColumnRenamed("source", "reg_source")
    al = aliases.withColumnsRenamed({"alias": "al_alias", "source": "al_source"})
    out = rows.join(al, rows[dataset] == al["al_alias"], "left").withColumn("source_id", F.coalesce("al_source", dataset))
    out = out.join(reg, F.col("source_id") == reg["reg_source"], "left")
    out = out.withColumn("status", F.coalesce("status", F.lit("review_required"))).withColumn("license", F.coalesce("license", F.lit("NOASSERTION")))
    return out.drop("al_alias", "al_source", "reg_source")


def release_errors() -> Column:
    """Codes for rows with status, license, terms_url, attribution."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return codes(
        (F.col("status").isNull(), "status_missing"),
        (~F.col("status").isin(*RELEASABLE), "not_releasable"),
        (empty("license") | (F.col("license") == "NOASSERTION"), "license_missing"),
        (empty("terms_url"), "terms_url_missing"),
        ((F.col("status") == "conditional") & empty("attribution"), "attribution_missing"),
    )


def tier() -> Column:
    """TX to T1 from value_robust, content_real, correct, base_clean, leakage, fixable, arch_specific."""
    c = F.col
    false = lambda x: c(x).eqNullSafe(F.lit(False))
    return (
        F.when(c("leakage") | false("base_clean") | ~c("correct"), "TX")
        .when(c("value_robust") & c("content_real") & F.coalesce(c("arch_specific"), F.lit(False)), "T2")
        .when(c("value_robust") & c("content_real"), "T1")
        .when(c("fixable"), "T3")
        .when(false("fixable"), "T4")
        .otherwise("T3")
    )


def catalog_hash(rows: DataFrame, order: str, digest: str) -> DataFrame:
    """One SHA-256 over the digests of artifacts, which are few, in order, a line each."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, digest))), lambda x: x[digest]), "\n")
    return rows.agg(F.sha2(lines, 256).alias("catalog"), F.count("*").alias("artifacts"))
