"""Reconciliation of counts between sources and layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judged(counts: DataFrame, threshold: float, strict: bool = True) -> DataFrame:
    """(…, expected, actual) with delta_pct, status and message.

    The delta is a percentage of what was expected. Rows that were not expected at all are a WARNING; with
    ``strict`` off they have a delta of 0 and pass.
    """
    expected, actual = F.col("expected"), F.col("actual")
    delta = F.when(expected == 0, 0.0).otherwise(F.round(F.abs(expected - actual) / expected * 100, 2))
    from_nothing = (expected == 0) & (actual > 0) if strict else F.lit(False)
    rows = counts.withColumn("delta_pct", delta)
    rows = rows.withColumn("status", F.when((F.col("delta_pct") > threshold) | from_nothing, "WARNING").otherwise("PASS"))
    return rows.withColumn("message", F.concat(F.lit("expected "), expected.cast("string"), F.lit(", actual "), actual.cast("string")))


def by_batch(source: DataFrame, target: DataFrame, threshold: float, batch: str = "_batch_id", strict: bool = True) -> DataFrame:
    """Counts of both sides by batch; a side without rows counts 0."""
    a = source.groupBy(batch).agg(F.count("*").alias("expected"))
    b = target.groupBy(batch).agg(F.count("*").alias("actual"))
    both = a.join(b, batch, "full_outer").select(batch, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return judged(both, threshold, strict)


def totals(source: DataFrame, target: DataFrame, threshold: float, unknown: bool = True, strict: bool = True) -> DataFrame:
    """Counts of both sides as one row; the target's Unknown member is left out."""
    a = source.agg(F.count("*").alias("expected"))
    b = target.agg((F.count("*") - int(unknown)).alias("actual"))
    return judged(a.crossJoin(b), threshold, strict)


def audit_counts(audit: DataFrame) -> DataFrame:
    """(dataset, expected): record counts where a dataset states them, and sums of its positive values."""
    stated = audit.where("attribute like '%_RECORDS'").select("dataset", F.col("value").alias("expected"))
    summed = audit.where("value > 0 and attribute not like '%_RECORDS'").groupBy("dataset").agg(F.sum("value").alias("expected"))
    return stated.unionByName(summed)


def against_audit(expected: DataFrame, loaded: DataFrame) -> DataFrame:
    """(dataset, expected) against (dataset, actual): PASS when equal, WARNING when not or when nothing was loaded."""
    both = expected.join(loaded, "dataset", "left")
    status = F.when(F.col("expected") == F.col("actual"), "PASS").otherwise("WARNING")
    message = F.when(F.col("actual").isNull(), "no source loaded").when(F.col("expected") == F.col("actual"), "counts agree").otherwise("counts differ")
    return both.select("dataset", "expected", "actual", status.alias("status"), message.alias("message"))
