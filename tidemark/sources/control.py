"""Batch calendars and vendor audit files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.casting import blank_to_null


def batch_calendar(values: DataFrame, batch: str = "_batch_id", column: str = "value") -> DataFrame:
    """One date for each batch; a text that is no date fails the job, as nothing may be loaded without it."""
    text = blank_to_null(F.col(column))
    day = F.try_to_timestamp(text, F.lit("y-M-d")).cast("date")
    return values.select(batch, F.when(day.isNotNull(), day).otherwise(F.raise_error(F.concat(F.lit("no batch date: "), F.coalesce(text, F.lit("(none)")))).cast("date")).alias("asofdate"))


def read_batch_calendar(spark: SparkSession, glob: str) -> DataFrame:
    """Control files of all batches in one scan; the batch is the number in the folder's name."""
    whole = spark.read.text(glob, wholetext=True).select("value", F.regexp_extract("_metadata.file_path", r"[Bb]atch(\d+)/(?!.*[Bb]atch\d+/)", 1).cast("int").alias("_batch_id"))
    return batch_calendar(whole)


def read_audit(spark: SparkSession, path: str, keep: dict[str, Column] | None = None) -> DataFrame:
    """Audit files whose header names carry stray spaces; numbers and dates are read safely. ``keep`` adds columns, of the file's metadata for one."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = raw.select(*[F.col(f"`{c}`").alias(c.strip().lower()) for c in raw.columns], *[c.alias(k) for k, c in (keep or {}).items()])
    text = lambda c: blank_to_null(F.col(c))
    return raw.select(
        text("dataset").alias("dataset"), text("batchid").try_cast("int").alias("batchid"), F.try_to_timestamp(text("date"), F.lit("y-M-d")).cast("date").alias("date"),
        text("attribute").alias("attribute"), text("value").try_cast("bigint").alias("value"), text("dvalue").try_cast("decimal(20,5)").alias("dvalue"), *(keep or {}),
    )
