"""Data tests: each returns the rows, keys or counts that violate it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.star import orphans


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, failures) of all columns in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("failures")) for c in columns])).alias("r")).select("r.*")


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def duplicated(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Keys, of columns or expressions, that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def outside_values(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))


relationships = orphans


def outside_range(df: DataFrame, column: str, least=None, most=None) -> DataFrame:
    """Values below or above inclusive bounds."""
    bad = F.lit(False)
    if least is not None:
        bad = bad | (F.col(column) < F.lit(least))
    if most is not None:
        bad = bad | (F.col(column) > F.lit(most))
    return df.where(bad)


def not_true(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def not_one_current(df: DataFrame, key: str, flag: str = "is_current") -> DataFrame:
    return df.groupBy(key).agg(F.count_if(F.col(flag)).alias("n_current")).where("n_current <> 1")


def overlapping(df: DataFrame, key: str, start: str = "valid_from_date", end: str = "valid_to_date") -> DataFrame:
    before = F.lag(end).over(Window.partitionBy(key).orderBy(F.col(start).asc_nulls_last(), F.col(end).asc_nulls_last()))
    return df.withColumn("previous_end", before).where(F.col(start) <= F.col("previous_end"))


def discontinuous(df: DataFrame, key: str, start: str = "valid_from_date", end: str = "valid_to_date") -> DataFrame:
    after = F.lead(start).over(Window.partitionBy(key).orderBy(F.col(start).asc_nulls_last(), F.col(end).asc_nulls_last()))
    return df.withColumn("next_start", after).where(F.col("next_start").isNotNull() & (F.col("next_start") != F.date_add(F.col(end), 1)))


def fill_lost(df: DataFrame, key: str, order: list[Column], column: str) -> DataFrame:
    """Rows where a column is NULL although an earlier row of the key had a value."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("last_value", F.last(column, ignorenulls=True).over(w)).where(F.col(column).isNull() & F.col("last_value").isNotNull())


def unchanged_versions(df: DataFrame, key: str, order: list[Column], tracked: list[str]) -> DataFrame:
    """Versions whose tracked columns equal those of the version before."""
    w = Window.partitionBy(key).orderBy(*order)
    now = F.struct(*tracked)
    return df.withColumns({"_n": F.row_number().over(w), "_same": now.eqNullSafe(F.lag(now).over(w))}).where("_n > 1 and _same").drop("_n", "_same")


def freshness(df: DataFrame, column: str, now: Column, hours: int, source: str) -> DataFrame:
    """One row: newest load time, its age in hours, and WARN beyond the limit (or with no row at all)."""
    newest = df.agg(F.max(column).alias("newest"))
    age = F.timestamp_diff("SECOND", F.col("newest"), now) / 3600
    return newest.select(F.lit(source).alias("source"), "newest", age.alias("age_hours"), F.when(age <= hours, "PASS").otherwise("WARN").alias("status"))


def test_results(run_id: str, model: str, tests: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row per test: (violating rows, severity) by name to run_id, model, test, severity, failures, status, message."""
    rows = None
    for name, (bad, severity) in tests.items():
        n = bad.agg(F.count("*").alias("failures"))
        status = F.when(F.col("failures") == 0, "pass").otherwise("fail" if severity == "error" else "warn")
        row = n.select(
            F.lit(run_id).alias("run_id"),
            F.lit(model).alias("model"),
            F.lit(name).alias("test"),
            F.lit(severity).alias("severity"),
            "failures",
            status.alias("status"),
            F.concat(F.col("failures").cast("string"), F.lit(" violating rows")).alias("message"),
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


@dataclass(frozen=True)
class RowTest:
    """A test of single rows: what violates it, and how bad that is."""

    name: str
    violated: Column
    severity: str = "error"


def null_test(column: str, severity: str = "error") -> RowTest:
    return RowTest(f"not_null_{column}", F.col(column).isNull(), severity)


def values_test(column: str, values: list, severity: str = "warn") -> RowTest:
    return RowTest(f"accepted_values_{column}", F.col(column).isNotNull() & ~F.col(column).isin(*values), severity)


def range_test(column: str, least=None, most=None, severity: str = "warn") -> RowTest:
    low = F.col(column) < F.lit(least) if least is not None else F.lit(False)
    high = F.col(column) > F.lit(most) if most is not None else F.lit(False)
    return RowTest(f"range_{column}", F.coalesce(low | high, F.lit(False)), severity)


def true_test(name: str, condition: Column, severity: str = "error") -> RowTest:
    return RowTest(name, ~F.coalesce(condition, F.lit(False)), severity)


def judged(rows: DataFrame, run_id: str, model: str) -> DataFrame:
    """(test, severity, failures) rows to rows of the log."""
    status = F.when(F.col("failures") == 0, "pass").otherwise(F.when(F.col("severity") == "error", "fail").otherwise("warn"))
    return rows.select(
        F.lit(run_id).alias("run_id"),
        F.lit(model).alias("model"),
        "test",
        "severity",
        "failures",
        status.alias("status"),
        F.concat(F.col("failures").cast("string"), F.lit(" violating rows")).alias("message"),
    )


def row_test_results(df: DataFrame, run_id: str, model: str, tests: list[RowTest]) -> DataFrame:
    """The log rows of any number of row tests from one scan: all are counted by one aggregate."""
    counts = df.agg(*[F.count_if(t.violated).alias(f"t{k}") for k, t in enumerate(tests)])
    each = [F.struct(F.lit(t.name).alias("test"), F.lit(t.severity).alias("severity"), F.col(f"t{k}").alias("failures")) for k, t in enumerate(tests)]
    return judged(counts.select(F.inline(F.array(*each))), run_id, model)


def run_row_tests(df: DataFrame, run_id: str, model: str, tests: list[RowTest], folder: str) -> DataFrame:
    """Row tests of a table in one scan, with the violating rows kept: returns the log rows.

    Each violating row is written once for each test that it fails, below ``folder`` by test; the counts are taken
    while it is written. ``read_failures`` gives a test's rows back.
    """
    seen = Observation()
    names = F.array_compact(F.array(*[F.when(t.violated, F.lit(t.name)) for t in tests]))
    watched = df.observe(seen, *[F.count_if(t.violated).alias(f"t{k}") for k, t in enumerate(tests)])
    failed = watched.withColumn("_tests", names).where(F.size("_tests") > 0)
    failed.withColumn("_test", F.explode("_tests")).drop("_tests").write.mode("overwrite").partitionBy("_test").parquet(folder)
    rows = [(t.name, t.severity, int(seen.get[f"t{k}"])) for k, t in enumerate(tests)]
    return judged(df.sparkSession.createDataFrame(rows, "test string, severity string, failures long"), run_id, model)


def read_failures(spark: SparkSession, folder: str, test: str, schema: StructType) -> DataFrame:
    """The rows that ``run_row_tests`` kept for a test; no file of another test is read."""
    return spark.read.schema(StructType(schema.fields).add("_test", "string")).parquet(folder).where(F.col("_test") == test).drop("_test")


def store_failures(bad: DataFrame, folder: str, test: str) -> None:
    """Keep a test's violating rows as a table of their own."""
    bad.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{test}")


def last_run_failures(log: DataFrame) -> DataFrame:
    """Rows of the newest run that did not pass; run ids sort by time."""
    newest = log.agg(F.max("run_id").alias("_newest"))
    return log.join(F.broadcast(newest), F.col("run_id") == F.col("_newest")).where("status <> 'pass'").drop("_newest")


def test_trend(log: DataFrame) -> DataFrame:
    """Failures of each test by run, with the change since the run before."""
    w = Window.partitionBy("model", "test").orderBy("run_id")
    return log.select("model", "test", "run_id", "failures", (F.col("failures") - F.lag("failures").over(w)).alias("change"))
