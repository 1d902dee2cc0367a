"""Header-less delimited text, with an optional two-field change prefix on any line."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.casting import Cast, cast_all


@dataclass(frozen=True)
class DelimitedSpec:
    columns: tuple[Cast, ...]
    delimiter: str = "|"
    changes: bool = False  # lines may start with a change flag and a change number

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]


def field_count(line, delimiter: str):
    return F.size(F.split(line, F.lit("\\" + delimiter), -1))


def parse_lines(lines: DataFrame, spec: DelimitedSpec, column: str = "value", keep: list[str] = ()) -> DataFrame:
    """Lines to typed columns. Lines of both shapes may be mixed; any other field count fails the job.

    Blank lines are skipped. Adds _cdc_flag and _cdc_dsn (I and 0 where the prefix is missing) when the spec
    has changes, and _dq_errors.
    """
    lines = lines.where(F.trim(F.col(column)) != "")
    n, names = len(spec.columns), spec.names
    schema = ", ".join(f"_f{k} string" for k in range(n + 2 * spec.changes))
    parsed = F.from_csv(F.col(column), schema, {"sep": spec.delimiter, "mode": "PERMISSIVE"})
    size = field_count(F.col(column), spec.delimiter) if spec.delimiter != "," else F.lit(n)
    rows = lines.select(*keep, parsed.alias("_p"), size.alias("_n"))
    wrong = F.raise_error(F.concat(F.lit("unexpected field count "), F.col("_n").cast("string"))).cast("string")
    if not spec.changes:
        fields = [F.when(F.col("_n") == n, F.col(f"_p._f{k}")).otherwise(wrong).alias(name) for k, name in enumerate(names)]
        return cast_all(rows.select(*keep, *fields), list(spec.columns), list(keep))
    shifted = F.col("_n") == n + 2
    fields = [F.when(shifted, F.col(f"_p._f{k + 2}")).when(F.col("_n") == n, F.col(f"_p._f{k}")).otherwise(wrong).alias(name) for k, name in enumerate(names)]
    change = [F.when(shifted, F.col("_p._f0")).otherwise("I").alias("_cdc_flag"), F.when(shifted, F.col("_p._f1").try_cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("_cdc_dsn")]
    return cast_all(rows.select(*keep, *change, *fields), list(spec.columns), [*keep, "_cdc_flag", "_cdc_dsn"])


def read_delimited(spark: SparkSession, path: str, spec: DelimitedSpec) -> DataFrame:
    """One scan over a path or glob; each row carries the name of its file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("_source_file"))
    return parse_lines(lines.where(~F.col("_source_file").like("%\\_audit.csv")), spec, keep=["_source_file"])


def field_count_profile(lines: DataFrame, expected: int, delimiter: str = "|", by: str = "_source_file") -> DataFrame:
    """How many lines of each file have how many fields, and whether that is the expected shape or the shifted one."""
    counted = lines.select(by, field_count(F.col("value"), delimiter).alias("n_fields")).groupBy(by, "n_fields").agg(F.count("*").alias("n_lines"))
    shape = F.when(F.col("n_fields") == expected, "base").when(F.col("n_fields") == expected + 2, "shifted").otherwise("unexpected")
    return counted.withColumn("shape", shape)
