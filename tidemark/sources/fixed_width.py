"""Fixed-width text with several record types in one file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.casting import COMPACT_TIMESTAMP, Cast, cast_all

PREFIX = (("pts", 15), ("rectype", 3))


@dataclass(frozen=True)
class RecordSpec:
    """Fields of one record type after the common prefix; ``rest`` names what follows the last field."""

    rectype: str
    fields: tuple[tuple[Cast, int], ...]
    rest: str | None = None


def checked(lines: DataFrame, specs: list[RecordSpec], column: str = "value") -> DataFrame:
    """Lines with their record type; a type that no spec names fails the job."""
    kind = F.trim(F.substring(column, 16, 3))
    known = F.when(kind.isin(*[s.rectype for s in specs]), kind).otherwise(F.raise_error(F.concat(F.lit("unknown record type "), kind)).cast("string"))
    return lines.where(F.trim(column) != "").withColumn("rectype", known)


def parse_records(lines: DataFrame, spec: RecordSpec, column: str = "value", keep: list[str] = ()) -> DataFrame:
    """Rows of one record type: slices trimmed and cast, posting time first."""
    at, cols = 1 + sum(w for _, w in PREFIX), [F.substring(column, 1, 15).alias("pts")]
    for cast, width in spec.fields:
        cols.append(F.substring(column, at, width).alias(cast.name))
        at += width
    casts = [Cast("pts", COMPACT_TIMESTAMP), *(c for c, _ in spec.fields)]
    if spec.rest:
        cols.append(F.expr(f"substring({column}, {at})").alias(spec.rest))
        casts.append(Cast(spec.rest))
    return cast_all(lines.where(F.trim(F.substring(column, 16, 3)) == spec.rectype).select(*keep, *cols), casts, list(keep))


def split_reference(df: DataFrame, column: str, id_column: str, name_column: str) -> DataFrame:
    """A trailing field that is an id (digits alone) or a name, as two columns of which one is NULL."""
    is_id = F.col(column).rlike("^[0-9]+$")
    return df.withColumns({id_column: F.when(is_id, F.col(column)), name_column: F.when(~is_id, F.col(column))}).drop(column)
