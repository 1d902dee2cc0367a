"""Casts that never fail a job: a value that does not fit becomes NULL and leaves an error object."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = "struct<column:string,raw_value:string,error_type:string,error_msg:string>"
ZEROS = "^0+$"
TRUE = ("1", "true", "True", "Y", "y")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c, F.lit(" \t\r\n")), F.lit(""))


def trim_or_null(c: Column, upper: bool = False) -> Column:
    """Trimmed text, NULL when blank, upper-cased on request."""
    c = blank_to_null(c)
    return F.upper(c) if upper else c


def as_int(c: Column) -> Column:
    return c.try_cast("int")


def as_long(c: Column) -> Column:
    return c.try_cast("bigint")


def as_double(c: Column) -> Column:
    return c.try_cast("double")


def as_decimal(precision: int, scale: int) -> Callable[[Column], Column]:
    return lambda c: c.try_cast(f"decimal({precision},{scale})")


def as_text(c: Column) -> Column:
    return c


def as_bool(c: Column) -> Column:
    """True for the usual spellings, false for any other text; never an error."""
    return F.when(c.isNotNull(), c.isin(*TRUE))


def as_date(c: Column) -> Column:
    """ISO date; months and days may lack their leading zero."""
    return F.try_to_timestamp(c, F.lit("y-M-d")).cast("date")


def as_timestamp(pattern: str = "y-M-d H:m:s") -> Callable[[Column], Column]:
    return lambda c: F.try_to_timestamp(c, F.lit(pattern)).cast("timestamp_ntz")


ISO_TIMESTAMP = as_timestamp("y-M-d'T'H:m:s")
COMPACT_TIMESTAMP = as_timestamp("yyyyMMdd-HHmmss")


def as_compact_date(c: Column) -> Column:
    """yyyymmdd; all zeros are no date, and no error either."""
    return F.when(c.rlike(ZEROS), F.lit(None).cast("date")).otherwise(F.try_to_timestamp(c, F.lit("yyyyMMdd")).cast("date"))


def to_millis(c: Column) -> Column:
    return F.date_trunc("MILLISECOND", c)


@dataclass(frozen=True)
class Cast:
    """How a text column is read: its name, the cast, and what counts as no value without being an error."""

    name: str
    cast: Callable[[Column], Column] = as_text
    empty: str | None = None


def cast_all(df: DataFrame, casts: list[Cast], keep: list[str] = (), errors: str = "_dq_errors") -> DataFrame:
    """Cast text columns by their names and collect error objects as a JSON array, NULL for a clean row."""
    values, faults = [], []
    for c in casts:
        raw = blank_to_null(F.col(c.name))
        value = c.cast(raw)
        fine = raw.isNull() | value.isNotNull()
        if c.empty:
            fine = fine | raw.rlike(c.empty)
        values.append(value.alias(c.name))
        if c.cast is not as_text and c.cast is not as_bool:
            faults.append(
                F.when(
                    ~fine,
                    F.struct(
                        F.lit(c.name).alias("column"),
                        raw.alias("raw_value"),
                        F.lit("CAST").alias("error_type"),
                        F.concat(F.lit("cannot read "), F.lit(c.name)).alias("error_msg"),
                    ),
                )
            )
    return df.select(*keep, *values, pack_errors(faults).alias(errors))


def pack_errors(faults: list[Column]) -> Column:
    """JSON array of the error objects that are there; NULL if there is none."""
    if not faults:
        return F.lit(None).cast("string")
    there = F.filter(F.array(*faults), lambda e: e.isNotNull())
    return F.when(F.size(there) > 0, F.to_json(there))


def error_count(packed: Column) -> Column:
    return F.coalesce(F.json_array_length(packed), F.lit(0))
