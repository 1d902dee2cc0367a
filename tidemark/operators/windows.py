"""Window operators. NULL order is always written out: ascending puts NULL last, descending puts it first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def up(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def down(name: str) -> Column:
    return F.col(name).desc_nulls_first()


def dedup_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``; Spark keeps one row per key and task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def forward_fill(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Each column's last value so far, NULLs skipped; one window serves all columns."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def _unused(df: DataFrame, wanted: str) -> str:
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def nulls_last(names: list[str]) -> Column:
    """A value that sorts as the columns do, ascending with NULL last."""
    return F.struct(*[x for c in names for x in (F.col(c).isNull(), F.col(c))])


def forward_fill_segmented(df: DataFrame, keys: list[str], order: list[str], columns: list[str], segment: Column) -> DataFrame:
    """``forward_fill`` (``order``: names, ascending, NULL last) for keys with very many rows: segments of a key are filled in parallel.

    ``segment`` numbers a key's segments and must not fall along ``order``; make it by time. The last value of each
    segment and column is aggregated, combined before its shuffle; a small window over each key's segments carries them
    on; what was carried into a segment enters it as a row of its own before the others. So rows are shuffled once, by
    key and segment, and no task holds more than a segment of a key.
    """
    seg, real = _unused(df, "_segment"), _unused(df, "_real")
    rows = df.withColumn(seg, segment)
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), nulls_last(order))).alias(c) for c in columns]
    ends = rows.groupBy(*keys, seg).agg(*last)
    before = Window.partitionBy(*keys).orderBy(seg).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumns({c: F.last(c, ignorenulls=True).over(before) for c in columns})
    held = {*keys, seg, *columns}
    carried = carried.select(*[F.col(f.name) if f.name in held else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    both = carried.withColumn(real, F.lit(False)).unionByName(rows.withColumn(real, F.lit(True)))
    w = Window.partitionBy(*keys, seg).orderBy(real, *[up(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    return filled.where(F.col(real)).select(*df.columns)


def day_collapse(df: DataFrame, keys: list[str], ts: str, order: list[Column]) -> DataFrame:
    """The last event of each key and day, in ``order`` from the latest on."""
    return dedup_latest(df.withColumn("_day", F.to_date(ts)), [*keys, "_day"], order).drop("_day")


def changed_only(df: DataFrame, keys: list[str], order: list[Column], tracked: list[str]) -> DataFrame:
    """First rows, and rows whose tracked columns differ from the row before; NULL equals NULL."""
    w = Window.partitionBy(*keys).orderBy(*order)
    now = F.struct(*tracked)
    rows = df.withColumns({"_first": F.row_number().over(w) == 1, "_same": now.eqNullSafe(F.lag(now).over(w))})
    return rows.where("_first or not _same").drop("_first", "_same")


def close_intervals(df: DataFrame, keys: list[str], order: list[Column], start: str = "valid_from_date", end: str = "valid_to_date", current: str = "is_current") -> DataFrame:
    """End each version the day before the next one starts; the last is open (9999-12-31) and current."""
    following = F.lead(start).over(Window.partitionBy(*keys).orderBy(*order))
    is_last = F.lead(F.lit(True)).over(Window.partitionBy(*keys).orderBy(*order)).isNull()
    return df.withColumns({end: F.when(is_last, F.lit("9999-12-31").cast("date")).otherwise(F.date_sub(following, 1)), current: is_last})
