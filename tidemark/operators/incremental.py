"""Incremental appends by high-water mark, equal to a full refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import row_hash
from tidemark.sources.store import Store


class SchemaChanged(ValueError):
    pass


def increment(source: DataFrame, target: DataFrame, columns: list[str], mark: str = "_loaded_at", late: bool = False) -> DataFrame:
    """Rows to append: newer than the target's mark, without re-sends inside the slice or of what the target holds.

    An empty target takes all rows. ``late`` takes older rows too, as the hash alone says what is new. The
    target's columns must be the source's, with the hash.
    """
    check_schema(source, target)
    newest = target.agg(F.max(mark).alias("_newest"))
    rows = source if late else source.join(F.broadcast(newest), F.col("_newest").isNull() | (F.col(mark) > F.col("_newest")), "inner").drop("_newest")
    rows = rows.withColumn("_row_hash", row_hash(columns)).dropDuplicates(["_row_hash"])
    return rows.join(target.select("_row_hash"), "_row_hash", "left_anti").select(*target.columns)


def check_schema(source: DataFrame, target: DataFrame) -> None:
    want = {f.name: f.dataType for f in source.schema.fields} | {"_row_hash": target.schema["_row_hash"].dataType}
    if want != {f.name: f.dataType for f in target.schema.fields}:
        raise SchemaChanged(f"{sorted(want)} instead of {sorted(target.columns)}")


def incremental(steps: list[DataFrame], columns: list[str], mark: str = "_loaded_at") -> DataFrame:
    """What a target holds after the steps were appended one by one, as one plan."""
    target = steps[0].withColumn("_row_hash", row_hash(columns)).dropDuplicates(["_row_hash"])
    for step in steps[1:]:
        target = target.unionByName(increment(step, target, columns, mark))
    return target


def stored_mark(store: Store, table: str) -> int | float | str | None:
    """The greatest mark of the files in force: read from their tags, not from the table."""
    return max((f["tags"]["mark"] for f in store.files(table) if f["tags"].get("mark") is not None), default=None)


def slice_of(source: DataFrame, store: Store, table: str, columns: list[str], span: str, mark: str = "_loaded_at") -> tuple[DataFrame, dict]:
    """(rows to append, tags of the step): what ``append_step`` writes.

    The mark is a literal, so it is pushed into the source's scan. A row that was sent before has the same business time
    ``span`` then as now, so the slice is compared with the files alone whose least and greatest times meet the slice's,
    and rows without time with the files that have such rows. Rows without mark are taken by a first step alone.
    """
    newest = stored_mark(store, table)
    rows = source if newest is None else source.where(F.col(mark) > F.lit(newest).cast(source.schema[mark].dataType))
    text = lambda c: c.cast("string")
    least, most, last, n, timed = rows.agg(text(F.min(span)), text(F.max(span)), F.max(mark), F.count("*"), F.count(span)).first()
    tags = {"least": least, "most": most, "mark": last, "rows": n, "untimed": n - timed}
    rows = rows.withColumn("_row_hash", row_hash(columns)).dropDuplicates(["_row_hash"])
    if newest is None:
        return rows, tags
    check_schema(source, store.read(table, lambda tags: False))
    # Times of one type have texts of one form, which sort as the times do.
    within = lambda t: None not in (t["least"], least) and t["least"] <= most and t["most"] >= least
    meets = lambda t: within(t) or bool(t["untimed"] and n > timed)
    return rows.join(store.read(table, meets).select("_row_hash"), "_row_hash", "left_anti").select(*source.columns, "_row_hash"), tags


def append_step(source: DataFrame, store: Store, table: str, columns: list[str], span: str, mark: str = "_loaded_at") -> int:
    """Append what is newer than the stored mark and not held yet; returns the rows that the slice had.

    Each step reads its slice twice (times, then rows) and the target's files that may hold re-sends once; the plan has
    the same size at every step. Mark and times are stored with the files by the commit that puts them in force, so a
    step that stopped half-way is simply run again. Times in ``span`` must be timestamps, dates or texts that sort.
    """
    rows, tags = slice_of(source, store, table, columns, span, mark)
    if tags["rows"] == 0:
        if not store.manifest()["tables"].get(table):
            store.commit(store.stage(table, rows, **tags))
        return 0
    base = store.manifest()
    store.commit(store.stage(table, rows, **tags), base=base)
    return tags["rows"]


def segments(df: DataFrame, ts: str, n: int) -> Column:
    """Number of the time segment of a row, of ``n`` with about equal numbers of rows; rows without time come last.

    Borders are approximate quantiles of the whole table: one aggregate, of which n numbers reach the driver.
    """
    seconds = F.col(ts).cast("timestamp").cast("double")
    borders = df.agg(F.percentile_approx(seconds, [k / n for k in range(1, n)], 10_000)).first()[0] or []
    at = F.size(F.filter(F.array(*[F.lit(float(b)) for b in sorted(set(borders))]).cast("array<double>"), lambda b: b <= seconds))
    return F.when(F.col(ts).isNull(), n).otherwise(at)
