"""Versioned entities: type-1, type-2, event logs and status transitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import row_hash, surrogate_key
from tidemark.operators.windows import changed_only, close_intervals, day_collapse, dedup_latest, forward_fill, forward_fill_segmented
from tidemark.sources.store import Store


def scd2(
    events: DataFrame,
    key: str,
    ts: str,
    order: list[str],
    tracked: list[str],
    carried: list[str] = (),
    start: Column | None = None,
    batch: list[str] = (),
    segment: Column | None = None,
) -> DataFrame:
    """Versions of an entity from its change events.

    Exact re-sends go (same key, order columns and content); every event is filled forward before the last
    event of each day (and batch) is taken; a version stays if a tracked column changed; intervals are closed.
    ``order`` is the total order of events. All steps share one shuffle, by key.

    With ``segment`` (a number that does not fall along time) a key may hold a large part of all events: re-sends are
    found by key and content, segments of a key are filled in parallel, and days are collapsed by key and day. What then
    meets in one task for a key is a row for each day (and batch).
    """
    content = [*tracked, *carried]
    rows = events if segment is not None else events.repartition(key)
    rows = rows.withColumn("_hash", row_hash([*order, ts, *content])).dropDuplicates([key, "_hash"])
    asc = [F.col(c).asc_nulls_last() for c in [ts, *order]] + [F.col("_hash")]
    desc = [F.col(c).desc_nulls_first() for c in [ts, *order]] + [F.col("_hash").desc()]
    rows = forward_fill(rows, [key], asc, content) if segment is None else forward_fill_segmented(rows, [key], [ts, *order, "_hash"], content, segment)
    rows = day_collapse(rows, [key, *batch], ts, desc)
    rows = changed_only(rows, [key], asc, tracked)
    rows = rows.withColumn("valid_from_date", start if start is not None else F.to_date(ts))
    by = [F.col("valid_from_date").asc_nulls_last(), *asc]
    rows = close_intervals(rows, [key], by).drop("_hash")
    return rows.withColumn("sk", surrogate_key(key, "valid_from_date", *order))


def merge_batch(store: Store, batch: DataFrame, key: str, build: Callable[[DataFrame], DataFrame], n_buckets: int = 64, events: str = "events", versions: str = "versions") -> int:
    """Bring a batch of events into stored versions; only keys of the batch are built again. Returns how many buckets it touched.

    The store keeps the events and the versions, both in buckets of the key's hash. Of the buckets that the batch
    touches, the batch's keys get new versions from all their events, late ones included, so intervals are opened again
    and closed as a full build would; the other keys' versions are carried over as they are, and other buckets are not
    read. ``build`` makes versions of events (as ``scd2`` does) and must keep the key. One commit puts the batch's events
    and the new versions in force, so a batch that was stopped is merged again from the start. Events without key have no versions.
    """
    base = store.manifest()
    step = f"{base['version'] + 1}"
    bucketed = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(n_buckets)).cast("int"))
    staged_events = store.stage(events, bucketed(batch), by=["bucket"], step=step)
    touched = {f["tags"]["bucket"] for f in staged_events["files"]}
    if not touched:
        return 0
    here = lambda tags: tags["bucket"] in touched
    new = store.spark.read.schema(bucketed(batch).schema).parquet(*[f"{store.folder}/{f['path']}" for f in staged_events["files"]])
    keys = new.select(key).distinct()
    held = base["tables"]
    known = store.read(events, here) if events in held else new.limit(0)
    rows = known.join(keys, key, "left_semi").unionByName(new)
    built = bucketed(build(rows.drop("bucket")))
    if versions in held:
        built = store.read(versions, here).join(keys, key, "left_anti").unionByName(built)
    # Few files for each bucket: rows of a bucket meet in the task that writes it, split where one is large.
    staged_versions = store.stage(versions, built.hint("rebalance", "bucket"), by=["bucket"], step=step)
    store.commit(staged_events, staged_versions, replace=lambda table, tags: table == versions and tags["bucket"] in touched, base=base)
    return len(touched)


def as_of(versions: DataFrame, day: Column, key: str, start: str = "valid_from_date", end: str = "valid_to_date") -> DataFrame:
    """The version of each entity on a day; both ends count, an open end is NULL or 9999-12-31."""
    hit = versions.where((F.col(start) <= day) & (day <= F.coalesce(F.col(end), F.lit("9999-12-31").cast("date"))))
    return dedup_latest(hit, [key], [F.col(start).desc_nulls_first()])


def scd1(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key over all full re-extracts: the newest wins."""
    return dedup_latest(rows, keys, order)


latest_state = scd1


def event_log(rows: DataFrame, columns: list[str]) -> DataFrame:
    """An append-only log without exact re-sends."""
    return rows.withColumn("_row_hash", row_hash(columns)).dropDuplicates(["_row_hash"])


def status_transitions(history: DataFrame, states: DataFrame, keys: list[str], order: list[Column], status: str) -> DataFrame:
    """Lifecycle rows of the first batch, and of later states only the changes; each row names its origin."""
    moved = changed_only(states, keys, order, [status])
    return history.withColumn("origin", F.lit("history")).unionByName(moved.withColumn("origin", F.lit("state")))


def transitions_not_allowed(rows: DataFrame, keys: list[str], order: list[Column], status: str, allowed: DataFrame) -> DataFrame:
    """Consecutive (previous, current) pairs that ``allowed`` (previous, current) does not hold."""
    w = Window.partitionBy(*keys).orderBy(*order)
    pairs = rows.withColumn("previous", F.lag(status).over(w)).withColumn("current", F.col(status)).where("previous is not null and previous <> current")
    return pairs.join(allowed, ["previous", "current"], "left_anti")
