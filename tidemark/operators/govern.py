"""Masking, classification, erasure, retention and access audit."""

from __future__ import annotations

import json
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.sources.store import Store

# Levels from open to closed, roles that see raw values, and the text that stands for a masked one.
LEVELS = ("public", "internal", "confidential", "restricted")
PRIVILEGED = ("custodian", "engineer", "admin")
MASKED = "***MASKED***"


class UnclassifiedColumn(ValueError):
    pass


def classify(df: DataFrame, levels: dict[str, str]) -> DataFrame:
    """Write each column's level into its metadata; all columns must have one."""
    missing = [c for c in df.columns if levels.get(c) not in LEVELS]
    if missing:
        raise UnclassifiedColumn(", ".join(missing))
    return df.select(*[F.col(c).alias(c, metadata=df.schema[c].metadata | {"level": levels[c]}) for c in df.columns])


def mask(df: DataFrame, role: str, above: str = "confidential") -> DataFrame:
    """Columns classified above a level are masked for roles without privilege: text by a fixed text, others by NULL."""
    limit, cols = LEVELS.index(above), []
    for f in df.schema.fields:
        if "level" not in f.metadata:
            raise UnclassifiedColumn(f.name)
        hidden = role not in PRIVILEGED and LEVELS.index(f.metadata["level"]) > limit
        masked = F.when(F.col(f.name).isNotNull(), F.lit(MASKED)) if isinstance(f.dataType, StringType) else F.lit(None).cast(f.dataType)
        cols.append(masked.alias(f.name, metadata=f.metadata) if hidden else F.col(f.name))
    return df.select(*cols)


def visible(df: DataFrame, level: str) -> DataFrame:
    """Only the columns classified at or below a level."""
    if missing := [f.name for f in df.schema.fields if "level" not in f.metadata]:
        raise UnclassifiedColumn(", ".join(missing))
    return df.select(*[f.name for f in df.schema.fields if LEVELS.index(f.metadata["level"]) <= LEVELS.index(level)])


def column_levels(df: DataFrame, table: str) -> DataFrame:
    """(table_name, column_name, level) rows of a classified table."""
    rows = [(table, f.name, f.metadata.get("level")) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "table_name string, column_name string, level string")


def erase(df: DataFrame, subjects: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """NULL the personal columns of the subjects' rows; rows, keys and dates stay."""
    marks = subjects.select(F.col(key).alias("_subject")).distinct()
    rows = df.join(marks, F.col(key) == F.col("_subject"), "left")
    return rows.withColumns({c: F.when(F.col("_subject").isNull(), F.col(c)) for c in columns}).drop("_subject")


def erasure_log(df: DataFrame, subjects: DataFrame, key: str, layer: str) -> DataFrame:
    """How many rows of a layer each subject has."""
    marks = subjects.select(F.col(key).alias("_subject")).distinct()
    counted = marks.join(df.select(key), F.col(key) == F.col("_subject"), "left").groupBy("_subject").agg(F.count(key).alias("rows_erased"))
    return counted.select(F.col("_subject").alias("subject"), F.lit(layer).alias("layer"), "rows_erased")


@dataclass(frozen=True)
class Personal:
    """Where a layer's table names a subject, and what is personal in it."""

    table: str
    key: str
    columns: tuple[str, ...]


def erase_in_place(store: Store, subjects: DataFrame, subject: str, layers: list[Personal], request: str, log: str = "erasure_log") -> dict[str, int]:
    """Erase subjects from stored tables of every layer; returns how many files of each table were written again.

    The files that hold rows of a subject are found by one scan of the key column. Those alone are written again, with
    the subjects' personal columns NULL; all other files stay as they are, byte for byte. The log gets a row for each
    table and subject. One commit puts all of it in force, so no reader sees a subject erased in one layer only. Older
    versions' files stay until they are removed (``forget``).
    """
    base, staged, drop, written = store.manifest(), [], {}, {}
    marks = subjects.select(F.col(subject).alias("_subject")).where(F.col("_subject").isNotNull()).distinct()
    logs = None
    for p in layers:
        every = {f["path"]: f for f in store.files(p.table)}
        rows = store.read(p.table)
        held = rows.select(F.col(p.key).alias("_subject"), F.col("_metadata.file_path").alias("_file")).join(marks, "_subject").select("_file").distinct()
        # Names of files, not rows, reach the driver.
        met = [r["_file"][r["_file"].rindex(f"/{p.table}/") + 1 :] for r in held.collect()]
        hit = sorted(k if k in every else unquote(k) for k in met)
        written[p.table] = len(hit)
        by_tags: dict[str, list[dict]] = {}
        for k in hit:
            by_tags.setdefault(json.dumps(every[k]["tags"], sort_keys=True), []).append(every[k])
        for tags, files in by_tags.items():
            staged.append(store.stage(p.table, erase(store.read_files(p.table, files), marks.withColumnRenamed("_subject", p.key), p.key, list(p.columns)), **json.loads(tags)))
        drop[p.table] = hit
        entry = erasure_log(store.read_files(p.table, [every[k] for k in hit]), marks.select(F.col("_subject").alias(p.key)), p.key, p.table)
        logs = entry if logs is None else logs.unionByName(entry)
    staged.append(store.stage(log, logs.withColumn("request", F.lit(request))))
    store.commit(*staged, drop=drop, base=base)
    return written


def forget(store: Store) -> list[str]:
    """Delete the files that the newest version no longer names; returns their paths. Older versions can't be read after."""
    now = {f["path"] for t in store.manifest()["tables"].values() for f in t["files"]}
    old = {f["path"] for v in range(1, store.version()) for t in store.manifest(v)["tables"].values() for f in t["files"]} - now
    return store.remove(sorted(old))


def access_audit(log: DataFrame, restricted: list[str], since: Column) -> DataFrame:
    """Log rows since a time whose objects (array of struct with columns) name a restricted column."""
    touched = F.exists("objects", lambda o: F.exists(o["columns"], lambda c: c.isin(*restricted)))
    return log.where((F.col("ts") >= since) & touched)


def retain(df: DataFrame, ts: str, now: Column, days: int, columns: list[str] | None = None) -> DataFrame:
    """Rows older than the limit lose their personal columns, or go where no columns are named."""
    young = F.col(ts) >= now - F.make_interval(days=F.lit(days))
    return df.where(young) if columns is None else df.withColumns({c: F.when(young, F.col(c)) for c in columns})


def analyst_view(df: DataFrame, role: str, name: str, day: Column | None = None, key: str | None = None) -> DataFrame:
    """A temporary view of a classified gold table: masked, and as of a day or current where it has versions."""
    from tidemark.operators.scd import as_of

    rows = as_of(df, day, key) if day is not None else df.where("is_current") if "is_current" in df.columns else df
    rows = mask(rows, role)
    rows.createOrReplaceTempView(name)
    return rows
