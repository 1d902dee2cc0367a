"""The incremental append as streaming jobs: what was sent before is known from keyed state, or from files within a watermark."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.functions.keys import row_hash
from tidemark.sources.store import Store, observed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def append_new(events: DataFrame, target: str, columns: list[str], checkpoint: str) -> StreamingQuery:
    """Run until all files there are have been read; each row's hash is kept as keyed state, so no micro-batch reads the target.

    The state is partitioned by hash and lies in RocksDB, so a micro-batch costs its own rows and lookups of theirs, not
    the size of the target. The file sink and the checkpoint make a restart exact. Without a watermark the state keeps
    one hash for each row ever sent (see ``append_within_watermark`` and ``append_with_late`` for bounded state).
    """
    spark = events.sparkSession
    rows = events.withColumn("_row_hash", row_hash(columns)).dropDuplicates(["_row_hash"])
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:  # the query has taken its settings
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def append_within_watermark(events: DataFrame, ts: str, columns: list[str], late: str, target: str, checkpoint: str) -> StreamingQuery:
    """The same with bounded state: re-sends are dropped while they come within the watermark."""
    rows = events.withWatermark(ts, late).withColumn("_row_hash", row_hash(columns)).dropDuplicatesWithinWatermark(["_row_hash"])
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_with_late(events: DataFrame, ts: str, columns: list[str], delay: timedelta, store: Store, checkpoint: str, table: str = "events", evidence: str = "evidence") -> StreamingQuery:
    """Keep what comes in time once, and keep late and re-sent rows as evidence instead of dropping them.

    The watermark of a micro-batch is the newest time kept before it, less ``delay``. Rows before it are ``late``; rows
    whose content was kept before, or comes twice in the micro-batch, are ``resent``; all others are ``kept``. Rows
    without time are kept. A micro-batch is compared with those files alone that reach its watermark, so what it reads
    is bounded by the delay. It is written in one pass, cut by outcome, and one commit puts both tables' files in force
    with the micro-batch's number, so that one that is run again replaces itself.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        base = store.manifest()
        earlier = lambda tags: tags["epoch"] < epoch
        newest = max((f["tags"]["most"] for f in store.files(table, earlier) if f["tags"]["most"]), default=None)
        rows = batch.withColumn("_row_hash", row_hash(columns))
        late, held = F.lit(False), None
        if newest is not None:
            mark = str(datetime.fromisoformat(newest) - delay)
            limit = F.lit(mark).cast(batch.schema[ts].dataType)
            late = F.coalesce(F.col(ts) < limit, F.lit(False))
            known = store.read(table, lambda tags: earlier(tags) and (tags["most"] is None or tags["most"] >= mark))
            held = known.where(F.col(ts).isNull() | (F.col(ts) >= limit)).select("_row_hash").distinct().withColumn("_held", F.lit(True))
        rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_row_hash").orderBy(ts)))
        rows = rows.join(held, "_row_hash", "left") if held is not None else rows.withColumn("_held", F.lit(None).cast("boolean"))
        outcome = F.when(late, "late").when(F.col("_held").isNotNull() | (F.col("_nth") > 1), "resent").otherwise("kept")
        rows = rows.withColumn("outcome", outcome).select(*batch.columns, "_row_hash", "outcome")
        rows, seen = observed(rows, f"epoch{epoch}", most=F.max(F.when(F.col("outcome") == "kept", F.col(ts))).cast("string"), n=F.count("*"))
        staged = store.stage(table, rows, by=["outcome"], epoch=epoch)
        if not seen.get["n"]:
            return
        of = lambda kept: [f | {"tags": f["tags"] | {"most": seen.get["most"]}} for f in staged["files"] if (f["tags"]["outcome"] == "kept") == kept]
        parts = [staged | {"files": of(True)}, staged | {"table": evidence, "files": of(False)}]
        store.commit(*parts, replace=lambda _, tags: tags["epoch"] == epoch, base=base)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
