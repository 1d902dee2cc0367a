"""Loading batches of source files into stored bronze tables: a batch goes in whole, once, with evidence of what was read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import reconcile
from tidemark.plans import warehouse
from tidemark.sources import control
from tidemark.sources.store import Store

# The files of a batch, by source. Which of them are there differs from batch to batch.
FILES = {
    "date": "Date.txt",
    "time": "Time.txt",
    "status_type": "StatusType.txt",
    "tax_rate": "TaxRate.txt",
    "industry": "Industry.txt",
    "trade_type": "TradeType.txt",
    "hr": "HR.csv",
    "prospect": "Prospect.csv",
    "account": "Account.txt",
    "customer": "Customer.txt",
    "trade": "Trade.txt",
    "trade_history": "TradeHistory.txt",
    "holding_history": "HoldingHistory.txt",
    "watch_history": "WatchHistory.txt",
    "daily_market": "DailyMarket.txt",
    "cash_transaction": "CashTransaction.txt",
    "finwire": "FINWIRE*",
    "actions": "CustomerMgmt.xml",
    "batch_control": "BatchDate.txt",
}
REQUIRED = "batch_control"
AUDIT, CONTROL, LOG = "*_audit.csv", "batch_control", "dq_audit_log"


class AlreadyLoaded(ValueError):
    pass


class MissingFile(ValueError):
    pass


def present(spark: SparkSession, folder: str, names: dict[str, str]) -> dict[str, str]:
    """Those sources whose files are in a folder (globs are resolved by the file system)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {n: g for n, g in names.items() if fs.globStatus(path(f"{folder}/{g}"))}


def loaded_batches(store: Store) -> set[int]:
    return {f["tags"]["batch"] for f in store.files(CONTROL)}


def audited(spark: SparkSession, folder: str) -> DataFrame:
    """(dataset, expected) of a batch's audit files; the dataset is the file's name without its ending."""
    stem = F.regexp_extract("_metadata.file_path", warehouse.BELOW_BATCH, 1)
    named = control.read_audit(spark, f"{folder}/{AUDIT}", keep={"file": F.regexp_replace(stem, r"_audit\.csv$", "")})
    return reconcile.audit_counts(named.withColumn("dataset", F.col("file")))


def load_batch(store: Store, root: str, batch: int, loaded_at: Column, run_id: str, force: bool = False) -> DataFrame:
    """Load the files of ``root``/Batch<n> into the store's bronze tables; returns the batch's rows of the audit log.

    A batch that is loaded already is refused, unless ``force``: then its rows are replaced in every table, also in
    tables whose file is no longer there. All tables, the control row and the log come into force by one commit, so a
    load that stops leaves nothing. The log holds each audited file's stated rows against those that were stored.
    """
    spark, folder = store.spark, f"{root.rstrip('/')}/Batch{batch}"
    if batch in loaded_batches(store) and not force:
        raise AlreadyLoaded(f"batch {batch} is in the store; load it by force to replace it")
    names = present(spark, folder, FILES)
    if REQUIRED not in names:
        raise MissingFile(f"{folder}/{FILES[REQUIRED]}")
    base = store.manifest()
    tables = warehouse.read_bronze(spark, root, {n: f"Batch{batch}/{g}" for n, g in names.items()}, loaded_at)
    staged = [store.stage(n, df, batch=batch) for n, df in tables.items()]
    if present(spark, folder, {"audit": AUDIT}):
        staged.append(store.stage(LOG, _log(store, staged, audited(spark, folder)).select(F.lit(run_id).alias("run_id"), F.lit(batch).alias("batch"), "dataset", "expected", "actual", "status", "message"), batch=batch, run=run_id))
    here = {s["table"] for s in staged}
    gone = {t: [f["path"] for f in v["files"] if f["tags"].get("batch") == batch] for t, v in base["tables"].items() if t not in here and t != LOG}
    store.commit(*staged, replace=lambda t, tags: t != LOG and tags.get("batch") == batch, drop=gone, base=base)
    log = [f for f in store.files(LOG) if f["tags"]["run"] == run_id and f["tags"]["batch"] == batch]
    return store.read_files(LOG, log) if log else spark.createDataFrame([], "run_id string, batch int, dataset string, expected long, actual long, status string, message string")


def _log(store: Store, staged: list[dict], expected: DataFrame) -> DataFrame:
    """Stated rows of files against the rows stored from them; only the file column of the staged tables is read."""
    loaded = None
    for s in staged:
        if any(f["name"] == "_source_file" for f in s["schema"]["fields"]):
            rows = store.read_staged(s).select(F.regexp_replace("_source_file", r"\.(txt|csv|xml)$", "").alias("dataset"))
            loaded = rows if loaded is None else loaded.unionByName(rows)
    if loaded is None:
        loaded = store.spark.createDataFrame([], "dataset string")
    return reconcile.against_audit(expected, loaded.groupBy("dataset").agg(F.count("*").alias("actual")))


def bronze_of(store: Store) -> dict[str, DataFrame]:
    """The stored bronze tables, each read when it is asked for: what the models are built on."""
    return warehouse.Lazy({n: (lambda n=n: store.read(n)) for n in store.manifest()["tables"] if n != LOG})
