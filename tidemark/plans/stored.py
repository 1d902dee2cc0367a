"""Queries that write and read back: loads, appends, merges, streams, erasure, evidence and files, each with SQL.

Every query works in a new folder below the shared one (``spark.checkpoint.dir``).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import govern, incremental, quality, reconcile, scd, star, windows
from tidemark.plans import ingest, queries, specs, warehouse
from tidemark.plans.queries import EV, EVENT_VERSIONS, ORDER_VERSIONS, batch_of, events, money, query, total
from tidemark.session import shared_folder, table
from tidemark.sources import control, delimited, sinks, xml
from tidemark.sources.store import Store, reingest
from tidemark.streaming import append

# ---------------------------------------------------------------- loads of several tables


def batches(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Three tables with a batch each row came in."""
    return {
        "events": table(spark, d, "events").withColumn("_batch_id", batch_of()),
        "orders": table(spark, d, "orders").withColumn("_batch_id", (F.col("o_orderkey") % 3 + 1).cast("int")),
        "lineitem": table(spark, d, "lineitem").withColumn("_batch_id", F.least(F.col("l_linenumber"), F.lit(3)).cast("int")),
    }


def loaded(spark: SparkSession, d: str, name: str) -> Store:
    """A store with three batches of the tables, of which the second is faulty: rows are missing, and amounts are wrong."""
    store = Store(spark, shared_folder(spark, name))
    for b in (1, 2, 3):
        parts = {n: df.where(F.col("_batch_id") == b) for n, df in batches(spark, d).items()}
        if b == 2:
            parts["orders"] = parts["orders"].where("o_orderkey % 4 <> 0").withColumn("o_totalprice", F.lit(1.0))
            parts["lineitem"] = parts["lineitem"].where("l_orderkey % 5 <> 0")
        reingest(store, b, parts)
    return store


@query(
    "WITH " + EV + """ SELECT 'events' AS table_name, _batch_id::INT AS batch, count(*) AS n, CAST(sum(value::DECIMAL(15,2)) AS DOUBLE) AS total FROM ev GROUP BY 2
  UNION ALL SELECT 'orders', (o_orderkey % 3 + 1)::INT, count(*), CAST(sum(o_totalprice::DECIMAL(15,2)) AS DOUBLE) FROM orders GROUP BY 2
  UNION ALL SELECT 'lineitem', least(l_linenumber, 3)::INT, count(*), CAST(sum(l_extendedprice::DECIMAL(15,2)) AS DOUBLE) FROM lineitem GROUP BY 2"""
)
def batch_reingest(spark: SparkSession, d: str) -> DataFrame:
    """Batch 2 of three tables is loaded again: all are staged, one manifest swaps them, readers see all of it or none."""
    store = loaded(spark, d, "reingest")
    reingest(store, 2, {n: df.where("_batch_id = 2") for n, df in batches(spark, d).items()})
    amount = {"events": "value", "orders": "o_totalprice", "lineitem": "l_extendedprice"}
    parts = [store.read(n).groupBy(F.lit(n).alias("table_name"), F.col("_batch_id").alias("batch")).agg(F.count("*").alias("n"), total(money(c), "total")) for n, c in amount.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, CAST(sum(c_acctbal::DECIMAL(15,2)) AS DOUBLE) AS balance FROM customer GROUP BY 1, 2")
def contract_load(spark: SparkSession, d: str) -> DataFrame:
    """Append under a contract, by name and in two batches, and read back; the source's column order and extra columns don't matter."""
    path = f"{shared_folder(spark, 'contract')}/customer"
    rows = table(spark, d, "customer").withColumns({"_batch_id": (F.col("c_custkey") % 2 + 1).cast("int"), "noise": F.lit("x")})
    contract = rows.select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal", "_batch_id").schema
    for b in (1, 2):
        sinks.append(rows.where(F.col("_batch_id") == b).select(*reversed(rows.columns)), path, contract)
    held = spark.read.schema(contract).parquet(path)
    return held.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), total(money("c_acctbal"), "balance"))


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def fan_out_union(spark: SparkSession, d: str) -> DataFrame:
    """One pass over the events writes a target for each type; the targets are read back and put together."""
    e, path = table(spark, d, "events"), f"{shared_folder(spark, 'fan-out')}/targets"
    kinds = ["click", "view", "purchase", "signup", "error"]
    sinks.fan_out(e, path, "event_type", kinds)
    whole = None
    for k in [*kinds, "other"]:
        part = sinks.read_target(spark, path, k, e.schema)
        whole = part if whole is None else whole.unionByName(part)
    return whole.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


@query(
    "WITH kinds AS (SELECT unnest(['click', 'view', 'purchase', 'other']) AS target) SELECT target, count(event_id) AS n FROM kinds LEFT JOIN events ON target = CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type ELSE 'other' END GROUP BY 1"
)
def fan_out_counts(spark: SparkSession, d: str) -> DataFrame:
    """What each target got, counted while it was written; empty targets count 0."""
    counts = sinks.fan_out(table(spark, d, "events"), f"{shared_folder(spark, 'fan-out')}/targets", "event_type", ["click", "view", "purchase"])
    return spark.createDataFrame(list(counts.items()), "target string, n long")


@query(
    "WITH " + EV + """, s AS (SELECT _batch_id, count(*) AS expected, count(*) FILTER (event_type <> 'error') AS actual FROM ev GROUP BY 1)
  SELECT 'run1' AS run_id, 'events' AS model, _batch_id, expected, actual, CASE WHEN round(abs(expected - actual) / expected::DOUBLE * 100, 2) > 5 THEN 'WARNING' ELSE 'PASS' END AS status FROM s
  UNION ALL SELECT 'run2', 'events', _batch_id, expected, expected, 'PASS' FROM s"""
)
def evidence_log(spark: SparkSession, d: str) -> DataFrame:
    """An append-only log of reconciliations: a first run with errors left out, a second one with all rows, read back."""
    e, path = events(spark, d), f"{shared_folder(spark, 'evidence')}/log"
    for run, target in (("run1", e.where("event_type <> 'error'")), ("run2", e)):
        sinks.evidence(reconcile.by_batch(e, target, 5.0), run_id=run, model="events").write.mode("append").parquet(path)
    return spark.read.parquet(path).select("run_id", "model", "_batch_id", "expected", "actual", "status")


# ---------------------------------------------------------------- appends


def logged_events(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """Events with the number of the load they came in, the third with re-sent rows of the first."""
    e = table(spark, d, "events").withColumn("_loaded_at", batch_of())
    again = e.where("_loaded_at = 1 and event_id % 7 = 0").withColumn("_loaded_at", F.lit(3))
    return e.unionByName(again), [c for c in e.columns if c != "_loaded_at"]


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def incremental_append(spark: SparkSession, d: str) -> DataFrame:
    """Three loads with a stored mark, the later ones with re-sent rows, hold what a full refresh holds."""
    rows, columns = logged_events(spark, d)
    store = Store(spark, shared_folder(spark, "append"))
    for k in (1, 2, 3):
        incremental.append_step(rows.where(F.col("_loaded_at") <= k), store, "events", columns, span="ts")
    return store.read("events").select(*columns)


def arriving(spark: SparkSession, d: str, steps: int = 3) -> tuple[DataFrame, Column]:
    """Events, and the step each comes in: by its day, a seventeenth of them a step late."""
    day = F.dayofmonth("ts") - 1
    step = F.least(F.floor(day * steps / 30).cast("int") + (F.col("event_id") % 17 == 0).cast("int"), F.lit(steps - 1))
    return table(spark, d, "events"), step


@query("SELECT event_id, ts, user_id, event_type FROM events")
def stream_append(spark: SparkSession, d: str) -> DataFrame:
    """Three files' worth of events as a stream that is started again for each, with re-sent rows; hashes are keyed state."""
    e, step = arriving(spark, d)
    root = shared_folder(spark, "stream")
    columns = ["event_id", "ts", "user_id", "event_type"]
    for k in range(3):
        sent = e.where(step == k)
        again = e.where((step < k) & (F.col("event_id") % 11 == 0))
        sent.unionByName(again).select(*columns).write.mode("append").parquet(f"{root}/in")
        stream = append.read_events(spark, f"{root}/in", e.select(*columns).schema)
        append.append_new(stream, f"{root}/out", columns, f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select(*columns)


@query("""WITH a AS (SELECT event_id, user_id, ts, least(floor((day(ts) - 1) * 5 / 30.0)::INT + (event_id % 17 = 0)::INT + 2 * (event_id % 29 = 0)::INT, 4) AS step FROM events),
  m AS (SELECT s.step, max(a.ts) - INTERVAL 4 DAY AS mark FROM (SELECT unnest([0, 1, 2, 3, 4]) AS step) s LEFT JOIN a ON a.step < s.step GROUP BY 1),
  j AS (SELECT event_id, user_id, ts, coalesce(ts < mark, false) AS late FROM a JOIN m USING (step))
  SELECT event_id, user_id, ts, CASE WHEN late THEN 'late' ELSE 'kept' END AS outcome FROM j
  UNION ALL SELECT event_id, user_id, ts, CASE WHEN late THEN 'late' ELSE 'resent' END FROM j WHERE event_id % 13 = 0""")
def stream_late_events(spark: SparkSession, d: str) -> DataFrame:
    """Five arrivals with late and re-sent events: what comes in time is kept once, all else is evidence with its reason."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    late = (F.col("event_id") % 17 == 0).cast("int") + 2 * (F.col("event_id") % 29 == 0).cast("int")
    step = F.least(F.floor((F.dayofmonth("ts") - 1) * 5 / 30).cast("int") + late, F.lit(4))
    root = shared_folder(spark, "late")
    store = Store(spark, f"{root}/store")
    for k in range(5):
        sent = e.where(step == k)
        sent.unionByName(sent.where("event_id % 13 = 0")).write.mode("append").parquet(f"{root}/in")
        stream = append.read_events(spark, f"{root}/in", e.schema)
        append.append_with_late(stream, "ts", e.columns, timedelta(days=4), store, f"{root}/checkpoint").awaitTermination()
    both = store.read("events").unionByName(store.read("evidence"))
    return both.select("event_id", "user_id", "ts", "outcome")


# ---------------------------------------------------------------- versions


def one_hot(e: DataFrame) -> DataFrame:
    """Half of all events belong to one user."""
    return e.withColumn("user_id", F.when(F.col("event_id") % 2 == 0, F.lit(0).cast("bigint")).otherwise(F.col("user_id")))


HOT = EV.replace("ev AS (SELECT event_id, ts, user_id,", "ev AS (SELECT event_id, ts, CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END AS user_id,")
HOT_VERSIONS = EVENT_VERSIONS.replace(EV, HOT)


@query("WITH " + HOT + " SELECT event_id, user_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM ev")
def forward_fill_hot(spark: SparkSession, d: str) -> DataFrame:
    """Forward-fill where one key holds half of all rows: its segments are filled in parallel."""
    e = one_hot(events(spark, d))
    return windows.forward_fill_segmented(e, ["user_id"], ["ts", "event_id"], ["v"], incremental.segments(e, "ts", 32)).select("event_id", "user_id", "v")


@query(f"WITH {HOT_VERSIONS} SELECT * FROM versions")
def scd2_hot(spark: SparkSession, d: str) -> DataFrame:
    """Versions where one entity holds half of all events, re-sent rows among them."""
    e = one_hot(events(spark, d)).select("user_id", "event_id", "ts", "_batch_id", "event_type", "v")
    rows = e.unionByName(e.where("event_id % 10 = 0"))
    v = scd.scd2(rows, "user_id", "ts", ["event_id"], ["event_type"], ["v"], batch=["_batch_id"], segment=incremental.segments(rows, "ts", 32))
    return v.select("user_id", "event_id", "event_type", "v", "valid_from_date", "valid_to_date", "is_current")


@query(f"WITH {EVENT_VERSIONS} SELECT * FROM versions")
def scd2_merged(spark: SparkSession, d: str) -> DataFrame:
    """Versions from three merged batches, with late events and re-sends, equal those of one build."""
    e = events(spark, d).select("user_id", "event_id", "ts", "_batch_id", "event_type", "v")
    step = F.least(F.col("_batch_id") + (F.col("event_id") % 20 == 0).cast("int"), F.lit(3))
    store = Store(spark, shared_folder(spark, "merge"))
    build = lambda rows: scd.scd2(rows, "user_id", "ts", ["event_id"], ["event_type"], ["v"], batch=["_batch_id"])
    for k in (1, 2, 3):
        again = e.where((step == k - 1) & (F.col("event_id") % 9 == 0))
        scd.merge_batch(store, e.where(step == k).unionByName(again), "user_id", build, n_buckets=8)
    return store.read("versions").select("user_id", "event_id", "event_type", "v", "valid_from_date", "valid_to_date", "is_current")


@query(f"WITH {EVENT_VERSIONS} SELECT e.event_id, e.user_id, coalesce(v.event_type, 'Unknown') AS state, v.valid_from_date FROM events e ASOF LEFT JOIN versions v ON e.user_id = v.user_id AND (e.ts::DATE - 1) >= v.valid_from_date")
def asof_merge(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the user's state on the day before, by a merge in place of a join."""
    v = queries.event_versions(spark, d).select("user_id", F.col("event_type").alias("state"), "valid_from_date", "valid_to_date")
    e = table(spark, d, "events").select("event_id", "user_id", F.date_sub(F.to_date("ts"), 1).alias("day"))
    return star.asof_merge(e, v, "user_id", "day", ["state", "valid_from_date"]).select("event_id", "user_id", F.coalesce("state", F.lit("Unknown")).alias("state"), "valid_from_date")


@query(f"WITH {HOT_VERSIONS} SELECT e.event_id, e.user_id, v.event_type AS state, v.valid_from_date FROM ev e ASOF LEFT JOIN versions v ON e.user_id = v.user_id AND (e.ts::DATE - 1) >= v.valid_from_date")
def asof_merge_hot(spark: SparkSession, d: str) -> DataFrame:
    """The same where one user holds half of all events: segments of time are merged in parallel."""
    hot = one_hot(events(spark, d))
    built = scd.scd2(
        hot.select("user_id", "event_id", "ts", "_batch_id", "event_type", "v"),
        "user_id",
        "ts",
        ["event_id"],
        ["event_type"],
        ["v"],
        batch=["_batch_id"],
        segment=incremental.segments(hot, "ts", 32),
    )
    v = built.select("user_id", F.col("event_type").alias("state"), "valid_from_date", "valid_to_date")
    e = hot.select("event_id", "user_id", F.date_sub(F.to_date("ts"), 1).alias("day"))
    return star.asof_merge(e, v, "user_id", "day", ["state", "valid_from_date"], segment=incremental.segments(e, "day", 32)).select("event_id", "user_id", "state", "valid_from_date")


@query(f"""WITH {ORDER_VERSIONS}, li AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 23 = 0 THEN NULL WHEN l_orderkey % 19 = 0 THEN -o_custkey ELSE o_custkey END AS custkey, l_shipdate::DATE - 400 AS day FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  f AS (SELECT o_custkey, min(valid_from_date) AS first_day FROM versions GROUP BY 1)
  SELECT l_orderkey, l_linenumber, coalesce(sk, '-1') AS version_sk, CASE WHEN sk IS NOT NULL THEN NULL WHEN custkey IS NULL THEN 'no key' WHEN first_day IS NULL THEN 'unknown key' WHEN day < first_day THEN 'before first version' ELSE 'between versions' END AS version_sk_miss_reason
  FROM li LEFT JOIN versions v ON v.o_custkey = custkey AND day BETWEEN valid_from_date AND valid_to_date LEFT JOIN f ON f.o_custkey = custkey""")
def fk_miss_reason(spark: SparkSession, d: str) -> DataFrame:
    """Foreign keys to versions, with the reason where none was met: a bad key and an event too early are told apart."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    custkey = F.when(F.col("l_orderkey") % 23 == 0, F.lit(None)).when(F.col("l_orderkey") % 19 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    li = table(spark, d, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "l_orderkey",
        "l_linenumber",
        custkey.alias("custkey"),
        F.date_sub(F.to_date("l_shipdate"), 400).alias("day"),
    )
    look = star.Lookup(queries.order_versions(spark, d), "sk", {"custkey": "o_custkey"}, "version_sk", day="day")
    return star.resolve(li, look, reasons=True).select("l_orderkey", "l_linenumber", "version_sk", "version_sk_miss_reason")


# ---------------------------------------------------------------- data tests


def line_tests() -> list[quality.RowTest]:
    return [
        quality.values_test("l_returnflag", ["A", "N"]),
        quality.range_test("l_quantity", 0.0, 45.0),
        quality.null_test("l_shipdate"),
        quality.true_test("discount_and_tax", F.col("l_discount") + F.col("l_tax") < 0.15),
    ]


@query("""SELECT 'run1' AS run_id, 'lineitem' AS model, test, severity, failures, CASE WHEN failures = 0 THEN 'pass' WHEN severity = 'error' THEN 'fail' ELSE 'warn' END AS status, failures || ' violating rows' AS message FROM (
  SELECT 'unique_key' AS test, 'error' AS severity, count(*) AS failures FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
  UNION ALL SELECT 'accepted_values_l_returnflag', 'warn', count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') UNION ALL SELECT 'range_l_quantity', 'warn', count(*) FROM lineitem WHERE l_quantity < 0 OR l_quantity > 45
  UNION ALL SELECT 'not_null_l_shipdate', 'error', count(*) FROM lineitem WHERE l_shipdate IS NULL UNION ALL SELECT 'discount_and_tax', 'error', count(*) FROM lineitem WHERE NOT (l_discount + l_tax < 0.15))""")
def dq_test_log(spark: SparkSession, d: str) -> DataFrame:
    """Row tests share one scan and one aggregate; a test of keys groups them."""
    li = table(spark, d, "lineitem")
    keyed = quality.test_results("run1", "lineitem", {"unique_key": (quality.duplicated(li, "l_orderkey", "l_linenumber"), "error")})
    return quality.row_test_results(li, "run1", "lineitem", line_tests()).unionByName(keyed)


@query("""SELECT 'accepted_values_l_returnflag' AS test, l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
  UNION ALL SELECT 'range_l_quantity', l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity < 0 OR l_quantity > 45
  UNION ALL SELECT 'discount_and_tax', l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE NOT (l_discount + l_tax < 0.15)""")
def dq_store_failures(spark: SparkSession, d: str) -> DataFrame:
    """The violating rows of several tests, kept by one tagged write and read back by test."""
    li, folder, tests = table(spark, d, "lineitem"), f"{shared_folder(spark, 'failures')}/lineitem", line_tests()
    quality.run_row_tests(li, "run1", "lineitem", tests, folder)
    out = None
    for t in tests:
        rows = quality.read_failures(spark, folder, t.name, li.schema).select(F.lit(t.name).alias("test"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
        out = rows if out is None else out.unionByName(rows)
    return out


# ---------------------------------------------------------------- governance


def personal_layers(spark: SparkSession, d: str) -> Store:
    """Three layers' tables, each written in ranges of its customers, so that a subject's rows lie in few files."""
    store = Store(spark, shared_folder(spark, "erasure"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    dim = star.dimension(table(spark, d, "customer"), "customer_sk", ["c_custkey"], ["c_custkey", "c_name", "c_acctbal"], {"c_custkey": -1, "c_name": "Unknown"})
    parts = {"bronze_customer": (table(spark, d, "customer"), "c_custkey"), "silver_orders": (o, "o_custkey"), "gold_customer": (dim, "c_custkey")}
    store.commit(*[store.stage(n, df.repartitionByRange(8, k).sortWithinPartitions(k), layer=n.split("_")[0]) for n, (df, k) in parts.items()])
    return store


LAYERS = [
    govern.Personal("bronze_customer", "c_custkey", ("c_name", "c_acctbal")),
    govern.Personal("silver_orders", "o_custkey", ("o_totalprice", "o_orderpriority")),
    govern.Personal("gold_customer", "c_custkey", ("c_name", "c_acctbal")),
]


@query("""SELECT 'bronze_customer' AS table_name, count(*) AS n, count(*) FILTER (c_custkey NOT BETWEEN 3 AND 5) AS named, count(*) FILTER (c_custkey BETWEEN 3 AND 5) AS logged FROM customer
  UNION ALL SELECT 'silver_orders', count(*), count(*) FILTER (o_custkey NOT BETWEEN 3 AND 5), count(*) FILTER (o_custkey BETWEEN 3 AND 5) FROM orders
  UNION ALL SELECT 'gold_customer', count(*) + 1, count(*) FILTER (c_custkey NOT BETWEEN 3 AND 5) + 1, count(*) FILTER (c_custkey BETWEEN 3 AND 5) FROM customer""")
def erase_in_place(spark: SparkSession, d: str) -> DataFrame:
    """Three subjects are erased from stored tables of three layers: files that hold them are written again, all others stay."""
    store = personal_layers(spark, d)
    subjects = table(spark, d, "customer").where("c_custkey between 3 and 5").select("c_custkey")
    govern.erase_in_place(store, subjects, "c_custkey", LAYERS, "request 1")
    log = store.read("erasure_log").groupBy("layer").agg(F.sum("rows_erased").alias("logged"))
    out = None
    for p in LAYERS:
        rows = store.read(p.table).agg(F.count("*").alias("n"), F.count(p.columns[0]).alias("named")).select(F.lit(p.table).alias("table_name"), "n", "named")
        out = rows if out is None else out.unionByName(rows)
    return out.join(log, F.col("table_name") == F.col("layer")).select("table_name", "n", "named", "logged")


@query(f"""WITH {ORDER_VERSIONS} SELECT n_name AS nation, v.o_orderstatus AS status, count(*) AS n, count(DISTINCT c.c_name) AS names, count(c.c_acctbal) AS balances FROM versions v JOIN (SELECT c_custkey, c_nationkey, '***MASKED***' AS c_name, NULL::DOUBLE AS c_acctbal FROM customer) c ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  WHERE DATE '1998-06-01' BETWEEN v.valid_from_date AND v.valid_to_date GROUP BY 1, 2""")
def analyst_surface(spark: SparkSession, d: str) -> DataFrame:
    """What an analyst sees: masked views of gold tables, as of a day where they have versions, joined by SQL."""
    customers = govern.classify(table(spark, d, "customer"), queries.CUSTOMER_LEVELS)
    versions = queries.order_versions(spark, d)
    classified = govern.classify(versions, dict.fromkeys(versions.columns, "internal"))
    govern.analyst_view(customers, "analyst", "analyst_customer")
    govern.analyst_view(classified, "analyst", "analyst_status", F.lit("1998-06-01").cast("date"), "o_custkey")
    table(spark, d, "nation").createOrReplaceTempView("analyst_nation")
    return spark.sql("""SELECT n_name AS nation, o_orderstatus AS status, count(*) AS n, count(DISTINCT c_name) AS names, count(c_acctbal) AS balances
      FROM analyst_status JOIN analyst_customer ON c_custkey = o_custkey JOIN analyst_nation ON n_nationkey = c_nationkey GROUP BY 1, 2""")


# ---------------------------------------------------------------- files


def written_lines(spark: SparkSession, d: str) -> str:
    """Orders as delimited text in folders of three batches, with an audit file of each batch beside them."""
    root = shared_folder(spark, "files")
    lines = queries.order_lines(spark, d, True).select("value", (F.col("_source_file").substr(5, 1).cast("int") + 1).alias("batch"))
    lines.write.partitionBy("batch").text(f"{root}/Orders")
    counts = lines.groupBy("batch").agg(F.count("*").alias("value"))
    audit = counts.select(
        "batch",
        F.lit("Orders").alias("DataSet "),
        F.col("batch").alias(" BatchID"),
        F.lit("2017-7-8").alias("Date "),
        F.lit("O_RECORDS").alias(" Attribute"),
        F.col("value").alias("Value"),
        (F.col("value") / 2).cast("decimal(20,5)").alias(" DValue"),
    )
    audit.write.partitionBy("batch").option("header", True).csv(f"{root}/Audit")
    return root


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(12,2))::DOUBLE AS o_totalprice, o_orderdate::DATE AS o_orderdate, CASE WHEN o_orderkey % 2 = 1 THEN 'U' ELSE 'I' END AS _cdc_flag,
  'batch=' || (o_custkey % 3 + 1) AS folder, true AS named FROM orders""")
def read_globbed(spark: SparkSession, d: str) -> DataFrame:
    """Many files by one glob, both line shapes in each, with the file that every row came from."""
    root = written_lines(spark, d)
    lines = spark.read.text(f"{root}/Orders/batch=*/*.txt").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("_source_file"))
    rows = delimited.parse_lines(lines, queries.ORDER_SPEC, keep=["path", "_source_file"])
    folder = F.regexp_extract("path", r"/(batch=\d+)/[^/]*$", 1)
    return rows.select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        F.col("o_totalprice").cast("double").alias("o_totalprice"),
        "o_orderdate",
        "_cdc_flag",
        folder.alias("folder"),
        F.col("_source_file").rlike(r"^part-.*\.txt$").alias("named"),
    )


@query("""WITH s AS (SELECT o_custkey % 3 + 1 AS b, count(*) AS n FROM orders GROUP BY 1)
  SELECT b::INT AS batchid, DATE '2017-07-08' AS date, n AS expected, (n / 2.0)::DOUBLE AS dvalue, n AS actual, 'PASS' AS status FROM s""")
def read_audit_files(spark: SparkSession, d: str) -> DataFrame:
    """Audit files with untidy headers, held against the rows that their batch's files have."""
    root = written_lines(spark, d)
    audit = control.read_audit(spark, f"{root}/Audit/batch=*/*.csv")
    lines = spark.read.text(f"{root}/Orders/batch=*/*.txt").select(F.regexp_extract("_metadata.file_path", r"/batch=(\d+)/[^/]*$", 1).alias("dataset"))
    loaded_rows = lines.groupBy("dataset").agg(F.count("*").alias("actual"))
    stated = reconcile.audit_counts(audit.withColumn("dataset", F.col("batchid").cast("string")))
    judged = reconcile.against_audit(stated, loaded_rows).select(F.col("dataset").cast("int").alias("batchid"), "expected", "actual", "status")
    return audit.select("batchid", "date", F.col("dvalue").cast("double").alias("dvalue")).join(judged, "batchid")


@query("""SELECT o_orderkey::VARCHAR AS c_tax_id, o_custkey AS c_id, o_orderdate AS actionts, o_orderpriority AS c_l_name, coalesce(n, 0) AS n_accounts, coalesce(p, 0) AS accounts_sum
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_partkey)::BIGINT AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def read_xml_files(spark: SparkSession, d: str) -> DataFrame:
    """Nested actions from XML files: each file is one document of up to 5000 actions, split at them, with customers and their accounts."""
    root = shared_folder(spark, "xml")
    actions = queries.order_actions(spark, d)
    inner = actions.groupBy(F.floor(F.col("o_orderkey") / 5000)).agg(F.concat_ws("\n", F.collect_list("value")).alias("inner"))
    whole = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<TPCDI:Actions xmlns:TPCDI="http://www.tpc.org/tpc-di">\n'), "inner", F.lit("\n</TPCDI:Actions>"))
    inner.select(whole.alias("value")).write.option("maxRecordsPerFile", 1).text(f"{root}/actions")
    read = xml.read_actions(spark, f"{root}/actions/*.txt")
    sums = F.aggregate("Customer.Account", F.lit(0).cast("bigint"), lambda s, a: s + a["_CA_ID"])
    counted = read.withColumns(
        {
            "n_accounts": F.greatest(F.coalesce(F.size("Customer.Account"), F.lit(0)), F.lit(0)).cast("bigint"),
            "accounts_sum": F.coalesce(sums, F.lit(0).cast("bigint")),
        }
    )
    return xml.customers(counted, ["n_accounts", "accounts_sum"]).select("c_tax_id", "c_id", "actionts", "c_l_name", "n_accounts", "accounts_sum")


def rendered(spec: delimited.DelimitedSpec, changed: bool) -> Callable[[DataFrame], Column]:
    """A line of a source file from typed columns; changes carry their flag and number in front."""
    kinds = {"timestamp_ntz": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"), "boolean": lambda c: F.when(F.col(c), "1").otherwise("0")}
    front = [F.col("_cdc_flag"), F.col("_cdc_dsn").cast("string")] if changed else []
    return lambda df: F.concat_ws(spec.delimiter, *front, *[F.coalesce(kinds.get(dict(df.dtypes)[c], lambda x: F.col(x).cast("string"))(c), F.lit("")) for c in spec.names])


def batch_folders(spark: SparkSession, d: str) -> str:
    """Three batches of source files from the given tables: trades in all, other sources in the first; one audit file is off by one."""
    bronze, root = warehouse.derived_bronze(spark, d), shared_folder(spark, "batches")
    batch = F.least(F.col("_batch_id"), F.lit(3))
    for b in (1, 2, 3):
        folder = f"{root}/Batch{b}"
        spark.range(1).select(F.lit(f"2017-07-{6 + b:02d}").alias("value")).write.text(f"{folder}/BatchDate.txt")
        for name in ("trade",) if b > 1 else ("trade", "cash_transaction", "status_type", "hr"):
            rows, spec = bronze[name].where(batch == b), specs.DELIMITED[name]
            lines = rows.select(rendered(spec, b > 1)(rows).alias("value"))
            lines.write.text(f"{folder}/{ingest.FILES[name]}")
        stated = bronze["trade"].where(batch == b).agg((F.count("*") + int(b == 2)).alias("Value"))
        audit = [F.lit("Trade").alias("DataSet "), F.lit(b).alias("BatchID"), F.lit(None).cast("string").alias(" Date"), F.lit("T_RECORDS").alias("Attribute "), "Value", F.lit(None).cast("string").alias("DValue")]
        stated.select(*audit).write.option("header", True).csv(f"{folder}/Trade_audit.csv")
    return root


@query("""WITH t AS (SELECT 1 AS b FROM orders UNION ALL SELECT least(l_linenumber + 1, 3) FROM lineitem JOIN orders ON o_orderkey = l_orderkey), n AS (SELECT b::INT AS batch, count(*) AS n FROM t GROUP BY 1)
  SELECT 'table' AS kind, 'trade' AS name, batch, n, 'stored' AS status FROM n
  UNION ALL SELECT 'table', 'cash_transaction', 1, count(*), 'stored' FROM events
  UNION ALL SELECT 'table', 'status_type', 1, count(DISTINCT o_orderstatus), 'stored' FROM orders
  UNION ALL SELECT 'table', 'hr', 1, count(*), 'stored' FROM supplier
  UNION ALL SELECT 'log', 'r' || batch, batch, n, CASE WHEN batch = 2 THEN 'WARNING' ELSE 'PASS' END FROM n UNION ALL SELECT 'log', 'forced', 2, n, 'WARNING' FROM n WHERE batch = 2""")
def ingest_batches(spark: SparkSession, d: str) -> DataFrame:
    """Three batches of files go into stored bronze tables; the second is loaded again by force and replaces itself."""
    root = batch_folders(spark, d)
    store, at = Store(spark, shared_folder(spark, "bronze")), F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    for b in (1, 2, 3):
        ingest.load_batch(store, root, b, at, f"r{b}")
    ingest.load_batch(store, root, 2, at, "forced", force=True)
    log = store.read(ingest.LOG).select(F.lit("log").alias("kind"), F.col("run_id").alias("name"), "batch", F.col("actual").alias("n"), "status")
    for name in ("trade", "cash_transaction", "status_type", "hr"):
        held = store.read(name).groupBy(F.col("_batch_id").alias("batch")).agg(F.count("*").alias("n"))
        log = log.unionByName(held.select(F.lit("table").alias("kind"), F.lit(name).alias("name"), "batch", "n", F.lit("stored").alias("status")))
    return log
