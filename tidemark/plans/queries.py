"""Queries over the given tables, each with SQL that gives the same rows.

The tables stand in for a warehouse's sources: events are a change log with sparse values and three batches,
orders are versions of a customer, lineitem is a fact with repeated keys, and text forms of the tables are
rendered and parsed back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import casting, keys
from tidemark.functions.casting import Cast
from tidemark.operators import govern, quality, reconcile, scd, star, windows
from tidemark.operators.windows import down, up
from tidemark.session import table
from tidemark.sources import control, delimited, fixed_width, sinks, xml

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


def money(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(15,2)")


def total(c: Column, name: str) -> Column:
    """Exact sums: decimals do not depend on the order of rows."""
    return F.sum(c).cast("double").alias(name)


def batch_of() -> Column:
    """The batch an event belongs to, by its day."""
    return F.expr("CASE WHEN ts < TIMESTAMP_NTZ '2024-01-11' THEN 1 WHEN ts < TIMESTAMP_NTZ '2024-01-21' THEN 2 ELSE 3 END")


EV = """ev AS (SELECT event_id, ts, user_id, event_type, value, props,
  CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 1 WHEN ts < TIMESTAMP '2024-01-21' THEN 2 ELSE 3 END AS _batch_id,
  CASE WHEN event_type IN ('purchase', 'error') THEN value END AS v FROM events)"""


def events(spark: SparkSession, d: str) -> DataFrame:
    sparse = F.when(F.col("event_type").isin("purchase", "error"), F.col("value"))
    return table(spark, d, "events").withColumns({"_batch_id": batch_of(), "v": sparse})


# ---------------------------------------------------------------- sources

ORDER_SPEC = delimited.DelimitedSpec(
    (
        Cast("o_orderkey", casting.as_long),
        Cast("o_custkey", casting.as_long),
        Cast("o_orderstatus"),
        Cast("o_totalprice", casting.as_decimal(12, 2)),
        Cast("o_orderdate", casting.as_date),
    ),
    changes=True,
)


def order_lines(spark: SparkSession, d: str, shifted: bool) -> DataFrame:
    """Orders as delimited lines; with ``shifted`` those with odd keys carry the change prefix."""
    o = table(spark, d, "orders")
    body = F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus", money("o_totalprice").cast("string"), F.to_date("o_orderdate").cast("string"))
    odd = F.concat_ws("|", F.lit("U"), "o_orderkey", body) if shifted else body
    return o.select(F.when(F.col("o_orderkey") % 2 == 1, odd).otherwise(body).alias("value"), F.concat(F.lit("part"), (F.col("o_custkey") % 3).cast("string")).alias("_source_file"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(12,2))::DOUBLE AS o_totalprice, o_orderdate::DATE AS o_orderdate, 0 AS errors FROM orders")
def parse_delimited(spark: SparkSession, d: str) -> DataFrame:
    spec = delimited.DelimitedSpec(ORDER_SPEC.columns)
    rows = delimited.parse_lines(order_lines(spark, d, False), spec)
    return rows.withColumns({"o_totalprice": F.col("o_totalprice").cast("double"), "errors": casting.error_count(F.col("_dq_errors"))}).drop("_dq_errors")


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(12,2))::DOUBLE AS o_totalprice, o_orderdate::DATE AS o_orderdate,
  CASE WHEN o_orderkey % 2 = 1 THEN 'U' ELSE 'I' END AS _cdc_flag, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey ELSE 0 END AS _cdc_dsn FROM orders""")
def parse_cdc_shift(spark: SparkSession, d: str) -> DataFrame:
    return delimited.parse_lines(order_lines(spark, d, True), ORDER_SPEC).withColumn("o_totalprice", F.col("o_totalprice").cast("double")).drop("_dq_errors")


@query("""SELECT 'part' || (o_custkey % 3) AS _source_file, CASE WHEN o_orderkey % 2 = 1 THEN 7 ELSE 5 END AS n_fields, count(*) AS n_lines,
  CASE WHEN o_orderkey % 2 = 1 THEN 'shifted' ELSE 'base' END AS shape FROM orders GROUP BY ALL""")
def field_count_profile(spark: SparkSession, d: str) -> DataFrame:
    return delimited.field_count_profile(order_lines(spark, d, True), 5)


PART_RECORD = fixed_width.RecordSpec("PRT", ((Cast("name"), 30), (Cast("brand"), 10), (Cast("size", casting.as_int), 4), (Cast("made", casting.as_compact_date, casting.ZEROS), 8)), "maker")
SUPPLIER_RECORD = fixed_width.RecordSpec("SUP", ((Cast("name"), 30), (Cast("nation", casting.as_int), 6)))


def wire_lines(spark: SparkSession, d: str) -> DataFrame:
    """Parts and suppliers as fixed-width records of one file; a part's maker is a number or a name."""
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    day = F.when(F.col("p_partkey") % 5 == 0, "00000000").otherwise(F.concat(F.lit("2001"), F.lpad((F.col("p_partkey") % 12 + 1).cast("string"), 2, "0"), F.lit("15")))
    maker = F.when(F.col("p_partkey") % 2 == 0, F.lpad(F.col("p_size").cast("string"), 10, "0")).otherwise(F.concat(F.lit("Maker "), F.col("p_size").cast("string")))
    parts = p.select(F.concat(F.lit("20010203-040506PRT"), F.rpad("p_name", 30, " "), F.rpad("p_brand", 10, " "), F.lpad(F.col("p_size").cast("string"), 4, " "), day, maker).alias("value"))
    return parts.unionByName(s.select(F.concat(F.lit("20010203-040507SUP"), F.rpad("s_name", 30, " "), F.rpad(F.col("s_nationkey").cast("string"), 6, " ")).alias("value")))


@query("""SELECT TIMESTAMP '2001-02-03 04:05:06' AS pts, p_name AS name, p_brand AS brand, p_size AS size,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE make_date(2001, (p_partkey % 12 + 1)::INT, 15) END AS made,
  CASE WHEN p_partkey % 2 = 0 THEN lpad(p_size::VARCHAR, 10, '0') ELSE 'Maker ' || p_size END AS maker, 0 AS errors FROM part""")
def parse_fixed_width(spark: SparkSession, d: str) -> DataFrame:
    lines = fixed_width.checked(wire_lines(spark, d), [PART_RECORD, SUPPLIER_RECORD])
    return fixed_width.parse_records(lines, PART_RECORD).withColumn("errors", casting.error_count(F.col("_dq_errors"))).drop("_dq_errors")


@query("""SELECT p_name AS name, p_brand AS brand, p_size AS size, CASE WHEN p_partkey % 2 = 0 THEN lpad(p_size::VARCHAR, 10, '0') END AS maker_id,
  CASE WHEN p_partkey % 2 = 1 THEN 'Maker ' || p_size END AS maker_name FROM part""")
def resolve_polymorphic_key(spark: SparkSession, d: str) -> DataFrame:
    rows = fixed_width.parse_records(wire_lines(spark, d), PART_RECORD)
    return fixed_width.split_reference(rows, "maker", "maker_id", "maker_name").select("name", "brand", "size", "maker_id", "maker_name")


def order_actions(spark: SparkSession, d: str) -> DataFrame:
    """An XML action per order: the customer with its order's lines as nested accounts.

    Parsing costs far more than the size of the rows tells, so orders are dealt out by key, in a number of partitions
    that is not lowered for their size; where the join shuffles, it does so by this key anyway.
    """
    o, li = table(spark, d, "orders").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey"), table(spark, d, "lineitem")
    account = F.concat(
        F.lit('<Account CA_ID="'),
        "l_partkey",
        F.lit('" CA_TAX_ST="'),
        "l_linenumber",
        F.lit('"><CA_B_ID>'),
        "l_suppkey",
        F.lit("</CA_B_ID><CA_NAME>"),
        "l_returnflag",
        F.lit("</CA_NAME></Account>"),
    )
    inner = li.groupBy("l_orderkey").agg(F.concat_ws("", F.collect_list(account)).alias("accounts"))
    text = F.concat(
        F.lit('<TPCDI:Action ActionType="NEW" ActionTS="'),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit('"><Customer C_ID="'),
        "o_custkey",
        F.lit('" C_TAX_ID="'),
        "o_orderkey",
        F.lit('"><Name><C_L_NAME>'),
        "o_orderpriority",
        F.lit("</C_L_NAME></Name><ContactInfo><C_PHONE_1><C_LOCAL>"),
        "o_orderkey",
        F.lit("</C_LOCAL></C_PHONE_1></ContactInfo>"),
        F.coalesce("accounts", F.lit("")),
        F.lit("</Customer></TPCDI:Action>"),
    )
    return o.join(inner, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", text.alias("value"))


@query(
    "SELECT o_orderkey, 'NEW' AS actiontype, o_orderdate AS actionts, o_custkey AS c_id, o_orderkey::VARCHAR AS c_tax_id, o_orderpriority AS c_l_name, o_orderkey::VARCHAR AS c_local_1, NULL::VARCHAR AS c_local_2 FROM orders"
)
def parse_xml_parent(spark: SparkSession, d: str) -> DataFrame:
    rows = xml.customers(xml.parse_actions(order_actions(spark, d), "value", ["o_orderkey"]), ["o_orderkey"])
    return rows.select("o_orderkey", "actiontype", "actionts", "c_id", "c_tax_id", "c_l_name", "c_local_1", "c_local_2")


@query(
    "SELECT o_orderkey, 'NEW' AS actiontype, o_orderdate AS actionts, o_custkey AS ca_c_id, l_partkey AS ca_id, l_linenumber AS ca_tax_st, l_suppkey AS ca_b_id, l_returnflag AS ca_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey"
)
def parse_xml_children(spark: SparkSession, d: str) -> DataFrame:
    return xml.accounts(xml.parse_actions(order_actions(spark, d), "value", ["o_orderkey"]), ["o_orderkey"])


@query("SELECT _batch_id, (DATE '2017-07-06' + _batch_id::INT) AS asofdate FROM (WITH " + EV + " SELECT DISTINCT _batch_id FROM ev)")
def batch_calendar(spark: SparkSession, d: str) -> DataFrame:
    texts = events(spark, d).select("_batch_id").distinct().withColumn("value", F.concat(F.lit(" 2017-7-"), (F.col("_batch_id") + 6).cast("string"), F.lit("\n")))
    return control.batch_calendar(texts)


# ---------------------------------------------------------------- casts and keys


@query(
    """SELECT l_linenumber, count(*) AS n_rows, count_if(l_orderkey % 7 <> 0 AND l_orderkey % 11 <> 0) AS n_values, count_if(l_orderkey % 7 = 0 AND l_orderkey % 11 <> 0) AS n_errors FROM lineitem GROUP BY 1"""
)
def safe_cast_errors(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("l_orderkey") % 11 == 0, "  ").when(
        F.col("l_orderkey") % 7 == 0,
        F.concat(F.col("l_quantity").cast("string"), F.lit("x")),
    ).otherwise(F.col("l_quantity").cast("string"))
    rows = casting.cast_all(table(spark, d, "lineitem").select("l_linenumber", raw.alias("quantity")), [Cast("quantity", casting.as_double)], ["l_linenumber"])
    return rows.groupBy("l_linenumber").agg(F.count("*").alias("n_rows"), F.count("quantity").alias("n_values"), F.sum(casting.error_count(F.col("_dq_errors"))).alias("n_errors"))


@query("""SELECT event_id, date_trunc('second', ts) AS plain, date_trunc('second', ts) AS iso, date_trunc('second', ts) AS compact, ts::DATE AS day,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts::DATE END AS compact_day, event_id % 3 = 0 AS flag, date_trunc('milliseconds', ts) AS millis, value::DECIMAL(12,2)::DOUBLE AS amount FROM events""")
def cast_formats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    text = e.select(
        "event_id",
        "ts",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("plain"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
        F.date_format("ts", "yyyyMMdd-HHmmss").alias("compact"),
        F.date_format("ts", "y-M-d").alias("day"),
        F.when(F.col("event_id") % 4 == 0, "00000000").otherwise(F.date_format("ts", "yyyyMMdd")).alias("compact_day"),
        F.when(F.col("event_id") % 3 == 0, "Y").otherwise("no").alias("flag"),
        F.col("value").cast("decimal(12,2)").cast("string").alias("amount"),
    )
    return text.select(
        "event_id", casting.as_timestamp()(F.col("plain")).alias("plain"), casting.ISO_TIMESTAMP(F.col("iso")).alias("iso"), casting.COMPACT_TIMESTAMP(F.col("compact")).alias("compact"),
        casting.as_date(F.col("day")).alias("day"), casting.as_compact_date(F.col("compact_day")).alias("compact_day"), casting.as_bool(F.col("flag")).alias("flag"),
        casting.to_millis(F.col("ts")).cast("timestamp_ntz").alias("millis"), casting.as_decimal(12, 2)(F.col("amount")).cast("double").alias("amount"),
    )


@query("""WITH t AS (SELECT o_orderkey, concat_ws('|', o_custkey, o_orderstatus, o_orderdate::DATE, CASE WHEN o_orderkey % 3 = 0 THEN '~null~' ELSE o_orderpriority END) AS x FROM orders)
  SELECT o_orderkey, md5(x) AS row_hash, ('0x' || substr(sha256(x), 1, 16))::UBIGINT::VARCHAR AS row_hash64 FROM t""")
def row_hash(spark: SparkSession, d: str) -> DataFrame:
    business = ["o_custkey", "o_orderstatus", F.to_date("o_orderdate"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))]
    return table(spark, d, "orders").select("o_orderkey", keys.row_hash(business).alias("row_hash"), keys.row_hash64(business).cast("string").alias("row_hash64"))


@query("SELECT l_orderkey, l_linenumber, md5(concat_ws('-', l_orderkey, l_linenumber)) AS sk, strftime(l_shipdate, '%Y%m%d')::INT AS date_key FROM lineitem")
def surrogate_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        keys.surrogate_key("l_orderkey", "l_linenumber").alias("sk"),
        keys.smart_date_key(F.col("l_shipdate")).alias("date_key"),
    )


@query("SELECT p_partkey, upper(p_name) AS name, NULL::VARCHAR AS blank, p_type AS type FROM part")
def trim_or_null(spark: SparkSession, d: str) -> DataFrame:
    padded = table(spark, d, "part").select(
        "p_partkey",
        F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("name"),
        F.lit("   ").alias("blank"),
        F.concat("p_type", F.lit("  ")).alias("type"),
    )
    return padded.select(
        "p_partkey",
        casting.trim_or_null(F.col("name"), upper=True).alias("name"),
        casting.trim_or_null(F.col("blank")).alias("blank"),
        casting.trim_or_null(F.col("type")).alias("type"),
    )


@query("WITH " + EV + " SELECT event_id, _batch_id, 'events_' || _batch_id || '.txt' AS _source_file, md5(concat_ws('|', user_id, event_type, props)) AS _row_hash FROM ev")
def envelope(spark: SparkSession, d: str) -> DataFrame:
    e = keys.with_envelope(
        events(spark, d),
        F.col("_batch_id"),
        ["user_id", "event_type", "props"],
        F.concat(F.lit("events_"), F.col("_batch_id").cast("string"), F.lit(".txt")),
        F.current_timestamp(),
    )
    return e.select("event_id", "_batch_id", "_source_file", "_row_hash")


@query("""SELECT event_id, json_extract(props, '$.k')::INT AS k, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS second_of_day, 'user ' || user_id || ': ' || event_type AS message,
  event_type LIKE 'p_r%' AS looks_like, replace(event_type || '_audit.csv', '_audit.csv', '') AS stem, CASE event_type WHEN 'signup' THEN 'ACTV' WHEN 'error' THEN 'INAC' END AS status FROM events""")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), keys.second_of_text(F.date_format("ts", "HH:mm:ss")).alias("second_of_day"),
        F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(": "), F.col("event_type")).alias("message"), F.col("event_type").like("p_r%").alias("looks_like"),
        F.regexp_replace(F.concat("event_type", F.lit("_audit.csv")), r"_audit\.csv$", "").alias("stem"),
        F.when(F.col("event_type") == "signup", "ACTV").when(F.col("event_type") == "error", "INAC").alias("status"),
    )


# ---------------------------------------------------------------- windows

LATEST = "l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC"


def deduped_lines(spark: SparkSession, d: str) -> DataFrame:
    return windows.dedup_latest(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [down(c.split()[0]) for c in LATEST.split(", ")])


@query(f"SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LATEST}) = 1")
def dedup_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return deduped_lines(spark, d)


@query("SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def dedup_latest_order(spark: SparkSession, d: str) -> DataFrame:
    return windows.dedup_latest(table(spark, d, "orders"), ["o_custkey"], [down("o_orderdate"), down("o_orderkey")])


@query("WITH " + EV + " SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM ev")
def forward_fill_events(spark: SparkSession, d: str) -> DataFrame:
    return windows.forward_fill(events(spark, d), ["user_id"], [up("ts"), up("event_id")], ["v"]).select("event_id", "v")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type")
def change_filter(spark: SparkSession, d: str) -> DataFrame:
    return windows.changed_only(table(spark, d, "events"), ["user_id"], [up("ts"), up("event_id")], ["event_type"]).select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) = 1")
def day_collapse(spark: SparkSession, d: str) -> DataFrame:
    return windows.day_collapse(table(spark, d, "events"), ["user_id"], "ts", [down("ts"), down("event_id")]).select("event_id", "user_id", "ts")


@query("""SELECT o_orderkey, o_custkey, o_orderdate::DATE AS valid_from_date, coalesce(lead(o_orderdate::DATE) OVER w - 1, DATE '9999-12-31') AS valid_to_date,
  lead(o_orderkey) OVER w IS NULL AS is_current FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def close_intervals(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("valid_from_date"))
    return windows.close_intervals(o, ["o_custkey"], [up("valid_from_date"), up("o_orderkey")])


# ---------------------------------------------------------------- models

ORDER_VERSIONS = """last_of_day AS (
  SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate::DATE ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
), changed AS (
  SELECT * FROM last_of_day QUALIFY lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS DISTINCT FROM o_orderstatus
), versions AS (
  SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate::DATE AS valid_from_date,
    coalesce(lead(o_orderdate::DATE) OVER w - 1, DATE '9999-12-31') AS valid_to_date, lead(o_orderkey) OVER w IS NULL AS is_current,
    md5(concat_ws('-', o_custkey, o_orderdate::DATE, o_orderkey)) AS sk
  FROM changed WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
)"""
VERSION_COLUMNS = ["o_custkey", "o_orderkey", "o_orderstatus", "valid_from_date", "valid_to_date", "is_current", "sk"]


def order_versions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    return scd.scd2(o, "o_custkey", "o_orderdate", ["o_orderkey"], ["o_orderstatus"], ["o_orderpriority"]).select(*VERSION_COLUMNS)


@query(f"WITH {ORDER_VERSIONS} SELECT * FROM versions")
def scd2_orders(spark: SparkSession, d: str) -> DataFrame:
    return order_versions(spark, d)


def event_versions(spark: SparkSession, d: str) -> DataFrame:
    twice = events(spark, d).select("user_id", "event_id", "ts", "_batch_id", "event_type", "v")
    sent_again = twice.where("event_id % 10 = 0")  # exact re-sends, which the builder must drop
    return scd.scd2(twice.unionByName(sent_again), "user_id", "ts", ["event_id"], ["event_type"], ["v"], batch=["_batch_id"])


EVENT_VERSIONS = (
    EV
    + """, filled AS (
  SELECT * REPLACE (last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v) FROM ev
), last_of_day AS (
  SELECT * FROM filled QUALIFY row_number() OVER (PARTITION BY user_id, _batch_id, ts::DATE ORDER BY ts DESC, event_id DESC) = 1
), changed AS (
  SELECT * FROM last_of_day QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type
), versions AS (
  SELECT user_id, event_id, event_type, v, ts::DATE AS valid_from_date, coalesce(lead(ts::DATE) OVER w - 1, DATE '9999-12-31') AS valid_to_date, lead(event_id) OVER w IS NULL AS is_current
  FROM changed WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
)"""
)


@query(f"WITH {EVENT_VERSIONS} SELECT * FROM versions")
def scd2_events(spark: SparkSession, d: str) -> DataFrame:
    return event_versions(spark, d).select("user_id", "event_id", "event_type", "v", "valid_from_date", "valid_to_date", "is_current")


@query("WITH " + EV + " SELECT user_id, _batch_id, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY _batch_id DESC, event_id) = 1")
def scd1_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return scd.scd1(events(spark, d), ["user_id"], [down("_batch_id"), up("event_id")]).select("user_id", "_batch_id", "event_id")


@query(
    "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_totalprice::DECIMAL(15,2)) AS DOUBLE) AS total FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) GROUP BY 1"
)
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    """Additive measures on the latest state alone, so no amount counts once for each version."""
    now = scd.latest_state(table(spark, d, "orders"), ["o_custkey"], [down("o_orderdate"), down("o_orderkey")])
    return now.groupBy("o_orderstatus").agg(F.count("*").alias("n"), total(money("o_totalprice"), "total"))


@query("SELECT event_id, user_id, event_type FROM events")
def append_log_dedup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return scd.event_log(e.unionByName(e.where("user_id % 3 = 0")), e.columns).select("event_id", "user_id", "event_type")


@query(
    "WITH " + EV + """, moved AS (SELECT * FROM ev WHERE _batch_id <> 1 QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type)
  SELECT event_id, user_id, event_type, 'history' AS origin FROM ev WHERE _batch_id = 1 UNION ALL SELECT event_id, user_id, event_type, 'state' FROM moved"""
)
def status_transitions(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    rows = scd.status_transitions(e.where("_batch_id = 1"), e.where("_batch_id <> 1"), ["user_id"], [up("ts"), up("event_id")], "event_type")
    return rows.select("event_id", "user_id", "event_type", "origin")


@query("SELECT p_brand, p_partkey, p_name, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey DESC) = 1")
def latest_version_dim(spark: SparkSession, d: str) -> DataFrame:
    return windows.dedup_latest(table(spark, d, "part"), ["p_brand"], [down("p_size"), down("p_partkey")]).select("p_brand", "p_partkey", "p_name", "p_size")


@query("SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")
def reference_tables(spark: SparkSession, d: str) -> DataFrame:
    n = windows.dedup_latest(table(spark, d, "nation").where("n_nationkey is not null"), ["n_nationkey"], [up("n_name")])
    return n.join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left").select("n_nationkey", "n_name", "r_name")


PART_DIM = """dim_part AS (SELECT md5(p_partkey::VARCHAR) AS part_sk, p_partkey, p_name, p_brand FROM part UNION ALL SELECT '-1', -1, 'Unknown', 'Unknown')"""


def part_dim(spark: SparkSession, d: str) -> DataFrame:
    return star.dimension(table(spark, d, "part"), "part_sk", ["p_partkey"], ["p_partkey", "p_name", "p_brand"], {"p_partkey": -1, "p_name": "Unknown", "p_brand": "Unknown"})


@query(f"WITH {PART_DIM} SELECT * FROM dim_part")
def dimension_unknown(spark: SparkSession, d: str) -> DataFrame:
    return part_dim(spark, d)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 17 = 0 THEN '-1' ELSE md5(l_partkey::VARCHAR) END AS part_sk, md5(l_suppkey::VARCHAR) AS supplier_sk, strftime(l_shipdate, '%Y%m%d')::INT AS date_key,
  CAST(l_extendedprice::DECIMAL(15,2) AS DOUBLE) AS amount FROM lineitem""")
def fact_resolve_fks(spark: SparkSession, d: str) -> DataFrame:
    suppliers = star.dimension(table(spark, d, "supplier"), "supplier_sk", ["s_suppkey"], ["s_suppkey"], {"s_suppkey": -1})
    known = part_dim(spark, d).where("p_partkey % 17 <> 0")
    fact = star.resolve(
        table(spark, d, "lineitem"),
        star.Lookup(known, "part_sk", {"l_partkey": "p_partkey"}, "part_sk"),
        star.Lookup(suppliers, "supplier_sk", {"l_suppkey": "s_suppkey"}, "supplier_sk"),
    )
    return fact.select(
        "l_orderkey",
        "l_linenumber",
        "part_sk",
        "supplier_sk",
        keys.smart_date_key(F.col("l_shipdate")).alias("date_key"),
        money("l_extendedprice").cast("double").alias("amount"),
    )


@query(
    "SELECT l_orderkey, l_linenumber, o_custkey, strftime(o_orderdate, '%Y%m%d')::INT AS order_date_key, strftime(l_shipdate, '%Y%m%d')::INT AS ship_date_key FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 5 <> 0"
)
def derived_fk_fact(spark: SparkSession, d: str) -> DataFrame:
    """Keys taken from another fact; lines whose order is missing drop out."""
    o = table(spark, d, "orders").where("o_orderkey % 5 <> 0").select("o_orderkey", "o_custkey", keys.smart_date_key(F.col("o_orderdate")).alias("order_date_key"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", keys.smart_date_key(F.col("l_shipdate")).alias("ship_date_key"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


@query(f"WITH {ORDER_VERSIONS} SELECT * FROM versions WHERE DATE '1998-06-01' BETWEEN valid_from_date AND valid_to_date")
def point_in_time(spark: SparkSession, d: str) -> DataFrame:
    return scd.as_of(order_versions(spark, d), F.lit("1998-06-01").cast("date"), "o_custkey")


@query("""SELECT r_name, p_brand, year(o_orderdate) AS year, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue, count(*) AS n
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def star_revenue(spark: SparkSession, d: str) -> DataFrame:
    t = {n: table(spark, d, n) for n in ("lineitem", "orders", "customer", "nation", "region", "part")}
    joined = star.star(
        t["lineitem"],
        (t["part"], "l_partkey", "p_partkey"),
        (t["orders"], "l_orderkey", "o_orderkey"),
        (t["customer"], "o_custkey", "c_custkey"),
        (t["nation"], "c_nationkey", "n_nationkey"),
        (t["region"], "n_regionkey", "r_regionkey"),
    )
    return joined.groupBy("r_name", "p_brand", F.year("o_orderdate").alias("year")).agg(
        total(money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)")), "revenue"),
        F.count("*").alias("n"),
    )


@query(f"""WITH {ORDER_VERSIONS}, sales AS (SELECT o_custkey, l_shipdate::DATE AS day, CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS amount FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
  SELECT coalesce(v.o_orderstatus, 'Unknown') AS status, CAST(sum(amount) AS DOUBLE) AS revenue, count(*) AS n FROM sales s ASOF LEFT JOIN versions v ON s.o_custkey = v.o_custkey AND s.day >= v.valid_from_date GROUP BY 1""")
def scd2_asof_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: revenue by the status that the customer had on the day of shipment."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("day"), (money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("amount"))
    sales = li.join(
        table(spark, d, "orders").select("o_orderkey", "o_custkey"),
        F.col("l_orderkey") == F.col("o_orderkey"),
    ).groupBy("o_custkey", "day").agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))
    joined = star.interval_join(sales, order_versions(spark, d).select("o_custkey", "o_orderstatus", "valid_from_date", "valid_to_date"), "o_custkey", F.col("day"))
    return joined.groupBy(F.coalesce("o_orderstatus", F.lit("Unknown")).alias("status")).agg(total(F.col("amount"), "revenue"), F.sum("n").alias("n"))


# ---------------------------------------------------------------- joins


@query(
    "SELECT cn.n_name AS customer_nation, sn.n_name AS supplier_nation, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN nation sn ON sn.n_nationkey = s_nationkey GROUP BY 1, 2"
)
def role_playing(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    customers = table(spark, d, "customer").join(n.toDF("ck", "customer_nation"), F.col("ck") == F.col("c_nationkey")).select("c_custkey", "customer_nation")
    suppliers = table(spark, d, "supplier").join(n.toDF("sk", "supplier_nation"), F.col("sk") == F.col("s_nationkey")).select("s_suppkey", "supplier_nation")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    rows = li.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(
        table(spark, d, "orders").select("o_orderkey", "o_custkey"),
        F.col("o_orderkey") == F.col("l_orderkey"),
    ).join(customers, F.col("c_custkey") == F.col("o_custkey"))
    return rows.groupBy("customer_nation", "supplier_nation").agg(F.count("*").alias("n"))


@query(f"""WITH {EVENT_VERSIONS} SELECT e.event_id, e.user_id, coalesce(v.event_type, 'Unknown') AS state, v.valid_from_date FROM events e ASOF LEFT JOIN versions v ON e.user_id = v.user_id AND (e.ts::DATE - 1) >= v.valid_from_date""")
def asof_join(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the user's state on the day before."""
    v = event_versions(spark, d).select("user_id", F.col("event_type").alias("state"), "valid_from_date", "valid_to_date")
    rows = star.interval_join(table(spark, d, "events").select("event_id", "user_id", "ts"), v, "user_id", F.date_sub(F.to_date("ts"), 1))
    return rows.select("event_id", "user_id", F.coalesce("state", F.lit("Unknown")).alias("state"), "valid_from_date")


@query("""WITH asked AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN l_suppkey END AS id, CASE WHEN l_orderkey % 3 <> 0 THEN 'Supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') END AS name FROM lineitem)
  SELECT l_orderkey, l_linenumber, id, name, coalesce(a.s_suppkey, b.s_suppkey, -1) AS s_suppkey FROM asked LEFT JOIN supplier a ON a.s_suppkey = id LEFT JOIN supplier b ON id IS NULL AND b.s_name = name""")
def split_or_join(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 2 == 0, F.col("l_suppkey")).alias("id"),
        F.when(F.col("l_orderkey") % 3 != 0, F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))).alias("name"),
    )
    return star.reference_join(li, table(spark, d, "supplier"), "id", "name", "s_suppkey", "s_suppkey", "s_name", [up("s_suppkey")], missing=-1)


@query(
    "SELECT coalesce(o.y, l.y) AS year, coalesce(o.n, 0) AS orders, coalesce(l.n, 0) AS shipments FROM (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1) o FULL JOIN (SELECT year(l_shipdate) AS y, count(*) AS n FROM lineitem GROUP BY 1) l ON o.y = l.y"
)
def full_outer_counts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("orders"))
    li = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.count("*").alias("shipments"))
    return o.join(li, "year", "full_outer").select("year", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("shipments", F.lit(0)).alias("shipments"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0) GROUP BY 1")
def orphan_anti(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "orders").where("o_orderkey % 10 <> 0")
    return star.orphans(table(spark, d, "lineitem"), known, "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45")
def nested_exists(spark: SparkSession, d: str) -> DataFrame:
    nested = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_quantity")).alias("lines"))
    return nested.where(F.exists("lines", lambda x: (x["l_returnflag"] == "R") & (x["l_quantity"] >= 45))).select("l_orderkey")


@query(
    "SELECT 'customer' AS kind, c_custkey AS party_key, c_name AS name, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'supplier', s_suppkey, s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey"
)
def union_parties(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("party_key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n_nationkey"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("party_key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("n_nationkey"))
    return c.unionByName(s).join(n, "n_nationkey").drop("n_nationkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(down("o_totalprice"), up("o_orderkey")).limit(100)


# ---------------------------------------------------------------- data tests


@query(
    "WITH " + EV + " SELECT 'v' AS column_name, count_if(v IS NULL) AS failures FROM ev UNION ALL SELECT 'user_id', count_if(user_id IS NULL) FROM ev UNION ALL SELECT 'ts', count_if(ts IS NULL) FROM ev"
)
def dq_not_null(spark: SparkSession, d: str) -> DataFrame:
    return quality.null_counts(events(spark, d), ["v", "user_id", "ts"])


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def dq_unique(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicated(table(spark, d, "lineitem"), "l_partkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_composite_unique(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicated(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup')")
def dq_accepted(spark: SparkSession, d: str) -> DataFrame:
    return quality.outside_values(table(spark, d, "events"), "event_type", ["click", "view", "purchase", "signup"]).select("event_id", "event_type")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0)")
def dq_relationships(spark: SparkSession, d: str) -> DataFrame:
    return quality.relationships(table(spark, d, "orders"), table(spark, d, "customer").where("c_custkey % 4 <> 0"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000")
def dq_range(spark: SparkSession, d: str) -> DataFrame:
    return quality.outside_range(table(spark, d, "customer"), "c_acctbal", 0.0, 9000.0).select("c_custkey", "c_acctbal")


@query("SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE NOT (l_discount + l_tax < 0.15)")
def dq_expression(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_true(table(spark, d, "lineitem"), F.col("l_discount") + F.col("l_tax") < 0.15).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")


def faulty_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions of orders with faults: ends moved, flags doubled."""
    late = F.when(F.col("o_orderkey") % 9 == 0, F.date_add("valid_to_date", 3)).when(F.col("o_orderkey") % 11 == 0, F.date_sub("valid_to_date", 2)).otherwise(F.col("valid_to_date"))
    v = order_versions(spark, d).withColumn("is_current", F.col("is_current") | (F.col("o_orderkey") % 13 == 0))
    return v.withColumn("valid_to_date", F.when(F.col("valid_to_date") < F.lit("9999-12-31").cast("date"), late).otherwise(F.col("valid_to_date")))


FAULTY = ORDER_VERSIONS + """, faulty AS (SELECT * REPLACE (is_current OR o_orderkey % 13 = 0 AS is_current, CASE WHEN valid_to_date = DATE '9999-12-31' THEN valid_to_date WHEN o_orderkey % 9 = 0 THEN valid_to_date + 3
  WHEN o_orderkey % 11 = 0 THEN valid_to_date - 2 ELSE valid_to_date END AS valid_to_date) FROM versions)"""


@query(f"WITH {FAULTY} SELECT o_custkey, o_orderkey, valid_from_date, lag(valid_to_date) OVER w AS previous_end FROM faulty WINDOW w AS (PARTITION BY o_custkey ORDER BY valid_from_date, valid_to_date) QUALIFY valid_from_date <= lag(valid_to_date) OVER w")
def dq_scd2_overlap(spark: SparkSession, d: str) -> DataFrame:
    return quality.overlapping(faulty_versions(spark, d), "o_custkey").select("o_custkey", "o_orderkey", "valid_from_date", "previous_end")


@query(f"WITH {FAULTY} SELECT o_custkey, o_orderkey, valid_to_date, lead(valid_from_date) OVER w AS next_start FROM faulty WINDOW w AS (PARTITION BY o_custkey ORDER BY valid_from_date, valid_to_date) QUALIFY lead(valid_from_date) OVER w <> valid_to_date + 1")
def dq_scd2_continuity(spark: SparkSession, d: str) -> DataFrame:
    return quality.discontinuous(faulty_versions(spark, d), "o_custkey").select("o_custkey", "o_orderkey", "valid_to_date", "next_start")


@query(f"WITH {FAULTY} SELECT o_custkey, count_if(is_current) AS n_current FROM faulty GROUP BY 1 HAVING count_if(is_current) <> 1")
def dq_scd2_current(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_one_current(faulty_versions(spark, d), "o_custkey")


@query(
    "WITH " + EV + " SELECT event_id, lag(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_value FROM ev QUALIFY v IS NULL AND lag(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL"
)
def dq_fill_sanity(spark: SparkSession, d: str) -> DataFrame:
    return quality.fill_lost(events(spark, d), "user_id", [up("ts"), up("event_id")], "v").select("event_id", "last_value")


@query("SELECT event_id FROM events QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type")
def dq_false_version(spark: SparkSession, d: str) -> DataFrame:
    return quality.unchanged_versions(table(spark, d, "events"), "user_id", [up("ts"), up("event_id")], ["event_type"]).select("event_id")


ALLOWED = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "error"), ("click", "error"), ("purchase", "view"), ("error", "view")]


@query(
    "SELECT event_id, p AS previous, event_type AS current FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p <> event_type AND (p, event_type) NOT IN (" + ", ".join(
        str(a) for a in ALLOWED
    ) + ")"
)
def dq_state_machine(spark: SparkSession, d: str) -> DataFrame:
    allowed = spark.createDataFrame(ALLOWED, "previous string, current string")
    return scd.transitions_not_allowed(table(spark, d, "events"), ["user_id"], [up("ts"), up("event_id")], "event_type", allowed).select("event_id", "previous", "current")


@query(
    "SELECT 'events' AS source, max(ts) AS newest, round(date_diff('microsecond', max(ts), TIMESTAMP '2024-02-02') // 1000000 / 3600.0, 6) AS age_hours, CASE WHEN date_diff('microsecond', max(ts), TIMESTAMP '2024-02-02') // 1000000 / 3600.0 <= 24 THEN 'PASS' ELSE 'WARN' END AS status FROM events"
)
def dq_freshness(spark: SparkSession, d: str) -> DataFrame:
    return quality.freshness(table(spark, d, "events"), "ts", F.lit("2024-02-02").cast("timestamp_ntz"), 24, "events").withColumn("age_hours", F.round("age_hours", 6))


# ---------------------------------------------------------------- reconciliation


@query("""WITH stated AS (SELECT event_type AS dataset, count(*) + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS expected FROM events GROUP BY 1), loaded AS (SELECT event_type AS dataset, count(*) AS actual FROM events WHERE event_type <> 'view' GROUP BY 1)
  SELECT dataset, expected, actual, CASE WHEN expected = actual THEN 'PASS' ELSE 'WARNING' END AS status, CASE WHEN actual IS NULL THEN 'no source loaded' WHEN expected = actual THEN 'counts agree' ELSE 'counts differ' END AS message FROM stated LEFT JOIN loaded USING (dataset)""")
def reconcile_audit(spark: SparkSession, d: str) -> DataFrame:
    """Stated counts, as record counts or as sums of positive values, against what was loaded; one is off by one."""
    counts = table(spark, d, "events").groupBy(F.col("event_type").alias("dataset")).agg(F.count("*").alias("n"))
    off = F.col("n") + (F.col("dataset") == "click").cast("int")
    stated = counts.select("dataset", F.when(F.col("dataset").isin("click", "view"), "D_RECORDS").otherwise("D_ROWS").alias("attribute"), off.alias("value"))
    noise = counts.select("dataset", F.lit("D_MIN").alias("attribute"), F.lit(-5).cast("bigint").alias("value"))
    return reconcile.against_audit(reconcile.audit_counts(stated.unionByName(noise)), counts.where("dataset <> 'view'").select("dataset", F.col("n").alias("actual")))


@query("WITH " + EV + """, s AS (SELECT _batch_id, count(*) AS e FROM ev GROUP BY 1), t AS (SELECT _batch_id, count(*) AS a FROM ev WHERE event_type IN ('purchase', 'error') AND _batch_id <> 3 GROUP BY 1), j AS (SELECT coalesce(s._batch_id, t._batch_id) AS _batch_id, coalesce(e, 0) AS expected, coalesce(a, 0) AS actual FROM s FULL JOIN t USING (_batch_id))
  SELECT _batch_id, expected, actual, round(abs(expected - actual) / expected::DOUBLE * 100, 2) AS delta_pct, CASE WHEN round(abs(expected - actual) / expected::DOUBLE * 100, 2) > 62 THEN 'WARNING' ELSE 'PASS' END AS status, 'expected ' || expected || ', actual ' || actual AS message FROM j""")
def reconcile_batch(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return reconcile.by_batch(e, e.where("v is not null and _batch_id <> 3"), 62.0)


@query("""SELECT e AS expected, a AS actual, round(abs(e - a) / e::DOUBLE * 100, 2) AS delta_pct, CASE WHEN abs(e - a) / e::DOUBLE * 100 > 2 THEN 'WARNING' ELSE 'PASS' END AS status, 'expected ' || e || ', actual ' || a AS message
  FROM (SELECT count(*) AS e, count(*) AS a FROM part)""")
def reconcile_total(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.totals(table(spark, d, "part"), part_dim(spark, d), 2.0)


# ---------------------------------------------------------------- incremental loads


@query("WITH " + EV + " SELECT _batch_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks FROM ev GROUP BY 1")
def batch_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """Batch 2 is loaded again in place of its first load; totals stay."""
    e = events(spark, d)
    held = sinks.replace_batch(e.where("event_id % 2 = 0 or _batch_id <> 2"), e.where("_batch_id = 2"))
    return held.groupBy("_batch_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"))


@query("WITH " + EV + " SELECT _batch_id, count(*) AS n FROM ev WHERE _batch_id <> 1 GROUP BY 1")
def skip_loaded(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    loaded = e.where("_batch_id = 1").select("_batch_id").distinct()
    return sinks.unloaded_batches(e, loaded).groupBy("_batch_id").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- governance

CUSTOMER_LEVELS = {"c_custkey": "internal", "c_name": "restricted", "c_nationkey": "internal", "c_acctbal": "restricted", "c_mktsegment": "confidential"}


@query("SELECT c_custkey, '***MASKED***' AS c_name, c_nationkey, NULL::DOUBLE AS c_acctbal, c_mktsegment FROM customer")
def mask_analyst(spark: SparkSession, d: str) -> DataFrame:
    return govern.mask(govern.classify(table(spark, d, "customer"), CUSTOMER_LEVELS), "analyst")


@query("SELECT * FROM customer")
def mask_custodian(spark: SparkSession, d: str) -> DataFrame:
    return govern.mask(govern.classify(table(spark, d, "customer"), CUSTOMER_LEVELS), "custodian")


@query("SELECT c_custkey, c_nationkey FROM customer")
def visible_internal(spark: SparkSession, d: str) -> DataFrame:
    return govern.visible(govern.classify(table(spark, d, "customer"), CUSTOMER_LEVELS), "internal")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 50 = 7 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderdate FROM orders")
def erase_subject(spark: SparkSession, d: str) -> DataFrame:
    subjects = table(spark, d, "customer").where("c_custkey % 50 = 7").select(F.col("c_custkey").alias("o_custkey"))
    return govern.erase(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), subjects, "o_custkey", ["o_totalprice"])


@query("SELECT c_custkey AS subject, 'orders' AS layer, count(o_orderkey) AS rows_erased FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 50 = 7 GROUP BY 1")
def erasure_log(spark: SparkSession, d: str) -> DataFrame:
    subjects = table(spark, d, "customer").where("c_custkey % 50 = 7").select(F.col("c_custkey").alias("o_custkey"))
    return govern.erasure_log(table(spark, d, "orders"), subjects, "o_custkey", "orders")


@query("SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_type IN ('purchase', 'signup') GROUP BY 1")
def access_audit(spark: SparkSession, d: str) -> DataFrame:
    """Events as an access log: each touches a table with the columns of its kind."""
    columns = F.when(F.col("event_type").isin("purchase", "signup"), F.array(F.lit("c_name"), F.lit("c_custkey"))).otherwise(F.array(F.lit("c_custkey")))
    log = table(spark, d, "events").select("user_id", "ts", F.array(F.struct(F.lit("customer").alias("name"), columns.alias("columns"))).alias("objects"))
    return govern.access_audit(log, ["c_name", "c_acctbal"], F.lit("2024-01-15").cast("timestamp_ntz")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN props END AS props FROM events")
def retention(spark: SparkSession, d: str) -> DataFrame:
    return govern.retain(table(spark, d, "events"), "ts", F.lit("2024-01-30").cast("timestamp_ntz"), 10, ["props"]).select("event_id", "props")
