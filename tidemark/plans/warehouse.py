"""The brokerage warehouse: bronze tables from files or from the given tables, and any model built on them."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import row_hash
from tidemark.plans import gold, silver, specs
from tidemark.session import remove_folder, shared_folder, shuffles_freed, table
from tidemark.sources import control, delimited, fixed_width, sinks, xml


def models(bronze: dict[str, DataFrame], written: dict[str, DataFrame] | None = None) -> Callable[[str], DataFrame]:
    """A function from a model's name to its DataFrame; a model is planned once and only when asked for.

    ``written`` are models that are stored already and are read, not planned again.
    """
    made: dict[str, DataFrame] = dict(written or {})

    def get(name: str) -> DataFrame:
        if name not in made:
            made[name] = silver.MODELS[name](bronze) if name in silver.MODELS else gold.MODELS[name](get)
        return made[name]

    return get


def silver_parents(names: list[str]) -> list[str]:
    """The silver models that the given gold models read, however deep."""
    met, todo = set(), list(names)
    while todo:
        name = todo.pop()
        if name not in met:
            met.add(name)
            todo += gold.READS.get(name, ())
    return sorted(met & set(silver.MODELS))


def write_models(get: Callable[[str], DataFrame], names: list[str], folder: str, at_once: int = 6) -> dict[str, DataFrame]:
    """Write models that do not read each other, some at a time, each as a full refresh under its own schema; returns them as read back."""

    def write(name: str) -> tuple[str, DataFrame]:
        df, path = get(name), f"{folder.rstrip('/')}/{name}"
        sinks.full_refresh(df, path, df.schema, compression="zstd")
        return name, df.sparkSession.read.schema(df.schema).parquet(path)

    if not names:
        return {}
    spark = [get(name) for name in names][0].sparkSession  # plans are made in one thread
    with shuffles_freed(spark), ThreadPoolExecutor(at_once) as pool:
        return dict(pool.map(inheritable_thread_target(spark)(write), names))


def build(bronze: dict[str, DataFrame], names: list[str], folder: str) -> Callable[[str], DataFrame]:
    """Build gold models as layers: every silver model that they need is written once below ``folder``, and gold reads it.

    Returns the function from names to DataFrames over what was written.
    """
    return models(bronze, write_models(models(bronze), silver_parents(names), folder))


def build_all(bronze: dict[str, DataFrame], folder: str) -> Callable[[str], DataFrame]:
    """Build and write all models, layer by layer, each from what the layers before have written."""
    written: dict[str, DataFrame] = {}
    for layer in (list(silver.MODELS), *gold.LAYERS):
        written |= write_models(models(bronze, written), list(layer), folder)
    return models(bronze, written)


def walk(
    bronze: dict[str, DataFrame],
    names: list[str],
    folder: str,
    visit: Callable[[list[str], Callable[[str], DataFrame]], None] = lambda names, get: None,
    visits: dict[str, set[str]] | None = None,
    keep: tuple[str, ...] | list[str] = (),
    written: Callable[[str], bool] = lambda name: True,
) -> Callable[[str], DataFrame]:
    """Write the named models and all that they read, in the order of ``WAVES``; each is removed once nothing that follows reads it.

    After a wave is written, ``visit`` gets the names of its models and the function from names to DataFrames; what it
    makes of them must be used when it returns. ``visits`` names other models that it reads for a model. Models that
    ``written`` says no to are planned by those that read them. So the disk holds the models that are still read, and the
    shuffles of one wave. Those in ``keep`` stay.
    """
    visits, met, todo = visits or {}, set(), list(names)
    while todo:
        name = todo.pop()
        if name not in met:
            met.add(name)
            todo += [*gold.READS.get(name, ()), *visits.get(name, ())]
    waves = [wave for w in WAVES if (wave := [n for n in w if n in met and written(n)])]
    stored: dict[str, DataFrame] = {}

    def remove_all_but(read: set[str]) -> None:
        for name in sorted(set(stored) - read):
            remove_folder(stored.pop(name).sparkSession, f"{folder.rstrip('/')}/{name}")

    for k, wave in enumerate(waves):
        stored |= write_models(models(bronze, stored), wave, folder)
        later = {n for w in waves[k + 1 :] for n in w}
        read = later.union(keep, *(visits.get(n, ()) for n in later), *(written_below(n, written) for n in later))
        remove_all_but(read.union(wave, *(visits.get(n, ()) for n in wave)))
        visit(wave, models(bronze, stored))
        remove_all_but(read)
    return models(bronze, stored)


def written_below(name: str, written: Callable[[str], bool]) -> set[str]:
    """The written models that a model reads, itself or by way of models that are not written."""
    return set().union(*({n} if written(n) else written_below(n, written) for n in gold.READS.get(name, ())))


#: All models, those of a wave at once: what they read, and what their tests refer to, comes before them, and the large ones are alone.
WAVES = (
    ("silver_date", "silver_time", "silver_status_type", "silver_tax_rate", "silver_industry", "silver_trade_type", "silver_hr", "silver_prospect"),
    ("dim_date", "dim_time", "dim_statustype", "dim_tradetype", "dim_broker", "dim_prospect", "silver_finwire_company", "silver_finwire_security"),
    ("dim_company", "silver_customer"),
    ("dim_security", "dim_customer", "silver_account"),
    ("silver_daily_market", "silver_finwire_financials", "dim_account"),
    ("fact_market_history", "fact_company_financials", "silver_watch_history"),
    ("fact_watchitem", "silver_cash_transaction"),
    ("fact_cashtransaction", "silver_trade"),
    ("fact_trade",),
    ("silver_trade_history",),
    ("fact_trade_history",),
    ("silver_holding_history",),
    ("fact_holding",),
)


def enveloped(df: DataFrame, batch: Column, loaded_at: Column, changes: bool = False) -> DataFrame:
    """The load envelope; change columns are no part of the hash."""
    business = [c for c in df.columns if c not in ("_cdc_flag", "_cdc_dsn", "_dq_errors", "_source_file", "_b", "_batch_id", "_loaded_at")]
    if changes and "_cdc_flag" not in df.columns:
        df = df.withColumns({"_cdc_flag": F.lit("I"), "_cdc_dsn": F.lit(0).cast("bigint")})
    return df.withColumns({"_batch_id": batch, "_loaded_at": loaded_at, "_row_hash": row_hash(business)})


def read_bronze(spark: SparkSession, folder: str, names: dict[str, str], loaded_at: Column) -> dict[str, DataFrame]:
    """Bronze tables of all batches below ``folder`` (Batch1, Batch2, …): ``names`` maps sources to globs below it.

    Every row carries the name of its file.
    FINWIRE files and the customer actions are read once for each of their target tables.
    """
    root, out = folder.rstrip("/"), {}
    batch = F.regexp_extract("_file", r"[Bb]atch(\d+)/(?!.*[Bb]atch\d+/)", 1).cast("int")
    located = lambda rows: rows.withColumns({"_b": batch, "_source_file": F.regexp_extract("_file", BELOW_BATCH, 1)}).drop("_file")
    lines = lambda glob: spark.read.text(f"{root}/{glob}").select("value", F.col("_metadata.file_path").alias("_file"))
    for name, glob in names.items():
        if name in specs.DELIMITED:
            spec = specs.DELIMITED[name]
            rows = delimited.parse_lines(lines(glob), spec, keep=["_file"])
            out[name] = enveloped(located(rows), F.col("_b"), loaded_at, spec.changes).drop("_b")
        elif name == "finwire":
            wire = fixed_width.checked(lines(glob).where(~F.col("_file").like("%\\_audit.csv")), list(specs.WIRE.values()))
            for kind, spec in specs.WIRE.items():
                rows = fixed_width.parse_records(wire, spec, keep=["_file"])
                rows = fixed_width.split_reference(rows, spec.rest, "cocik", "coname") if spec.rest else rows
                out[kind] = enveloped(located(rows), F.col("_b"), loaded_at).drop("_b")
        elif name == "actions":
            acts = xml.read_actions(spark, f"{root}/{glob}", keep_path=True).withColumnRenamed("_path", "_file")
            for kind, flat in (("mgmt_customer", xml.customers), ("mgmt_account", xml.accounts)):
                out[kind] = enveloped(located(flat(acts, ["_file"])), F.col("_b"), loaded_at).drop("_b")
        elif name == "batch_control":
            out[name] = control.read_batch_calendar(spark, f"{root}/{glob}")
        elif name == "source_audit":
            out[name] = control.read_audit(spark, f"{root}/{glob}")
    return out


#: The name of a source file, directly below its batch's folder (a folder of part files counts as one file).
BELOW_BATCH = r"[Bb]atch\d+/([^/]+)(?!.*[Bb]atch\d+/)"


class Lazy(dict):
    """Tables by name, each planned when it is first asked for."""

    def __getitem__(self, name: str) -> DataFrame:
        made = super().__getitem__(name)
        if callable(made) and not isinstance(made, DataFrame):
            made = made()
            self[name] = made
        return made


def derived_bronze(spark: SparkSession, d: str) -> Lazy:
    """Bronze tables from the given tables: orders are trades and customer actions, lineitem holdings and later
    trade states, events market, cash and watch rows, suppliers brokers and companies, parts securities."""
    t = lambda name: table(spark, d, name)
    orders, li, ev, part, sup, cust, nation, region = (t(n) for n in ("orders", "lineitem", "events", "part", "supplier", "customer", "nation", "region"))
    text = lambda c: F.col(c).cast("string")
    money = lambda c, s=2: F.col(c).cast(f"decimal(12,{s})")
    at = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    one, symbol = F.lit(1), lambda c: F.concat(F.lit("sym"), text(c))
    later = li.withColumn("_b", F.col("l_linenumber") + 1)
    days = orders.select(F.to_date("o_orderdate").alias("day")).union(li.select(F.to_date("l_shipdate"))).union(ev.select(F.to_date("ts"))).distinct()
    seconds = orders.select("o_orderdate").union(li.select("l_shipdate")).union(ev.select("ts")).toDF("ts").select(F.date_format("ts", "HH:mm:ss").alias("timevalue")).distinct()
    names = {c: F.lit("x ") for c in ("datedesc", "calendaryeardesc", "calendarqtrdesc", "calendarmonthdesc", "calendarweekdesc", "dayofweekdesc", "fiscalyeardesc", "fiscalqtrdesc")}
    second = lambda k: F.split("timevalue", ":")[k].cast("int")
    out = {
        "date": lambda: days.select(
            F.date_format("day", "yyyyMMdd").cast("int").alias("sk_dateid"),
            F.col("day").alias("datevalue"),
            F.year("day").alias("calendaryearid"),
            F.quarter("day").alias("calendarqtrid"),
            F.month("day").alias("calendarmonthid"),
            F.weekofyear("day").alias("calendarweekid"),
            F.dayofweek("day").alias("dayofweeknum"),
            F.year("day").alias("fiscalyearid"),
            F.quarter("day").alias("fiscalqtrid"),
            (F.dayofweek("day") == 1).alias("holidayflag"),
        ).withColumns(names),
        "time": lambda: seconds.select(
            (second(0) * 3600 + second(1) * 60 + second(2)).alias("sk_timeid"),
            "timevalue",
            second(0).alias("hourid"),
            text("timevalue").alias("hourdesc"),
            second(1).alias("minuteid"),
            text("timevalue").alias("minutedesc"),
            second(2).alias("secondid"),
            text("timevalue").alias("seconddesc"),
            (second(0) >= 9).alias("markethoursflag"),
            (second(0) >= 8).alias("officehoursflag"),
        ),
        "status_type": lambda: orders.select(F.lower("o_orderstatus").alias("st_id")).distinct().withColumn(
            "st_name",
            F.concat(F.lit(" status "), F.col("st_id")),
        ),
        "trade_type": lambda: orders.select(F.substring("o_orderpriority", 1, 1).alias("tt_id")).distinct().select(
            "tt_id",
            F.concat(F.lit("type "), F.col("tt_id")).alias("tt_name"),
            (F.col("tt_id").cast("int") % 2).alias("tt_is_sell"),
            (F.col("tt_id").cast("int") % 3).alias("tt_is_mrkt"),
        ),
        "tax_rate": lambda: region.select(
            text("r_regionkey").alias("tx_id"),
            F.col("r_name").alias("tx_name"),
            (F.col("r_regionkey") / 100).cast("decimal(6,5)").alias("tx_rate"),
        ),
        "industry": lambda: nation.select(
            text("n_nationkey").alias("in_id"),
            F.col("n_name").alias("in_name"),
            text("n_regionkey").alias("in_sc_id"),
        ),
        "hr": lambda: sup.select(
            F.col("s_suppkey").cast("int").alias("employeeid"),
            (F.col("s_suppkey") / 10).cast("int").alias("managerid"),
            F.lit("Eve").alias("employeefirstname"),
            F.col("s_name").alias("employeelastname"),
            F.lit("x").alias("employeemi"),
            F.col("s_nationkey").alias("employeejobcode"),
            text("s_nationkey").alias("employeebranch"),
            F.lit(" ").alias("employeeoffice"),
            text("s_acctbal").alias("employeephone"),
        ),
        "prospect": lambda: cust.select(
            text("c_custkey").alias("agencyid"),
            F.col("c_name").alias("lastname"),
            *[
                F.lit(" ").alias(c) for c in (
                    "firstname",
                    "middleinitial",
                    "gender",
                    "addressline1",
                    "addressline2",
                    "postalcode",
                    "city",
                    "state",
                    "country",
                    "phone",
                    "maritalstatus",
                    "ownorrentflag",
                    "employer",
                )
            ],
            *[F.col("c_nationkey").alias(c) for c in ("income", "numbercars", "numberchildren", "age", "creditrating", "numbercreditcards")],
            money("c_acctbal", 0).alias("networth"),
        ),
        "finwire_cmp": lambda: sup.select(
            F.lit("2000-01-01").cast("timestamp_ntz").alias("pts"),
            F.col("s_name").alias("companyname"),
            F.lpad(text("s_suppkey"), 10, "0").alias("cik"),
            F.lit("actv").alias("status"),
            text("s_nationkey").alias("industryid"),
            F.lit("AA").alias("sprating"),
            F.lit("1990-01-01").cast("date").alias("foundingdate"),
            *[F.lit(" ").alias(c) for c in ("addrline1", "addrline2", "postalcode", "city", "stateprovince", "country", "ceoname", "description")],
        ),
        "finwire_sec": lambda: part.select(
            F.lit("2000-01-02").cast("timestamp_ntz").alias("pts"),
            symbol("p_partkey").alias("symbol"),
            F.col("p_type").alias("issuetype"),
            F.lit("ACTV").alias("status"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("exid"),
            F.col("p_size").cast("bigint").alias("shout"),
            F.lit("1995-01-01").cast("date").alias("firsttradedate"),
            F.lit("1994-01-01").cast("date").alias("firsttradeexchg"),
            F.lit(None).cast("decimal(10,4)").alias("dividend"),
            F.when(F.col("p_partkey") % 3 != 0, F.lpad(text("p_size"), 10, "0")).alias("cocik"),
            F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Supplier#"), F.lpad(text("p_size"), 9, "0"))).alias("coname"),
        ),
        "trade_history": lambda: orders.select(
            F.col("o_orderkey").alias("th_t_id"),
            F.col("o_orderdate").alias("th_dts"),
            F.lower("o_orderstatus").alias("th_st_id"),
        ),
        "mgmt_customer": lambda: orders.select(
            F.when(F.col("o_orderkey") % 10 == 9, "INACT").when(F.col("o_orderkey") % 2 == 0, "NEW").otherwise("UPDCUST").alias("actiontype"),
            F.col("o_orderdate").alias("actionts"),
            F.col("o_custkey").alias("c_id"),
            F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("c_l_name"),
            (F.col("o_orderkey") % 3).cast("int").alias("c_tier"),
            text("o_orderkey").alias("c_tax_id"),
            (F.col("o_custkey") % 5).cast("string").alias("c_lcl_tx_id"),
        ),
        "mgmt_account": lambda: orders.select(
            F.when(F.col("o_orderkey") % 10 == 9, "CLOSEACCT").when(F.col("o_orderkey") % 2 == 0, "NEW").otherwise("UPDACCT").alias("actiontype"),
            F.col("o_orderdate").alias("actionts"),
            F.col("o_custkey").alias("ca_id"),
            F.col("o_custkey").alias("ca_c_id"),
            (F.col("o_custkey") % 7).alias("ca_b_id"),
            F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).alias("ca_name"),
            (F.col("o_orderkey") % 3).cast("int").alias("ca_tax_st"),
        ),
    }
    first = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    fin = lambda: first.groupBy(F.lpad(text("l_suppkey"), 10, "0").alias("cocik"), F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("quarter")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(15,2)")).cast("decimal(20,2)").alias("revenue"),
        F.count("*").alias("shout"),
        F.min(F.to_date("l_shipdate")).alias("qtrstartdate"),
        F.max(F.to_date("l_shipdate")).alias("postingdate"),
    )
    out["finwire_fin"] = lambda: fin().withColumns(
        {
            "pts": F.lit("2000-01-03").cast("timestamp_ntz"),
            "coname": F.lit(None).cast("string"),
            "dilutedshout": F.col("shout"),
        } | {c: F.col("revenue") for c in ("earnings", "inventory", "assets", "liabilities")} | {c: F.lit(None).cast("decimal(10,4)") for c in ("eps", "dilutedeps", "margin")}
    )
    out = {k: lambda v=v: enveloped(v(), one, at) for k, v in out.items()}
    # What the actions do not name stays empty, as in the source.
    want = {column for _, column, _ in silver.COLUMNS["customer"]}
    named = out["mgmt_customer"]
    out["mgmt_customer"] = lambda: named().withColumns({c: F.lit(None).cast("date" if c == "c_dob" else "string") for c in sorted(want - set(named().columns))})
    trade = lambda df, key, ts, status, qty, price, account: df.select(
        "_b",
        F.col(key).alias("t_id"),
        F.col(ts).alias("t_dts"),
        F.lower(status).alias("t_st_id"),
        F.substring("o_orderpriority", 1, 1).alias("t_tt_id"),
        (F.col(key) % 2 == 0).alias("t_is_cash"),
        symbol("sym").alias("t_s_symb"),
        F.col(qty).cast("int").alias("t_qty"),
        money(price).alias("t_bid_price"),
        F.col(account).alias("t_ca_id"),
        F.lit(" an executor ").alias("t_exec_name"),
        *[money(price).alias(c) for c in ("t_trade_price", "t_chrg", "t_comm", "t_tax")],
    )
    b1 = lambda: trade(
        orders.withColumns({"_b": one, "sym": F.col("o_orderkey") % 2500, "qty": F.col("o_custkey")}),
        "o_orderkey",
        "o_orderdate",
        "o_orderstatus",
        "qty",
        "o_totalprice",
        "o_custkey",
    )
    b23 = lambda: trade(
        later.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("sym", F.col("l_partkey")),
        "o_orderkey",
        "l_shipdate",
        "l_returnflag",
        "l_quantity",
        "l_extendedprice",
        "o_custkey",
    )
    day = F.to_date("ts")
    market = lambda: ev.groupBy(day.alias("dm_date"), symbol("user_id").alias("dm_s_symb")).agg(
        F.max("value").alias("dm_close"),
        F.max("value").alias("dm_high"),
        F.min("value").alias("dm_low"),
        F.count("*").alias("dm_vol"),
    )
    changes = {
        "trade": lambda: b1().unionByName(b23()),
        "holding_history": lambda: li.select(
            F.col("l_linenumber").alias("_b"),
            F.col("l_orderkey").alias("hh_h_t_id"),
            F.col("l_orderkey").alias("hh_t_id"),
            F.col("l_linenumber").alias("hh_before_qty"),
            F.col("l_quantity").cast("int").alias("hh_after_qty"),
        ).withColumn("_b", F.least("_b", F.lit(3))),
        "watch_history": lambda: ev.select(
            one.alias("_b"),
            F.col("user_id").alias("w_c_id"),
            symbol("event_id").alias("w_s_symb"),
            F.col("ts").alias("w_dts"),
            F.when(F.col("event_type") == "click", "actv").otherwise("cncl").alias("w_action"),
        ),
        "daily_market": lambda: market().withColumn("_b", one),
        "cash_transaction": lambda: ev.select(
            one.alias("_b"),
            F.col("user_id").alias("ct_ca_id"),
            F.col("ts").alias("ct_dts"),
            F.col("value").cast("decimal(15,2)").alias("ct_amt"),
            F.col("props").alias("ct_name"),
        ),
        "account": lambda: cust.select(
            (F.col("c_custkey") % 2 + 2).cast("int").alias("_b"),
            F.col("c_custkey").alias("ca_id"),
            (F.col("c_custkey") % 7).alias("ca_b_id"),
            F.col("c_custkey").alias("ca_c_id"),
            F.col("c_mktsegment").alias("ca_name"),
            F.col("c_nationkey").alias("ca_tax_st"),
            F.lit("actv").alias("ca_st_id"),
        ),
        "customer": lambda: cust.select(
            (F.col("c_custkey") % 2 + 2).cast("int").alias("_b"),
            F.col("c_custkey").alias("c_id"),
            F.col("c_name").alias("c_l_name"),
            F.col("c_nationkey").alias("c_tier"),
            F.lit("inac").alias("c_st_id"),
            *[F.lit(None).cast("date" if c == "c_dob" else "string").alias(c) for c in sorted(want - {"c_id", "c_l_name", "c_tier"})],
        ),
    }
    for k, v in changes.items():
        out[k] = lambda v=v: enveloped(v().withColumnRenamed("_b", "_batch_id"), F.col("_batch_id"), at, changes=True)
    # A batch to each line number, and the date of its month's day of that number.
    calendar = lambda: li.select("l_linenumber").distinct().select(
        F.col("l_linenumber").cast("int").alias("_batch_id"),
        F.concat(F.lit("2024-2-"), text("l_linenumber")).alias("value"),
    )
    out["batch_control"] = lambda: control.batch_calendar(calendar())
    return Lazy(out)


def _query(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        bronze = derived_bronze(spark, d)
        if name in silver.MODELS:
            return models(bronze)(name)
        folder = shared_folder(spark, "warehouse")
        if not any(n.startswith("fact_") for n in gold.READS[name]):
            return build(bronze, [name], folder)(name)
        # The facts that it reads are written too: their shuffles, and what they alone read, are gone when it runs.
        kept = {*silver_parents([name]), *(n for n in gold.READS[name] if n.startswith("fact_"))}.__contains__
        reads = sorted(written_below(name, kept))
        return walk(bronze, reads, folder, keep=reads, written=kept)(name)

    run.__name__ = f"wh_{name}"
    return run


QUERIES = {f"wh_{name}": _query(name) for name in (*silver.MODELS, *gold.MODELS)}
