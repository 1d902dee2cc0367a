"""Gold models: dimensions with an Unknown member, and facts whose foreign keys are never NULL.

Builders take ``table``, a function from a model's name to its DataFrame, so each asks for what it needs alone.
Times are joined as seconds of the day. Surrogate keys of facts hash natural keys, so facts that meet the
Unknown member stay apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import packed, second_of_day, second_of_text, surrogate_key, unpacked
from tidemark.operators.star import OPEN_END, Lookup, reference_join, resolve, with_unknown
from tidemark.operators.windows import dedup_latest, down, up

Table = Callable[[str], DataFrame]
U = "Unknown"


def known(c: str, default=U) -> Column:
    return F.coalesce(F.col(c), F.lit(default)).alias(c)


def dim_date(t: Table) -> DataFrame:
    d = t("silver_date").select(
        "date_sk",
        "date_value",
        "date_desc",
        F.col("calendar_year_id").alias("calendar_year"),
        "calendar_year_desc",
        "calendar_qtr_id",
        "calendar_qtr_desc",
        "calendar_month_id",
        "calendar_month_desc",
        "calendar_week_id",
        "calendar_week_desc",
        "day_of_week_num",
        "day_of_week_desc",
        F.col("fiscal_year_id").alias("fiscal_year"),
        "fiscal_year_desc",
        "fiscal_qtr_id",
        "fiscal_qtr_desc",
        F.col("holiday_flag").alias("is_holiday"),
    )
    values = {f.name: U if f.dataType.simpleString() == "string" else -1 for f in d.schema.fields}
    return with_unknown(d, values | {"date_value": "1900-01-01", "is_holiday": False})


def dim_time(t: Table) -> DataFrame:
    d = t("silver_time").select(
        "time_sk",
        second_of_text(F.col("time_value")).alias("second_of_day"),
        "hour_id",
        "hour_desc",
        "minute_id",
        "minute_desc",
        "second_id",
        "second_desc",
        F.col("market_hours_flag").alias("is_market_hours"),
        F.col("office_hours_flag").alias("is_office_hours"),
    )
    values = {f.name: U if f.dataType.simpleString() == "string" else -1 for f in d.schema.fields}
    return with_unknown(d, values | {"second_of_day": None, "is_market_hours": False, "is_office_hours": False})


def dim_statustype(t: Table) -> DataFrame:
    d = t("silver_status_type").select(surrogate_key("status_id").alias("status_type_sk"), F.col("status_id").alias("status_code"), known("status_name"))
    return with_unknown(d, {"status_type_sk": "-1", "status_code": "UNK", "status_name": U})


def dim_tradetype(t: Table) -> DataFrame:
    d = t("silver_trade_type").select(
        surrogate_key("trade_type_id").alias("trade_type_sk"),
        F.col("trade_type_id").alias("trade_type_code"),
        known("trade_type_name"),
        "is_sell_flag",
        F.col("is_market_flag").alias("is_market_order_flag"),
    )
    return with_unknown(d, {"trade_type_sk": "-1", "trade_type_code": "UNK", "trade_type_name": U})


def dim_broker(t: Table) -> DataFrame:
    d = t("silver_hr").select(
        surrogate_key("employee_id").alias("broker_sk"), "employee_id", F.col("manager_id").alias("manager_employee_id"), "first_name", "last_name", "middle_initial",
        known("job_code", -1), F.coalesce("branch", F.lit(U)).alias("branch_name"), F.coalesce("office", F.lit(U)).alias("office_code"), F.col("phone").alias("phone_number"),
    )
    return with_unknown(d, {"broker_sk": "-1", "first_name": U, "last_name": U, "job_code": -1, "branch_name": U, "office_code": U})


def dim_company(t: Table) -> DataFrame:
    latest = dedup_latest(t("silver_finwire_company"), ["cik"], [down("posting_ts"), down("_row_hash")])
    industry = t("silver_industry").select("industry_id", "industry_name", "sector_id")
    d = latest.join(industry.withColumnRenamed("industry_id", "industry_code"), F.col("industry_id") == F.col("industry_code"), "left").select(
        surrogate_key("cik").alias("company_sk"),
        F.col("cik").alias("company_cik"),
        "company_name",
        F.coalesce("status", F.lit(U)).alias("company_status"),
        known("sp_rating"),
        "founding_date",
        "address_line1",
        "address_line2",
        "postal_code",
        "city",
        "state_province",
        known("country"),
        "ceo_name",
        F.col("description").alias("company_description"),
        "industry_code",
        known("industry_name"),
        "sector_id",
    )
    return with_unknown(d, {"company_sk": "-1", "company_name": U, "company_status": U, "sp_rating": U, "country": U, "industry_name": U})


def _company(rows: DataFrame, t: Table) -> DataFrame:
    """company_sk by id where there is one, else by name; the Unknown member stands for neither."""
    real = t("dim_company").where("company_sk <> '-1'")
    return reference_join(rows, real, "company_cik", "company_name", "company_sk", "company_cik", "company_name", [up("company_cik")])


def dim_security(t: Table) -> DataFrame:
    latest = dedup_latest(t("silver_finwire_security"), ["security_symbol"], [down("posting_ts"), down("_row_hash")])
    d = _company(latest, t).select(
        surrogate_key("security_symbol").alias("security_sk"),
        F.col("security_symbol").alias("symbol"),
        known("issue_type"),
        F.coalesce("status", F.lit(U)).alias("security_status"),
        "security_name",
        known("exchange_id"),
        "shares_outstanding",
        "first_trade_date",
        "first_trade_exchange_date",
        "dividend",
        "company_sk",
    )
    return with_unknown(d, {"security_sk": "-1", "symbol": "UNKNOWN", "issue_type": U, "security_status": U, "security_name": U, "exchange_id": U, "company_sk": "-1"})


def _effective() -> list[Column]:
    return [
        F.col("valid_from_date").alias("effective_start_date"),
        F.nullif(F.col("valid_to_date"), F.lit(OPEN_END).cast("date")).alias("effective_end_date"),
        F.col("is_current"),
        F.col("cdc_flag"),
    ]


def dim_customer(t: Table) -> DataFrame:
    rates = t("silver_tax_rate").select("tax_rate_id", "tax_rate_name", "tax_rate")
    c = t("silver_customer")
    for kind in ("local", "national"):  # one dimension in two roles
        r = rates.toDF(f"_{kind}", f"{kind}_tax_rate_name", f"{kind}_tax_rate_pct")
        c = c.join(r, F.col(f"{kind}_tax_rate_id") == F.col(f"_{kind}"), "left").drop(f"_{kind}")
    phones = [
        F.col(f"phone{n}_{a}").alias(f"phone{n}_{b}") for n in (1, 2, 3) for a, b in (
            ("country_code", "country_code"),
            ("area_code", "area_code"),
            ("number", "local_number"),
            ("extension", "extension"),
        )
    ]
    d = c.select(
        F.col("customer_version_sk").alias("customer_sk"),
        "customer_id",
        "tax_id",
        F.coalesce("status_id", F.lit(U)).alias("customer_status"),
        "last_name",
        "first_name",
        "middle_name",
        known("gender"),
        F.coalesce("tier", F.lit(-1)).alias("customer_tier"),
        "date_of_birth",
        "address_line1",
        "address_line2",
        "postal_code",
        "city",
        known("state_province"),
        known("country"),
        *phones,
        "primary_email",
        "alternate_email",
        *_effective(),
        F.col("local_tax_rate_id").alias("local_tax_rate_code"),
        known("local_tax_rate_name"),
        "local_tax_rate_pct",
        F.col("national_tax_rate_id").alias("national_tax_rate_code"),
        known("national_tax_rate_name"),
        "national_tax_rate_pct",
    )
    names = ("customer_status", "last_name", "first_name", "gender", "state_province", "country", "local_tax_rate_name", "national_tax_rate_name")
    return with_unknown(
        d,
        dict.fromkeys(names, U) | {
            "customer_sk": "-1",
            "customer_id": -1,
            "customer_tier": -1,
            "effective_start_date": "1900-01-01",
            "is_current": False,
            "cdc_flag": "U",
        },
    )


def _versioned(dim: DataFrame, key: str, on: dict[str, str], day: str) -> Lookup:
    return Lookup(dim, key, on, key, day, "effective_start_date", "effective_end_date")


def dim_account(t: Table) -> DataFrame:
    broker = t("dim_broker").withColumn("employee_id", F.col("employee_id").cast("bigint"))
    rows = resolve(
        t("silver_account"),
        Lookup(broker, "broker_sk", {"broker_id": "employee_id"}, "broker_sk"),
        _versioned(t("dim_customer"), "customer_sk", {"customer_id": "customer_id"}, "valid_from_date"),
    )
    d = rows.select(
        F.col("account_version_sk").alias("account_sk"),
        "account_id",
        "account_name",
        "tax_status",
        F.coalesce("status_id", F.lit(U)).alias("account_status"),
        "broker_sk",
        "customer_sk",
        *_effective(),
    )
    return with_unknown(
        d,
        {
            "account_sk": "-1",
            "account_id": -1,
            "account_name": U,
            "tax_status": -1,
            "account_status": U,
            "broker_sk": "-1",
            "customer_sk": "-1",
            "effective_start_date": "1900-01-01",
            "is_current": False,
            "cdc_flag": "U",
        },
    )


def dim_prospect(t: Table) -> DataFrame:
    d = t("silver_prospect").select(
        surrogate_key("agency_id").alias("prospect_sk"),
        F.lit(None).cast("string").alias("customer_sk"),
        "agency_id",
        "last_name",
        "first_name",
        "middle_initial",
        known("gender"),
        "address_line1",
        "address_line2",
        "postal_code",
        "city",
        "state",
        "country",
        "phone",
        F.col("income").alias("annual_income"),
        F.col("number_cars").alias("number_of_cars"),
        F.col("number_children").alias("number_of_children"),
        known("marital_status"),
        "age",
        "credit_rating",
        "own_or_rent_flag",
        F.col("employer").alias("employer_name"),
        F.col("number_credit_cards").alias("number_of_credit_cards"),
        "net_worth",
    )
    return with_unknown(d, {"prospect_sk": "-1", "last_name": U, "first_name": U, "gender": U, "marital_status": U})


def _date(t: Table, day: str, alias: str) -> Lookup:
    return Lookup(t("dim_date").where("date_sk <> -1"), "date_sk", {day: "date_value"}, alias, missing=-1)


def _time(t: Table, second: str, alias: str) -> Lookup:
    return Lookup(t("dim_time"), "time_sk", {second: "second_of_day"}, alias, missing=-1)


def _moment(rows: DataFrame, ts: str) -> DataFrame:
    return rows.withColumns({"_day": F.to_date(ts), "_second": second_of_day(F.col(ts))})


def fact_trade(t: Table) -> DataFrame:
    rows = resolve(
        _moment(t("silver_trade"), "trade_timestamp"),
        Lookup(t("dim_security"), "security_sk", {"symbol": "symbol"}, "security_sk"),
        _versioned(t("dim_account"), "account_sk", {"customer_account_id": "account_id"}, "_day"),
        Lookup(t("dim_statustype"), "status_type_sk", {"status_id": "status_code"}, "status_type_sk"),
        Lookup(t("dim_tradetype"), "trade_type_sk", {"trade_type_id": "trade_type_code"}, "trade_type_sk"),
        _date(t, "_day", "trade_date_sk"),
        _time(t, "_second", "trade_time_sk"),
    )
    return rows.select(
        F.col("trade_id").alias("trade_sk"),
        "trade_id",
        "security_sk",
        "trade_date_sk",
        "trade_time_sk",
        "status_type_sk",
        "trade_type_sk",
        F.col("is_cash").alias("is_cash_flag"),
        "quantity",
        "bid_price",
        "account_sk",
        F.col("execution_name").alias("executor_name"),
        "trade_price",
        F.col("charge").alias("charge_amount"),
        F.col("commission").alias("commission_amount"),
        F.col("tax").alias("tax_amount"),
        "cdc_flag",
        F.col("_batch_id").alias("batch_id"),
    )


def fact_trade_history(t: Table) -> DataFrame:
    trades = t("fact_trade").select("trade_sk", F.col("trade_id").alias("_t"), "account_sk", "security_sk")
    rows = _moment(t("silver_trade_history"), "status_ts").join(trades, F.col("trade_id") == F.col("_t"))
    rows = resolve(
        rows,
        Lookup(t("dim_statustype"), "status_type_sk", {"status_id": "status_code"}, "status_type_sk"),
        _date(t, "_day", "status_date_sk"),
        _time(t, "_second", "status_time_sk"),
    )
    return rows.select(
        surrogate_key("trade_id", "status_ts", "status_id").alias("trade_history_sk"),
        "trade_sk",
        "trade_id",
        "account_sk",
        "security_sk",
        "status_type_sk",
        "status_date_sk",
        "status_time_sk",
        F.col("_source_model").alias("source_model"),
        F.col("_batch_id").alias("batch_id"),
    )


def fact_holding(t: Table) -> DataFrame:
    # Hashes go through the join as 16 bytes.
    hashes = packed(F.col("account_sk"), "account") | packed(F.col("security_sk"), "security")
    trades = t("fact_trade").select(F.col("trade_id").alias("_t"), F.col("trade_date_sk").alias("holding_date_sk"), *[c.alias(n) for n, c in hashes.items()])
    rows = t("silver_holding_history").withColumn("_sk", F.unhex(surrogate_key("_row_hash"))).join(trades, F.col("trade_id") == F.col("_t"))
    return rows.select(
        F.lower(F.hex("_sk")).alias("holding_sk"),
        "originating_trade_id",
        F.col("trade_id").alias("current_trade_id"),
        unpacked("security").alias("security_sk"),
        "holding_date_sk",
        unpacked("account").alias("account_sk"),
        F.col("qty_before").alias("before_quantity"),
        F.col("qty_after").alias("after_quantity"),
        F.col("_batch_id").alias("batch_id"),
    )


def fact_cashtransaction(t: Table) -> DataFrame:
    rows = resolve(
        _moment(t("silver_cash_transaction"), "transaction_ts"),
        _versioned(t("dim_account"), "account_sk", {"account_id": "account_id"}, "_day"),
        _date(t, "_day", "transaction_date_sk"),
        _time(t, "_second", "transaction_time_sk"),
    )
    return rows.select(
        surrogate_key("_row_hash").alias("cash_transaction_sk"),
        "transaction_date_sk",
        "transaction_time_sk",
        "account_sk",
        "amount",
        "description",
        F.col("_batch_id").alias("batch_id"),
    )


def fact_watchitem(t: Table) -> DataFrame:
    rows = resolve(
        _moment(t("silver_watch_history"), "event_ts"),
        _versioned(t("dim_customer"), "customer_sk", {"customer_id": "customer_id"}, "_day"),
        Lookup(t("dim_security"), "security_sk", {"security_symbol": "symbol"}, "security_sk"),
        _date(t, "_day", "watch_date_sk"),
        _time(t, "_second", "watch_time_sk"),
    )
    return rows.select(
        surrogate_key("_row_hash").alias("watch_item_sk"),
        "customer_sk",
        "security_sk",
        "watch_date_sk",
        "watch_time_sk",
        F.col("watch_action").alias("action_code"),
        F.col("_batch_id").alias("batch_id"),
    )


def fact_market_history(t: Table) -> DataFrame:
    rows = resolve(t("silver_daily_market"), Lookup(t("dim_security"), "security_sk", {"security_symbol": "symbol"}, "security_sk"), _date(t, "market_date", "market_date_sk"))
    return rows.select(
        surrogate_key("_row_hash").alias("market_history_sk"),
        "security_sk",
        "market_date_sk",
        "close_price",
        "high_price",
        "low_price",
        "volume",
        F.col("_batch_id").alias("batch_id"),
    )


def fact_company_financials(t: Table) -> DataFrame:
    rows = resolve(_company(t("silver_finwire_financials"), t), _date(t, "qtr_start_date", "fiscal_date_sk"), _date(t, "posting_date", "posting_date_sk"))
    return rows.select(
        surrogate_key(F.coalesce("company_cik", "company_name"), "year", "quarter").alias("company_financials_sk"),
        "company_sk",
        "fiscal_date_sk",
        F.col("year").alias("fiscal_year"),
        F.col("quarter").alias("fiscal_quarter"),
        "revenue",
        "earnings",
        F.col("eps").alias("eps_basic"),
        F.col("diluted_eps").alias("eps_diluted"),
        F.col("margin").alias("profit_margin"),
        "inventory",
        F.col("assets").alias("total_assets"),
        F.col("liabilities").alias("total_liabilities"),
        "shares_outstanding",
        "diluted_shares_outstanding",
        F.col("_batch_id").alias("batch_id"),
        "posting_date_sk",
    )


MODELS = {
    f.__name__: f for f in (
        dim_date,
        dim_time,
        dim_statustype,
        dim_tradetype,
        dim_broker,
        dim_company,
        dim_security,
        dim_customer,
        dim_account,
        dim_prospect,
        fact_trade,
        fact_trade_history,
        fact_holding,
        fact_cashtransaction,
        fact_watchitem,
        fact_market_history,
        fact_company_financials,
    )
}

#: Models that read silver alone, and then those that read models of the layers before.
LAYERS = (
    ("dim_date", "dim_time", "dim_statustype", "dim_tradetype", "dim_broker", "dim_company", "dim_customer", "dim_prospect"),
    ("dim_security", "dim_account"),
    ("fact_trade", "fact_cashtransaction", "fact_watchitem", "fact_market_history", "fact_company_financials"),
    ("fact_trade_history", "fact_holding"),
)

#: What each model reads.
READS = {
    "dim_date": ("silver_date",),
    "dim_time": ("silver_time",),
    "dim_statustype": ("silver_status_type",),
    "dim_tradetype": ("silver_trade_type",),
    "dim_broker": ("silver_hr",),
    "dim_company": ("silver_finwire_company", "silver_industry"),
    "dim_security": ("silver_finwire_security", "dim_company"),
    "dim_customer": ("silver_customer", "silver_tax_rate"),
    "dim_account": ("silver_account", "dim_broker", "dim_customer"),
    "dim_prospect": ("silver_prospect",),
    "fact_trade": ("silver_trade", "dim_security", "dim_account", "dim_statustype", "dim_tradetype", "dim_date", "dim_time"),
    "fact_trade_history": ("silver_trade_history", "fact_trade", "dim_statustype", "dim_date", "dim_time"),
    "fact_holding": ("silver_holding_history", "fact_trade"),
    "fact_cashtransaction": ("silver_cash_transaction", "dim_account", "dim_date", "dim_time"),
    "fact_watchitem": ("silver_watch_history", "dim_customer", "dim_security", "dim_date", "dim_time"),
    "fact_market_history": ("silver_daily_market", "dim_security", "dim_date"),
    "fact_company_financials": ("silver_finwire_financials", "dim_company", "dim_date"),
}
