"""Silver models: cleaned, deduplicated and versioned tables from bronze ones.

``bronze`` maps source names to DataFrames that carry the load envelope (_batch_id, _loaded_at, _row_hash, and
_cdc_flag and _cdc_dsn where the source has changes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.casting import trim_or_null
from tidemark.functions.keys import packed, surrogate_key, unpacked
from tidemark.operators.scd import status_transitions
from tidemark.operators.windows import changed_only, close_intervals, dedup_latest, down, forward_fill, up

Bronze = dict[str, DataFrame]

# Parts of a phone number, and their names in the source.
PHONE = (("country_code", "ctry"), ("area_code", "area"), ("number", "local"), ("extension", "ext"))
# Silver column, bronze column, how its text is cleaned.
KEEP, TRIM, UPPER = "keep", "trim", "upper"
COLUMNS = {
    "date": [
        ("date_sk", "sk_dateid", KEEP),
        ("date_value", "datevalue", KEEP),
        ("date_desc", "datedesc", TRIM),
        ("calendar_year_id", "calendaryearid", KEEP),
        ("calendar_year_desc", "calendaryeardesc", TRIM),
        ("calendar_qtr_id", "calendarqtrid", KEEP),
        ("calendar_qtr_desc", "calendarqtrdesc", TRIM),
        ("calendar_month_id", "calendarmonthid", KEEP),
        ("calendar_month_desc", "calendarmonthdesc", TRIM),
        ("calendar_week_id", "calendarweekid", KEEP),
        ("calendar_week_desc", "calendarweekdesc", TRIM),
        ("day_of_week_num", "dayofweeknum", KEEP),
        ("day_of_week_desc", "dayofweekdesc", TRIM),
        ("fiscal_year_id", "fiscalyearid", KEEP),
        ("fiscal_year_desc", "fiscalyeardesc", TRIM),
        ("fiscal_qtr_id", "fiscalqtrid", KEEP),
        ("fiscal_qtr_desc", "fiscalqtrdesc", TRIM),
        ("holiday_flag", "holidayflag", KEEP),
    ],
    "time": [
        ("time_sk", "sk_timeid", KEEP),
        ("time_value", "timevalue", TRIM),
        ("hour_id", "hourid", KEEP),
        ("hour_desc", "hourdesc", TRIM),
        ("minute_id", "minuteid", KEEP),
        ("minute_desc", "minutedesc", TRIM),
        ("second_id", "secondid", KEEP),
        ("second_desc", "seconddesc", TRIM),
        ("market_hours_flag", "markethoursflag", KEEP),
        ("office_hours_flag", "officehoursflag", KEEP),
    ],
    "status_type": [
        ("status_id", "st_id", UPPER),
        ("status_name", "st_name", TRIM),
    ],
    "tax_rate": [
        ("tax_rate_id", "tx_id", UPPER),
        ("tax_rate_name", "tx_name", TRIM),
        ("tax_rate", "tx_rate", KEEP),
    ],
    "industry": [
        ("industry_id", "in_id", UPPER),
        ("industry_name", "in_name", TRIM),
        ("sector_id", "in_sc_id", UPPER),
    ],
    "trade_type": [
        ("trade_type_id", "tt_id", UPPER),
        ("trade_type_name", "tt_name", TRIM),
        ("is_sell_flag", "tt_is_sell", KEEP),
        ("is_market_flag", "tt_is_mrkt", KEEP),
    ],
    "hr": [
        ("employee_id", "employeeid", KEEP),
        ("manager_id", "managerid", KEEP),
        ("first_name", "employeefirstname", TRIM),
        ("last_name", "employeelastname", TRIM),
        ("middle_initial", "employeemi", UPPER),
        ("job_code", "employeejobcode", KEEP),
        ("branch", "employeebranch", TRIM),
        ("office", "employeeoffice", TRIM),
        ("phone", "employeephone", TRIM),
    ],
    "prospect": [
        ("agency_id", "agencyid", TRIM),
        ("last_name", "lastname", TRIM),
        ("first_name", "firstname", TRIM),
        ("middle_initial", "middleinitial", UPPER),
        ("gender", "gender", UPPER),
        ("address_line1", "addressline1", TRIM),
        ("address_line2", "addressline2", TRIM),
        ("postal_code", "postalcode", TRIM),
        ("city", "city", TRIM),
        ("state", "state", UPPER),
        ("country", "country", TRIM),
        ("phone", "phone", TRIM),
        ("income", "income", KEEP),
        ("number_cars", "numbercars", KEEP),
        ("number_children", "numberchildren", KEEP),
        ("marital_status", "maritalstatus", UPPER),
        ("age", "age", KEEP),
        ("credit_rating", "creditrating", KEEP),
        ("own_or_rent_flag", "ownorrentflag", UPPER),
        ("employer", "employer", TRIM),
        ("number_credit_cards", "numbercreditcards", KEEP),
        ("net_worth", "networth", KEEP),
    ],
    "cash_transaction": [
        ("account_id", "ct_ca_id", KEEP),
        ("transaction_ts", "ct_dts", KEEP),
        ("amount", "ct_amt", KEEP),
        ("description", "ct_name", TRIM),
    ],
    "daily_market": [
        ("market_date", "dm_date", KEEP),
        ("security_symbol", "dm_s_symb", UPPER),
        ("close_price", "dm_close", KEEP),
        ("high_price", "dm_high", KEEP),
        ("low_price", "dm_low", KEEP),
        ("volume", "dm_vol", KEEP),
    ],
    "holding_history": [
        ("originating_trade_id", "hh_h_t_id", KEEP),
        ("trade_id", "hh_t_id", KEEP),
        ("qty_before", "hh_before_qty", KEEP),
        ("qty_after", "hh_after_qty", KEEP),
    ],
    "watch_history": [
        ("customer_id", "w_c_id", KEEP),
        ("security_symbol", "w_s_symb", UPPER),
        ("event_ts", "w_dts", KEEP),
        ("watch_action", "w_action", UPPER),
    ],
    "trade": [
        ("trade_id", "t_id", KEEP),
        ("trade_timestamp", "t_dts", KEEP),
        ("status_id", "t_st_id", UPPER),
        ("trade_type_id", "t_tt_id", UPPER),
        ("is_cash", "t_is_cash", KEEP),
        ("symbol", "t_s_symb", UPPER),
        ("quantity", "t_qty", KEEP),
        ("bid_price", "t_bid_price", KEEP),
        ("customer_account_id", "t_ca_id", KEEP),
        ("execution_name", "t_exec_name", TRIM),
        ("trade_price", "t_trade_price", KEEP),
        ("charge", "t_chrg", KEEP),
        ("commission", "t_comm", KEEP),
        ("tax", "t_tax", KEEP),
        ("cdc_flag", "_cdc_flag", UPPER),
    ],
    "finwire_cmp": [
        ("posting_ts", "pts", KEEP),
        ("company_name", "companyname", TRIM),
        ("cik", "cik", TRIM),
        ("status", "status", UPPER),
        ("industry_id", "industryid", UPPER),
        ("sp_rating", "sprating", UPPER),
        ("founding_date", "foundingdate", KEEP),
        ("address_line1", "addrline1", TRIM),
        ("address_line2", "addrline2", TRIM),
        ("postal_code", "postalcode", TRIM),
        ("city", "city", TRIM),
        ("state_province", "stateprovince", TRIM),
        ("country", "country", TRIM),
        ("ceo_name", "ceoname", TRIM),
        ("description", "description", TRIM),
    ],
    "finwire_sec": [
        ("posting_ts", "pts", KEEP),
        ("security_symbol", "symbol", UPPER),
        ("issue_type", "issuetype", UPPER),
        ("status", "status", UPPER),
        ("security_name", "name", TRIM),
        ("exchange_id", "exid", UPPER),
        ("shares_outstanding", "shout", KEEP),
        ("first_trade_date", "firsttradedate", KEEP),
        ("first_trade_exchange_date", "firsttradeexchg", KEEP),
        ("dividend", "dividend", KEEP),
        ("company_name", "coname", TRIM),
        ("company_cik", "cocik", TRIM),
    ],
    "finwire_fin": [
        ("posting_ts", "pts", KEEP),
        ("year", "year", KEEP),
        ("quarter", "quarter", KEEP),
        ("qtr_start_date", "qtrstartdate", KEEP),
        ("posting_date", "postingdate", KEEP),
        ("revenue", "revenue", KEEP),
        ("earnings", "earnings", KEEP),
        ("eps", "eps", KEEP),
        ("diluted_eps", "dilutedeps", KEEP),
        ("margin", "margin", KEEP),
        ("inventory", "inventory", KEEP),
        ("assets", "assets", KEEP),
        ("liabilities", "liabilities", KEEP),
        ("shares_outstanding", "shout", KEEP),
        ("diluted_shares_outstanding", "dilutedshout", KEEP),
        ("company_name", "coname", TRIM),
        ("company_cik", "cocik", TRIM),
    ],
    "account": [
        ("account_id", "ca_id", KEEP),
        ("broker_id", "ca_b_id", KEEP),
        ("customer_id", "ca_c_id", KEEP),
        ("account_name", "ca_name", TRIM),
        ("tax_status", "ca_tax_st", KEEP),
    ],
    "customer": [
        ("customer_id", "c_id", KEEP),
        ("tax_id", "c_tax_id", TRIM),
        ("last_name", "c_l_name", TRIM),
        ("first_name", "c_f_name", TRIM),
        ("middle_name", "c_m_name", UPPER),
        ("gender", "c_gndr", UPPER),
        ("tier", "c_tier", KEEP),
        ("date_of_birth", "c_dob", KEEP),
        ("address_line1", "c_adline1", TRIM),
        ("address_line2", "c_adline2", TRIM),
        ("postal_code", "c_zipcode", TRIM),
        ("city", "c_city", TRIM),
        ("state_province", "c_state_prov", TRIM),
        ("country", "c_ctry", TRIM),
        ("primary_email", "c_prim_email", TRIM),
        ("alternate_email", "c_alt_email", TRIM),
        ("local_tax_rate_id", "c_lcl_tx_id", UPPER),
        ("national_tax_rate_id", "c_nat_tx_id", UPPER),
        *((f"phone{n}_{name}", f"c_{part}_{n}", TRIM) for n in (1, 2, 3) for name, part in PHONE),
    ],
}
ENVELOPE = ["_batch_id", "_row_hash", "_loaded_at"]
CHANGES = ["_cdc_flag", "_cdc_dsn"]


def cleaned(df: DataFrame, source: str, *extra: str | Column, needs: list[str] = ()) -> DataFrame:
    """The model's columns and the envelope; rows without a business key go before any window sees them."""
    cols = [(F.col(column) if how == KEEP else trim_or_null(F.col(column), upper=how == UPPER)).alias(name) for name, column, how in COLUMNS[source]]
    for c in needs:
        df = df.where(F.col(c).isNotNull())
    return df.select(*cols, *ENVELOPE, *extra)


def _newest(*first: str) -> list[Column]:
    """Newest first; the content hash settles what arrived in one file."""
    return [*(down(c) for c in first), down("_loaded_at"), down("_row_hash")]


def _reference(source: str, key: str, needs: str):
    def build(bronze: Bronze) -> DataFrame:
        rows = cleaned(bronze[source], source, needs=[needs])
        if source == "trade_type":
            rows = rows.withColumns({c: F.col(c) == 1 for c in ("is_sell_flag", "is_market_flag")})
        return dedup_latest(rows, [key], _newest()).drop("_row_hash")

    return build


def _packed(rows: DataFrame) -> DataFrame:
    """The content hash as half its size, for a shuffle; ``unpacked`` gives it back."""
    return rows.withColumns(packed(F.col("_row_hash"))).drop("_row_hash")


def _hash_down() -> list[Column]:
    """``down("_row_hash")`` of packed rows."""
    return [down("_text"), down("_packed")]


def _log(source: str, *needs: str):
    def build(bronze: Bronze) -> DataFrame:
        rows = cleaned(bronze[source], source, *CHANGES, needs=list(needs))
        kept = dedup_latest(_packed(rows), ["_packed", "_text"], [down("_batch_id"), down("_cdc_dsn"), down("_loaded_at")])
        return kept.withColumn("_row_hash", unpacked()).select(*rows.columns)

    return build


def prospect(bronze: Bronze) -> DataFrame:
    return dedup_latest(cleaned(bronze["prospect"], "prospect", needs=["agencyid"]), ["agency_id"], _newest("_batch_id"))


def trade(bronze: Bronze) -> DataFrame:
    rows = cleaned(bronze["trade"], "trade", "_cdc_dsn", needs=["t_id", "t_dts"])
    order = [down("_batch_id"), down("trade_timestamp"), down("_cdc_dsn"), down("_loaded_at"), *_hash_down()]
    return dedup_latest(_packed(rows), ["trade_id"], order).drop("_cdc_dsn", "_packed", "_text", "_loaded_at")


def trade_history(bronze: Bronze) -> DataFrame:
    """The first batch's lifecycle, and real status changes of later batches."""
    first = bronze["trade_history"].where("th_t_id is not null and th_dts is not null")
    first = first.select(
        F.col("th_t_id").alias("trade_id"),
        F.col("th_dts").alias("status_ts"),
        trim_or_null(F.col("th_st_id"), True).alias("status_id"),
        *ENVELOPE,
        F.lit(0).cast("bigint").alias("_cdc_dsn"),
    )
    later = bronze["trade"].where("t_id is not null and t_dts is not null and _batch_id <> 1")
    later = later.select(
        F.col("t_id").alias("trade_id"),
        F.col("t_dts").alias("status_ts"),
        trim_or_null(F.col("t_st_id"), True).alias("status_id"),
        *ENVELOPE,
        F.col("_cdc_dsn").cast("bigint").alias("_cdc_dsn"),
    )
    rows = status_transitions(first, later, ["trade_id"], [up("_batch_id"), up("status_ts"), up("_cdc_dsn"), up("_loaded_at"), up("_row_hash")], "status_id")
    rows = rows.withColumn("_source_model", F.when(F.col("origin") == "history", "bronze_trade_history").otherwise("bronze_trade")).drop("origin", "_cdc_dsn")
    kept = dedup_latest(_packed(rows), ["trade_id", "status_ts", "status_id"], [down("_loaded_at"), *_hash_down()])
    return kept.withColumn("_row_hash", unpacked()).select(*rows.columns)


def finwire_company(bronze: Bronze) -> DataFrame:
    return dedup_latest(cleaned(bronze["finwire_cmp"], "finwire_cmp", needs=["pts"]), ["cik", "posting_ts"], _newest())


def finwire_security(bronze: Bronze) -> DataFrame:
    return dedup_latest(cleaned(bronze["finwire_sec"], "finwire_sec", needs=["pts"]), ["security_symbol", "posting_ts"], _newest())


def finwire_financials(bronze: Bronze) -> DataFrame:
    """Of restatements of a company's quarter, the one posted last."""
    rows = cleaned(bronze["finwire_fin"], "finwire_fin", needs=["pts"]).withColumn("_who", F.coalesce("company_cik", "company_name"))
    return dedup_latest(rows, ["_who", "year", "quarter"], _newest("posting_ts")).drop("_who")


def _versions(flat: DataFrame, actions: DataFrame, calendar: DataFrame, key: str, tracked: list[str], sk: str) -> DataFrame:
    """Type-2 versions of an entity that comes as XML actions first and as flat changes later.

    Re-sends go by content, batch and change number. Every event is filled forward; the last event of a batch
    and day stays, if a tracked column changed. Actions are valid from their own day, changes from the batch's.
    """
    rows = flat.unionByName(actions).repartition(key).dropDuplicates([key, "_row_hash", "_batch_id", "_cdc_dsn", "action_ts"])
    plain = {key, "cdc_flag", "action_ts", "_cdc_dsn", "_batch_id", "_loaded_at", "_row_hash", "_source_table"}
    order = [up("_batch_id"), up("action_ts"), up("_cdc_dsn"), up("_loaded_at"), up("_row_hash")]
    back = [down("_batch_id"), down("action_ts"), down("_cdc_dsn"), down("_loaded_at"), down("_row_hash")]
    rows = forward_fill(rows, [key], order, [c for c in rows.columns if c not in plain])
    rows = dedup_latest(rows.withColumn("_day", F.to_date("action_ts")), [key, "_batch_id", "_day"], back).drop("_day")
    rows = changed_only(rows, [key], order, tracked)
    dated = rows.join(calendar.select(F.col("_batch_id").alias("_b"), "asofdate"), F.col("_batch_id") == F.col("_b"), "left")
    dated = dated.withColumn("valid_from_date", F.when(F.col("_source_table").like("%mgmt%"), F.to_date("action_ts")).otherwise(F.col("asofdate"))).drop("_b", "asofdate")
    closed = close_intervals(dated, [key], [up("valid_from_date"), *order])
    return closed.withColumn(sk, surrogate_key(key, "valid_from_date", "_batch_id")).drop("action_ts", "_cdc_dsn", "_loaded_at", "_row_hash")


def _entity(bronze: Bronze, flat: str, actions: str, needs: str, status: str, by_action: dict[str, str], only: list[str] | None) -> tuple[DataFrame, DataFrame]:
    action = trim_or_null(F.col("actiontype"), True)
    a = bronze[actions].where(action.isin(*only)) if only else bronze[actions]
    told = F.lit(None).cast("string")
    for name, value in by_action.items():
        told = F.when(action == name, F.lit(value)).otherwise(told)
    none = F.lit(None).cast("timestamp_ntz").alias("action_ts")
    left = cleaned(
        bronze[flat],
        flat,
        trim_or_null(F.col(status), True).alias("status_id"),
        trim_or_null(F.col("_cdc_flag"), True).alias("cdc_flag"),
        F.col("_cdc_dsn").cast("bigint").alias("_cdc_dsn"),
        none,
        F.lit(f"bronze_{flat}").alias("_source_table"),
        needs=[needs],
    )
    right = cleaned(
        a,
        flat,
        told.alias("status_id"),
        F.when(action == "NEW", "I").otherwise("U").alias("cdc_flag"),
        F.lit(0).cast("bigint").alias("_cdc_dsn"),
        F.col("actionts").alias("action_ts"),
        F.lit(f"bronze_{actions}").alias("_source_table"),
        needs=[needs],
    )
    return left, right


CUSTOMER_TRACKED = ["status_id", "last_name", "first_name", "tier", "address_line1", "city", "state_province", "country", "primary_email"]


def account(bronze: Bronze) -> DataFrame:
    flat, actions = _entity(bronze, "account", "mgmt_account", "ca_id", "ca_st_id", {"NEW": "ACTV", "ADDACCT": "ACTV", "CLOSEACCT": "INAC"}, None)
    return _versions(flat, actions, bronze["batch_control"], "account_id", ["status_id", "account_name"], "account_version_sk")


def customer(bronze: Bronze) -> DataFrame:
    flat, actions = _entity(bronze, "customer", "mgmt_customer", "c_id", "c_st_id", {"NEW": "ACTV", "INACT": "INAC"}, ["NEW", "UPDCUST", "INACT"])
    return _versions(flat, actions, bronze["batch_control"], "customer_id", CUSTOMER_TRACKED, "customer_version_sk")


MODELS = {
    "silver_date": _reference("date", "date_sk", "sk_dateid"),
    "silver_time": _reference("time", "time_sk", "sk_timeid"),
    "silver_status_type": _reference("status_type", "status_id", "st_id"),
    "silver_tax_rate": _reference("tax_rate", "tax_rate_id", "tx_id"),
    "silver_industry": _reference("industry", "industry_id", "in_id"),
    "silver_trade_type": _reference("trade_type", "trade_type_id", "tt_id"),
    "silver_hr": _reference("hr", "employee_id", "employeeid"),
    "silver_cash_transaction": _log("cash_transaction", "ct_ca_id"),
    "silver_daily_market": _log("daily_market", "dm_date", "dm_s_symb"),
    "silver_holding_history": _log("holding_history", "hh_t_id"),
    "silver_watch_history": _log("watch_history", "w_c_id"),
    "silver_account": account,
    "silver_customer": customer,
    "silver_trade": trade,
    "silver_prospect": prospect,
    "silver_finwire_company": finwire_company,
    "silver_finwire_security": finwire_security,
    "silver_finwire_financials": finwire_financials,
    "silver_trade_history": trade_history,
}

