"""What the brokerage's source files look like: columns, types and delimiters (fixed values, in file order)."""

from __future__ import annotations

from tidemark.functions import casting
from tidemark.functions.casting import Cast
from tidemark.sources.delimited import DelimitedSpec
from tidemark.sources.fixed_width import RecordSpec

MOMENT = casting.as_timestamp()
RATE = casting.as_decimal(6, 5)
PRICE = casting.as_decimal(12, 2)
AMOUNT = casting.as_decimal(15, 2)
WORTH = casting.as_decimal(12, 0)
BIG = casting.as_decimal(20, 2)
SMALL = casting.as_decimal(10, 4)

DELIMITED = {
    "date": DelimitedSpec(
        (
            Cast("sk_dateid", casting.as_int),
            Cast("datevalue", casting.as_date),
            Cast("datedesc"),
            Cast("calendaryearid", casting.as_int),
            Cast("calendaryeardesc"),
            Cast("calendarqtrid", casting.as_int),
            Cast("calendarqtrdesc"),
            Cast("calendarmonthid", casting.as_int),
            Cast("calendarmonthdesc"),
            Cast("calendarweekid", casting.as_int),
            Cast("calendarweekdesc"),
            Cast("dayofweeknum", casting.as_int),
            Cast("dayofweekdesc"),
            Cast("fiscalyearid", casting.as_int),
            Cast("fiscalyeardesc"),
            Cast("fiscalqtrid", casting.as_int),
            Cast("fiscalqtrdesc"),
            Cast("holidayflag", casting.as_bool),
        )
    ),
    "time": DelimitedSpec(
        (
            Cast("sk_timeid", casting.as_int),
            Cast("timevalue"),
            Cast("hourid", casting.as_int),
            Cast("hourdesc"),
            Cast("minuteid", casting.as_int),
            Cast("minutedesc"),
            Cast("secondid", casting.as_int),
            Cast("seconddesc"),
            Cast("markethoursflag", casting.as_bool),
            Cast("officehoursflag", casting.as_bool),
        )
    ),
    "status_type": DelimitedSpec(
        (
            Cast("st_id"),
            Cast("st_name"),
        )
    ),
    "tax_rate": DelimitedSpec(
        (
            Cast("tx_id"),
            Cast("tx_name"),
            Cast("tx_rate", RATE),
        )
    ),
    "industry": DelimitedSpec(
        (
            Cast("in_id"),
            Cast("in_name"),
            Cast("in_sc_id"),
        )
    ),
    "trade_type": DelimitedSpec(
        (
            Cast("tt_id"),
            Cast("tt_name"),
            Cast("tt_is_sell", casting.as_int),
            Cast("tt_is_mrkt", casting.as_int),
        )
    ),
    "hr": DelimitedSpec(
        (
            Cast("employeeid", casting.as_int),
            Cast("managerid", casting.as_int),
            Cast("employeefirstname"),
            Cast("employeelastname"),
            Cast("employeemi"),
            Cast("employeejobcode", casting.as_int),
            Cast("employeebranch"),
            Cast("employeeoffice"),
            Cast("employeephone"),
        ),
        delimiter=",",
    ),
    "prospect": DelimitedSpec(
        (
            Cast("agencyid"),
            Cast("lastname"),
            Cast("firstname"),
            Cast("middleinitial"),
            Cast("gender"),
            Cast("addressline1"),
            Cast("addressline2"),
            Cast("postalcode"),
            Cast("city"),
            Cast("state"),
            Cast("country"),
            Cast("phone"),
            Cast("income", casting.as_int),
            Cast("numbercars", casting.as_int),
            Cast("numberchildren", casting.as_int),
            Cast("maritalstatus"),
            Cast("age", casting.as_int),
            Cast("creditrating", casting.as_int),
            Cast("ownorrentflag"),
            Cast("employer"),
            Cast("numbercreditcards", casting.as_int),
            Cast("networth", WORTH),
        ),
        delimiter=",",
    ),
    "account": DelimitedSpec(
        (
            Cast("ca_id", casting.as_long),
            Cast("ca_b_id", casting.as_long),
            Cast("ca_c_id", casting.as_long),
            Cast("ca_name"),
            Cast("ca_tax_st", casting.as_int),
            Cast("ca_st_id"),
        ),
        changes=True,
    ),
    "customer": DelimitedSpec(
        (
            Cast("c_id", casting.as_long),
            Cast("c_tax_id"),
            Cast("c_st_id"),
            Cast("c_l_name"),
            Cast("c_f_name"),
            Cast("c_m_name"),
            Cast("c_gndr"),
            Cast("c_tier", casting.as_int),
            Cast("c_dob", casting.as_date),
            Cast("c_adline1"),
            Cast("c_adline2"),
            Cast("c_zipcode"),
            Cast("c_city"),
            Cast("c_state_prov"),
            Cast("c_ctry"),
            *(Cast(f"c_{part}_{n}") for n in (1, 2, 3) for part in ("ctry", "area", "local", "ext")),
            Cast("c_prim_email"),
            Cast("c_alt_email"),
            Cast("c_lcl_tx_id"),
            Cast("c_nat_tx_id"),
        ),
        changes=True,
    ),
    "trade": DelimitedSpec(
        (
            Cast("t_id", casting.as_long),
            Cast("t_dts", MOMENT),
            Cast("t_st_id"),
            Cast("t_tt_id"),
            Cast("t_is_cash", casting.as_bool),
            Cast("t_s_symb"),
            Cast("t_qty", casting.as_int),
            Cast("t_bid_price", PRICE),
            Cast("t_ca_id", casting.as_long),
            Cast("t_exec_name"),
            Cast("t_trade_price", PRICE),
            Cast("t_chrg", PRICE),
            Cast("t_comm", PRICE),
            Cast("t_tax", PRICE),
        ),
        changes=True,
    ),
    "holding_history": DelimitedSpec(
        (
            Cast("hh_h_t_id", casting.as_long),
            Cast("hh_t_id", casting.as_long),
            Cast("hh_before_qty", casting.as_int),
            Cast("hh_after_qty", casting.as_int),
        ),
        changes=True,
    ),
    "watch_history": DelimitedSpec(
        (
            Cast("w_c_id", casting.as_long),
            Cast("w_s_symb"),
            Cast("w_dts", MOMENT),
            Cast("w_action"),
        ),
        changes=True,
    ),
    "daily_market": DelimitedSpec(
        (
            Cast("dm_date", casting.as_date),
            Cast("dm_s_symb"),
            Cast("dm_close", casting.as_double),
            Cast("dm_high", casting.as_double),
            Cast("dm_low", casting.as_double),
            Cast("dm_vol", casting.as_long),
        ),
        changes=True,
    ),
    "cash_transaction": DelimitedSpec(
        (
            Cast("ct_ca_id", casting.as_long),
            Cast("ct_dts", MOMENT),
            Cast("ct_amt", AMOUNT),
            Cast("ct_name"),
        ),
        changes=True,
    ),
    "trade_history": DelimitedSpec(
        (
            Cast("th_t_id", casting.as_long),
            Cast("th_dts", MOMENT),
            Cast("th_st_id"),
        )
    ),
}

WIRE = {
    "finwire_cmp": RecordSpec(
        "CMP",
        (
            (Cast("companyname"), 60),
            (Cast("cik"), 10),
            (Cast("status"), 4),
            (Cast("industryid"), 2),
            (Cast("sprating"), 4),
            (Cast("foundingdate", casting.as_compact_date, casting.ZEROS), 8),
            (Cast("addrline1"), 80),
            (Cast("addrline2"), 80),
            (Cast("postalcode"), 12),
            (Cast("city"), 25),
            (Cast("stateprovince"), 20),
            (Cast("country"), 24),
            (Cast("ceoname"), 46),
            (Cast("description"), 150),
        ),
    ),
    "finwire_sec": RecordSpec(
        "SEC",
        (
            (Cast("symbol"), 15),
            (Cast("issuetype"), 6),
            (Cast("status"), 4),
            (Cast("name"), 70),
            (Cast("exid"), 6),
            (Cast("shout", casting.as_long), 13),
            (Cast("firsttradedate", casting.as_compact_date, casting.ZEROS), 8),
            (Cast("firsttradeexchg", casting.as_compact_date, casting.ZEROS), 8),
            (Cast("dividend", SMALL), 12),
        ),
        rest="conameorcik",
    ),
    "finwire_fin": RecordSpec(
        "FIN",
        (
            (Cast("year", casting.as_int), 4),
            (Cast("quarter", casting.as_int), 1),
            (Cast("qtrstartdate", casting.as_compact_date, casting.ZEROS), 8),
            (Cast("postingdate", casting.as_compact_date, casting.ZEROS), 8),
            (Cast("revenue", BIG), 17),
            (Cast("earnings", BIG), 17),
            (Cast("eps", SMALL), 12),
            (Cast("dilutedeps", SMALL), 12),
            (Cast("margin", SMALL), 12),
            (Cast("inventory", BIG), 17),
            (Cast("assets", BIG), 17),
            (Cast("liabilities", BIG), 17),
            (Cast("shout", casting.as_long), 13),
            (Cast("dilutedshout", casting.as_long), 13),
        ),
        rest="conameorcik",
    ),
}
