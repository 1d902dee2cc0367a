"""The warehouse end to end, over hand-written files of three batches."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import gold, silver, warehouse
from tidemark.sources import delimited
from tests_data import write_batches  # beside this file

NAMES = {
    "date": "Batch1/Date.txt", "time": "Batch1/Time.txt", "status_type": "Batch1/StatusType.txt", "tax_rate": "Batch1/TaxRate.txt", "industry": "Batch1/Industry.txt", "trade_type": "Batch1/TradeType.txt",
    "hr": "Batch1/HR.csv", "prospect": "Batch*/Prospect.csv", "account": "Batch*/Account.txt", "customer": "Batch*/Customer.txt", "trade": "Batch*/Trade.txt", "holding_history": "Batch*/HoldingHistory.txt",
    "watch_history": "Batch*/WatchHistory.txt", "daily_market": "Batch*/DailyMarket.txt", "cash_transaction": "Batch*/CashTransaction.txt", "trade_history": "Batch1/TradeHistory.txt", "finwire": "Batch1/FINWIRE*",
    "actions": "Batch1/CustomerMgmt.xml", "batch_control": "Batch*/BatchDate.txt", "source_audit": "Batch*/*_audit.csv",
}


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("batches")
    write_batches(folder)
    return warehouse.models(warehouse.read_bronze(spark, str(folder), NAMES, F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")))


@pytest.mark.parametrize("name", [*silver.MODELS, *gold.MODELS])
def test_every_model_builds_with_unique_keys(model, name):
    rows = model(name).collect()
    assert rows
    if name.startswith(("dim_", "fact_")):
        keys = [r[0] for r in rows]
        assert len(keys) == len(set(keys)) and None not in keys
    if name.startswith("dim_"):
        assert sum(str(k) == "-1" for k in keys) == 1
    if name.startswith("fact_"):
        assert not [c for r in rows for c, v in r.asDict().items() if c.endswith("_sk") and v is None]


def test_account_versions(model):
    rows = model("silver_account").where("account_id = 10").orderBy("valid_from_date").collect()
    assert [(r.status_id, r.account_name, str(r.valid_from_date), str(r.valid_to_date), r.is_current) for r in rows] == [
        ("ACTV", "Main", "2007-07-07", "2007-07-08", False), ("ACTV", "Other", "2007-07-09", "2017-07-07", False), ("INAC", "Other", "2017-07-08", "9999-12-31", True),
    ]
    assert all(r.broker_id == 3 for r in rows)  # filled forward


def test_customer_versions(model):
    rows = model("silver_customer").where("customer_id = 1").orderBy("valid_from_date").collect()
    assert [(r.last_name, r.tier, r.status_id, r.cdc_flag) for r in rows] == [("Lee", 2, "ACTV", "I"), ("Li", 2, "ACTV", "U"), ("Li", 3, "ACTV", "U")]


def test_trade_facts(model):
    rows = {r.trade_id: r for r in model("fact_trade").collect()}
    assert rows[1].account_sk != "-1" and rows[1].security_sk != "-1" and rows[1].trade_date_sk == 20170709 and rows[1].trade_time_sk == 36000
    assert rows[2].account_sk == "-1" and rows[2].security_sk == "-1" and rows[2].trade_date_sk == -1
    assert model("silver_trade").where("trade_id = 1").first().status_id == "CMPT"
    history = model("silver_trade_history").where("trade_id = 1").orderBy("status_ts").collect()
    assert [(r.status_id, r._source_model) for r in history] == [("SBMT", "bronze_trade_history"), ("CMPT", "bronze_trade")]
    assert model("fact_holding").count() == 1  # the holding of a missing trade drops out


def test_restated_quarter_and_companies(model):
    (fin,) = model("silver_finwire_financials").collect()
    assert str(fin.revenue) == "20.00"
    assert {r.symbol: r.company_sk == "-1" for r in model("dim_security").collect()} == {"ABC": False, "DEF": False, "UNKNOWN": True}


def test_repeated_event_is_kept_once(model):
    assert model("silver_cash_transaction").count() == 1
    assert model("silver_prospect").where("agency_id = 'P1'").first()._batch_id == 2


def test_profile_of_shapes(spark, tmp_path):
    write_batches(tmp_path)
    raw = spark.read.text(f"{tmp_path}/Batch*/Account.txt").select("value", F.lit("Account.txt").alias("_source_file"))
    assert {r["shape"] for r in delimited.field_count_profile(raw, 6).collect()} == {"shifted"}
