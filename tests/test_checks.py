"""Declared tests of models find planted faults, in two passes over a model."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import checks, gold, silver


def test_every_model_is_declared():
    assert set(checks.TESTS) == {*silver.MODELS, *gold.MODELS}
    parents = {p for t in checks.TESTS.values() for p, _ in t.references.values()}
    assert parents <= set(checks.TESTS) and {n for n, _ in checks.IN_TOTAL.values()} <= set(silver.MODELS) and set(gold.MODELS) == set(checks.IN_TOTAL)
    assert sorted(n for layer in gold.LAYERS for n in layer) == sorted(gold.MODELS)


def results(tables, name):
    return {r.test: (r.failures, r.status) for r in checks.model_results(tables.__getitem__, name, "r").collect()}


def test_faults_of_a_silver_model(spark):
    hr = spark.createDataFrame([(1, None), (2, 1), (2, 9), (None, 1)], "employee_id int, manager_id int")
    assert results({"silver_hr": hr}, "silver_hr") == {"not_null_employee_id": (1, "fail"), "unique_employee_id": (1, "fail"), "relationships_manager_id": (1, "warn")}
    rates = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", 1.5), ("d", -0.1), ("e", None)], "tax_rate_id string, tax_rate double")
    assert results({"silver_tax_rate": rates}, "silver_tax_rate")["range_tax_rate"] == (2, "fail")
    fin = spark.createDataFrame([("1", None, 2000, 1, "h1"), (None, "1", 2000, 1, "h2"), (None, None, 2000, 2, "h3"), (None, None, 2000, 2, "h3")], "company_cik string, company_name string, year int, quarter int, _row_hash string").withColumn("posting_ts", F.lit(1))
    got = results({"silver_finwire_financials": fin, "silver_finwire_company": spark.createDataFrame([("7",)], "cik string")}, "silver_finwire_financials")
    assert got["unique_together"] == (2, "fail")  # NULL is a value in keys of several columns
    assert got["company_is_named"] == (2, "fail") and got["unique__row_hash"] == (1, "fail") and got["relationships_company_cik"] == (1, "warn")


@pytest.fixture()
def market(spark):
    fact = spark.createDataFrame([("f1", "s1", 1), ("f2", "s1", 1), ("f2", "sX", 7), (None, None, None)], "market_history_sk string, security_sk string, market_date_sk int")
    return {"fact_market_history": fact, "dim_security": spark.createDataFrame([("s1",), ("s1",), ("-1",)], "security_sk string"), "dim_date": spark.createDataFrame([(1,), (-1,)], "date_sk int")}


def test_faults_of_a_fact(market):
    assert results(market, "fact_market_history") == {
        "not_null_market_history_sk": (1, "fail"), "not_null_security_sk": (1, "fail"), "not_null_market_date_sk": (1, "fail"), "relationships_security_sk": (1, "warn"), "relationships_market_date_sk": (1, "warn"),
        "unique_market_history_sk": (1, "fail"), "unique_together": (1, "fail"),
    }


def test_a_model_without_rows_passes(market):
    market["fact_market_history"] = market["fact_market_history"].where("false")
    assert {x for x, _ in results(market, "fact_market_history").values()} == {0}
