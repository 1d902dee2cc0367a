"""Models are written in waves and go once nothing reads them; hashes are packed for shuffles, and shuffles go as jobs end."""

import glob
import os
import time

from pyspark.sql import functions as F

from tidemark import session
from tidemark.functions.keys import packed, unpacked
from tidemark.plans import checks, gold, silver, warehouse
from tidemark.session import shuffles_freed

SMALL = "/root/testdata/sf0.001"


def test_waves_follow_what_is_read():
    order = {name: k for k, wave in enumerate(warehouse.WAVES) for name in wave}
    assert sorted(order) == sorted([*silver.MODELS, *gold.MODELS]) and sum(map(len, warehouse.WAVES)) == len(order)
    assert all(order[r] < order[n] for n, reads in gold.READS.items() for r in reads)
    referred = [(n, p) for n, t in checks.TESTS.items() for p, _ in t.references.values()] + [(n, s) for n, (s, _) in checks.IN_TOTAL.items()]
    assert all(order[p] <= order[n] for n, p in referred)


def test_walk_removes_what_nothing_reads(spark, tmp_path):
    there = {}

    def visit(wave, get):
        there.update(dict.fromkeys(wave, set(os.listdir(tmp_path))))
        assert all(get(name).count() for name in wave)

    names = ["fact_market_history", "dim_broker"]
    get = warehouse.walk(warehouse.derived_bronze(spark, SMALL), names, str(tmp_path), visit, {"dim_broker": {"silver_hr"}}, keep=["fact_market_history"])
    assert set(os.listdir(tmp_path)) == {"fact_market_history"} and get("fact_market_history").count()
    assert "silver_hr" in there["dim_broker"] and "dim_broker" not in there["dim_company"]
    assert there["fact_market_history"] == {"fact_market_history"}  # what it reads is gone before it is visited


def test_fact_of_facts_leaves_what_it_reads_itself(spark):
    df = warehouse.QUERIES["wh_fact_holding"](spark, SMALL)
    assert set(os.listdir(session._made[-1].removeprefix("file:"))) == {"silver_holding_history", "fact_trade"}
    assert sorted(map(str, df.collect())) == sorted(map(str, warehouse.models(warehouse.derived_bronze(spark, SMALL))("fact_holding").collect()))


def test_hashes_are_packed_and_come_back(spark):
    texts = ["0" * 32, "f" * 32, "0f" * 16, "F" * 32, "0" * 31, "0" * 32 + "\n", "", "h1", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumns(packed(F.col("t")))
    rows = df.select("t", "_packed", unpacked().alias("back")).collect()
    assert all(r.t == r.back for r in rows) and [r._packed is not None for r in rows] == [True] * 3 + [False] * 6


def test_shuffles_go_as_jobs_end(spark, tmp_path):
    files = lambda: set(glob.glob(f"{spark.conf.get('spark.local.dir')}/**/shuffle_*.data", recursive=True))
    before = files()
    with shuffles_freed(spark):
        df = spark.range(10_000).groupBy((F.col("id") % 7_000).alias("k")).count()
        df.write.parquet(str(tmp_path / "out"))
        assert df.count() == 7_000 and len(df.collect()) == 7_000
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(session._FREED, "false") == "false"


def test_keys_and_references_are_jobs_of_their_own_columns(spark):
    fact = spark.createDataFrame([("f1", "s1", 1), ("f2", "s2", None)], "market_history_sk string, security_sk string, market_date_sk long").withColumn("wide", F.lit("x"))
    tables = {"fact_market_history": fact, "dim_security": spark.createDataFrame([("s1",)], "security_sk string"), "dim_date": spark.createDataFrame([(1,)], "date_sk int")}
    frames = checks.result_frames(tables.__getitem__, "fact_market_history", "r")
    assert [sorted(r.test for r in f.collect()) for f in frames[1:]] == [["relationships_security_sk"], ["relationships_market_date_sk"], ["unique_market_history_sk"], ["unique_together"]]
    assert [f.first().failures for f in frames[1:]] == [1, 0, 0, 0]
    assert not any("wide" in f._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0] for f in frames)


def test_log_leaves_no_model(spark):
    assert checks.warehouse_test_log(spark, SMALL).count() == 206
    assert os.listdir(session._made[-1].removeprefix("file:")) == []


def test_reconciliation_leaves_no_model(spark):
    rows = checks.warehouse_reconciliation(spark, SMALL).collect()
    assert {r.model for r in rows} == {*checks.IN_TOTAL, *checks.BY_BATCH}
    assert os.listdir(session._made[-1].removeprefix("file:")) == []
