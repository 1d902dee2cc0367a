import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import govern, incremental, quality, reconcile, scd, star, windows
from tidemark.operators.windows import down, up

D = lambda s: dt.date.fromisoformat(s)


def changes(spark, rows):
    df = spark.createDataFrame(rows, "k int, ts string, n int, status string, name string, tier int")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def build(spark, rows, tracked=("status", "name", "tier"), carried=()):
    return scd.scd2(changes(spark, rows), "k", "ts", ["n"], list(tracked), list(carried)).orderBy("k", "valid_from_date", "n").collect()


def test_fill_runs_before_collapse(spark):
    (v,) = build(spark, [(1, "2020-01-01 08:00:00", 1, None, "Ann", None), (1, "2020-01-01 09:00:00", 2, None, None, 3)])
    assert (v.name, v.tier, v.is_current, v.valid_to_date) == ("Ann", 3, True, D("9999-12-31"))


def test_changes_of_carried_columns_make_no_version(spark):
    rows = [(1, "2020-01-01", 1, "ACTV", "a", 1), (1, "2020-01-02", 2, "ACTV", "a", 2), (1, "2020-01-03", 3, "INAC", "a", 2), (1, "2020-01-04", 4, "ACTV", "a", 2)]
    v = build(spark, rows, tracked=["status"], carried=["name", "tier"])
    assert [(r.status, str(r.valid_from_date), str(r.valid_to_date), r.is_current) for r in v] == [("ACTV", "2020-01-01", "2020-01-02", False), ("INAC", "2020-01-03", "2020-01-03", False), ("ACTV", "2020-01-04", "9999-12-31", True)]


def test_resent_and_null_status(spark):
    rows = [(1, "2020-01-01", 1, None, "a", 1)] * 2 + [(1, "2020-01-02", 2, None, "a", 1)]
    assert len(build(spark, rows)) == 1
    assert build(spark, []) == []


def test_as_of_boundaries(spark):
    v = scd.scd2(changes(spark, [(1, "2020-01-10", 1, "A", None, None), (1, "2020-01-20", 2, "B", None, None)]), "k", "ts", ["n"], ["status"])
    state = lambda d: [r.status for r in scd.as_of(v, F.lit(d).cast("date"), "k").collect()]
    assert [state(d) for d in ("2020-01-09", "2020-01-10", "2020-01-19", "2020-01-20", "2099-01-01")] == [[], ["A"], ["A"], ["B"], ["B"]]
    ev = spark.createDataFrame([(1, D("2020-01-09")), (1, D("2020-01-19")), (2, D("2020-01-20"))], "k int, day date")
    got = star.interval_join(ev, v.select("k", "status", "valid_from_date", "valid_to_date"), "k", F.col("day")).orderBy("k", "day").collect()
    assert [r.status for r in got] == [None, "A", None]
    look = star.Lookup(v, "sk", {"k": "k"}, "version_sk", day="day")
    assert sorted(r.version_sk == "-1" for r in star.resolve(ev, look).collect()) == [False, True, True]


def test_latest_state_orders_by_batch_first(spark):
    df = spark.createDataFrame([(1, 1, "2020-02-01", "new"), (1, 2, "2020-01-01", "late")], "k int, b int, ts string, v string")
    assert [r.v for r in windows.dedup_latest(df, ["k"], [down("b"), down("ts")]).collect()] == ["late"]


def test_reference_join_does_not_fan_out(spark):
    dim = spark.createDataFrame([("1", "Acme", "s1"), ("2", "Acme", "s2"), ("3", "Beta", "s3")], "cik string, cname string, sk string")
    rows = spark.createDataFrame([(1, "3", None), (2, None, "Acme"), (3, None, "None Ltd"), (4, None, None)], "id int, i string, n string")
    got = star.reference_join(rows, dim, "i", "n", "sk", "cik", "cname", [up("cik")]).orderBy("id").collect()
    assert [(r.id, r.sk) for r in got] == [(1, "s3"), (2, "s1"), (3, "-1"), (4, "-1")]


def test_unknown_member(spark):
    dim = star.dimension(spark.createDataFrame([(5, "x")], "nk int, name string"), "sk", ["nk"], ["nk", "name"], {"nk": -1, "name": "Unknown"})
    assert [(r.sk, r.nk, r.name) for r in dim.where("sk = '-1'").collect()] == [("-1", -1, "Unknown")] and dim.count() == 2


def test_status_transitions_and_machine(spark):
    first = spark.createDataFrame([(1, 1, "SBMT"), (1, 2, "SBMT")], "k int, n int, s string")
    later = spark.createDataFrame([(1, 3, "SBMT"), (1, 4, "SBMT"), (1, 5, "CMPT"), (1, 6, "PNDG")], "k int, n int, s string")
    rows = scd.status_transitions(first, later, ["k"], [up("n")], "s")
    assert sorted((r.n, r.origin) for r in rows.collect()) == [(1, "history"), (2, "history"), (3, "state"), (5, "state"), (6, "state")]
    allowed = spark.createDataFrame([("SBMT", "CMPT")], "previous string, current string")
    assert [(r.previous, r.current) for r in scd.transitions_not_allowed(later, ["k"], [up("n")], "s", allowed).collect()] == [("CMPT", "PNDG")]


def test_reconciliation_thresholds(spark):
    df = spark.createDataFrame([("zero", 0, 0), ("nothing", 0, 5), ("at", 100, 80), ("above", 100, 79), ("missing", 10, 0)], "id string, expected long, actual long")
    assert {r.id: r.status for r in reconcile.judged(df, 20.0).collect()} == {"zero": "PASS", "nothing": "WARNING", "at": "PASS", "above": "WARNING", "missing": "WARNING"}
    assert {r.id: r.status for r in reconcile.judged(df, 20.0, strict=False).collect()}["nothing"] == "PASS"


def test_masking_and_classification(spark):
    df = govern.classify(spark.createDataFrame([("Ann", D("2000-01-01"), 5, None)], "name string, born date, n int, other string"), {"name": "restricted", "born": "restricted", "n": "restricted", "other": "restricted"})
    assert tuple(govern.mask(df, "analyst").first()) == ("***MASKED***", None, None, None)
    assert tuple(govern.mask(df, "custodian").first()) == ("Ann", D("2000-01-01"), 5, None)
    assert govern.visible(df, "internal").columns == [] and govern.column_levels(df, "t").count() == 4
    with pytest.raises(govern.UnclassifiedColumn):
        govern.mask(df.withColumn("x", F.lit(1)), "analyst")
    govern.analyst_view(df, "analyst", "people")
    assert spark.table("people").first().name == "***MASKED***"


def test_erasure_keeps_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "d"), (None, "e")], "id int, name string")
    gone = govern.erase(df, spark.createDataFrame([(1,), (1,)], "id int"), "id", ["name"])
    assert sorted((r.id or 0, r.name or "") for r in gone.collect()) == [(0, "e"), (1, ""), (1, ""), (1, ""), (2, "d")]


def test_incremental_equals_full_refresh(spark):
    df = spark.createDataFrame([(i % 7, i // 7 % 5, i % 3) for i in range(60)], "a int, b int, _loaded_at int")
    whole = {(r.a, r.b) for r in df.collect()}
    steps = [df.where(f"_loaded_at = {k}") for k in range(3)]
    got = incremental.incremental(steps, ["a", "b"]).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(whole)
    empty = incremental.incremental([df.where("false"), df], ["a", "b"])
    assert empty.count() == len(whole)
    with pytest.raises(incremental.SchemaChanged):
        incremental.increment(df.withColumn("c", F.lit(1)), empty, ["a", "b"])


def test_data_tests_find_faults(spark):
    v = spark.createDataFrame([(1, D("2020-01-01"), D("2020-01-05"), True), (1, D("2020-01-05"), D("2020-01-07"), True), (1, D("2020-01-09"), D("9999-12-31"), False)], "k int, valid_from_date date, valid_to_date date, is_current boolean")
    assert quality.overlapping(v, "k").count() == 1 and quality.discontinuous(v, "k").count() == 2 and quality.not_one_current(v, "k").first().n_current == 2
    df = spark.createDataFrame([(1, 5.0), (2, None), (2, -1.0)], "k int, x double")
    assert quality.not_null(df, "x").count() == 1 and quality.duplicated(df, "k").first().n == 2 and quality.outside_range(df, "x", 0, 4).count() == 2
    assert quality.not_true(df, F.col("x") > 0).count() == 2 and quality.outside_values(df, "x", [5.0]).count() == 1
    log = quality.test_results("r1", "m", {"a": (df.where("false"), "error"), "b": (df, "warn")})
    assert {r.test: (r.status, r.failures) for r in log.collect()} == {"a": ("pass", 0), "b": ("warn", 3)}
    log = log.unionByName(quality.test_results("r2", "m", {"a": (df, "error")}))
    assert [(r.test, r.status) for r in quality.last_run_failures(log).collect()] == [("a", "fail")]
    assert [r.change for r in quality.test_trend(log).where("test = 'a'").orderBy("run_id").collect()] == [None, 3]


def test_failures_are_stored(spark, tmp_path):
    quality.store_failures(quality.duplicated(spark.createDataFrame([(1,), (1,)], "k int"), "k"), str(tmp_path), "unique_k")
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "unique_k")).collect()] == [(1, 2)]


def test_freshness_of_empty_table(spark):
    df = spark.createDataFrame([], "ts timestamp_ntz")
    assert quality.freshness(df, "ts", F.lit("2020-01-01").cast("timestamp_ntz"), 24, "s").first().status == "WARN"
