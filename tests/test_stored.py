"""Stored tables: all or nothing, steps of constant size, merges, erasure by file, streams that start again."""

import datetime as dt
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import govern, incremental, quality, scd, star, windows
from tidemark.operators.windows import up
from tidemark.sources import sinks
from tidemark.sources.store import ConcurrentCommit, Store, reingest
from tidemark.streaming import append

D = dt.date.fromisoformat


def nodes(df, name: str) -> int:
    """How often an operator stands in the physical plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(line.lstrip(" :+-*(0123456789)").startswith(name) for line in plan.split("\n"))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# ---------------------------------------------------------------- the store


def test_reingest_is_all_or_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    of = lambda n, b: spark.createDataFrame([(n, b)], "n int, b int")
    reingest(store, 1, {"x": of(1, 1), "y": of(2, 1)})
    reingest(store, 2, {"x": of(3, 2), "y": of(4, 2)})
    bad = spark.range(1).select(F.raise_error(F.lit("stopped")).cast("int").alias("n"), F.lit(2).alias("b"))
    with pytest.raises(Exception, match="stopped"):  # x is staged, y fails
        reingest(store, 2, {"x": of(30, 2), "y": bad})
    assert store.version() == 2 and rows(store.read("x"), "n") == [(1,), (3,)] and rows(store.read("y"), "n") == [(2,), (4,)]
    assert [p.split("/")[0] for p in store.clean()] == ["x", "y"] and store.clean() == []
    reingest(store, 2, {"x": of(30, 2), "y": of(40, 2)})
    assert rows(store.read("x"), "n") == [(1,), (30,)] and rows(store.read("y"), "n") == [(2,), (40,)]
    assert rows(store.read("x", version=2), "n") == [(1,), (3,)]


def test_commits_do_not_overtake_each_other(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    one = spark.range(3)
    base = store.manifest()
    a, b = store.stage("t", one), store.stage("t", one)
    store.commit(a, base=base)
    with pytest.raises(ConcurrentCommit):
        store.commit(b, base=base)
    assert store.read("t").count() == 3
    with pytest.raises(KeyError):
        store.read("other")


def test_files_are_chosen_by_their_tags(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    df = spark.range(10).withColumn("kind", F.when(F.col("id") < 3, "a b").when(F.col("id") < 9, "c=d"))
    store.commit(store.stage("t", df, by=["kind"], step=1))
    assert {f["tags"]["step"] for f in store.files("t")} == {1} and store.read("t").count() == 10
    few = store.read("t", lambda t: t["kind"].startswith("a"))
    assert rows(few, "id", "kind") == [(0, "a b"), (1, "a b"), (2, "a b")]
    assert store.read("t", lambda t: False).count() == 0


# ---------------------------------------------------------------- appends


def sent(spark, loads):
    """(load, id) pairs; business times follow the ids."""
    df = spark.createDataFrame(loads, "_loaded_at int, id int")
    return df.withColumn("ts", F.timestamp_seconds(F.col("id") * 86400 + 1_700_000_000).cast("timestamp_ntz"))


def test_steps_have_plans_of_one_size_and_read_few_files(spark, tmp_path):
    store, columns = Store(spark, str(tmp_path / "s")), ["id", "ts"]
    path, sizes = str(tmp_path / "in"), []
    for k in range(1, 7):
        sent(spark, [(k, i) for i in range(10 * k, 10 * k + 10)] + ([(k, 10 * k - 1)] if k > 1 else [])).write.mode("append").parquet(path)
        source = spark.read.parquet(path)
        todo, tags = incremental.slice_of(source, store, "t", columns, "ts")
        sizes.append((nodes(todo, "FileScan"), nodes(todo, "Exchange") + nodes(todo, "BroadcastExchange")))
        if k > 2:  # the newest load meets the files of the one before alone
            held = [f for f in store.files("t") if f["tags"]["most"] >= tags["least"]]
            assert 0 < len(held) < len(store.files("t"))
            assert f"GreaterThan(_loaded_at,{k - 1})" in todo._jdf.queryExecution().executedPlan().toString()
        assert incremental.append_step(source, store, "t", columns, "ts") == (11 if k > 1 else 10)
    assert len(set(sizes[1:])) == 1 and sizes[-1][0] == 2
    assert rows(store.read("t"), "id") == [(i,) for i in range(10, 70)] and incremental.stored_mark(store, "t") == 6
    assert incremental.append_step(spark.read.parquet(path), store, "t", columns, "ts") == 0  # nothing is newer


def test_step_on_nothing_and_with_another_schema(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert incremental.append_step(sent(spark, []), store, "t", ["id"], "ts") == 0 and store.read("t").count() == 0
    assert incremental.append_step(sent(spark, [(1, 5), (1, 5)]), store, "t", ["id"], "ts") == 2 and store.read("t").count() == 1
    with pytest.raises(incremental.SchemaChanged):
        incremental.append_step(sent(spark, [(2, 6)]).withColumn("more", F.lit(1)), store, "t", ["id"], "ts")
    for k in (2, 3):  # rows without time are met again by such rows alone
        untimed = sent(spark, [(k, 5), (k, 9), (k, 9 + k)]).withColumn("ts", F.when(F.col("id") == 5, F.col("ts")))
        assert incremental.append_step(untimed, store, "t", ["id"], "ts") == 3
    assert rows(store.read("t"), "id") == [(5,), (9,), (11,), (12,)]


# ---------------------------------------------------------------- versions


def changes(spark, n, seed, hot=0.5):
    r = random.Random(seed)
    out = []
    for i in range(n):
        day = r.randint(1, 28)
        out.append((None if r.random() < 0.02 else 0 if r.random() < hot else r.randint(1, 9), i, f"2024-01-{day:02d} {r.randint(0, 23):02d}:00:00" if r.random() < 0.98 else None, r.choice([None, None, "a", "b"]), r.choice([None, 1, 2])))
    return spark.createDataFrame(out, "k int, n int, ts string, status string, x int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@pytest.mark.parametrize("n_segments", [1, 5, 40])
def test_segmented_fill_equals_plain_fill(spark, n_segments):
    df = changes(spark, 400, 1).withColumns({"_segment": F.lit("mine"), "_real": F.lit(None).cast("string")})
    plain = windows.forward_fill(df, ["k"], [up("ts"), up("n")], ["status", "x"])
    cut = windows.forward_fill_segmented(df, ["k"], ["ts", "n"], ["status", "x"], incremental.segments(df, "ts", n_segments))
    key = lambda r: str(tuple(r))
    assert cut.columns == df.columns and sorted(cut.collect(), key=key) == sorted(plain.collect(), key=key)
    none = df.where("false")
    assert windows.forward_fill_segmented(none, ["k"], ["ts", "n"], ["x"], incremental.segments(none, "ts", 3)).count() == 0


def test_segments_of_a_hot_key_are_even(spark):
    df = changes(spark, 4000, 2, hot=0.6)
    sizes = [r["count"] for r in df.where("k = 0 and ts is not null").groupBy(incremental.segments(df, "ts", 16).alias("s")).count().collect()]
    assert len(sizes) >= 12 and max(sizes) <= 2.5 * sorted(sizes)[len(sizes) // 2]


def test_versions_of_a_hot_key(spark):
    df = changes(spark, 500, 3).where("k is not null")
    build = lambda **more: rows(scd.scd2(df.unionByName(df.where("n % 3 = 0")), "k", "ts", ["n"], ["status"], ["x"], **more), "k", "n", "status", "x", F.col("valid_from_date").cast("string"), F.col("valid_to_date").cast("string"), "is_current")
    text = lambda found: sorted(map(str, found))
    assert text(build(segment=incremental.segments(df, "ts", 7))) == text(build())


def test_merged_batches_equal_one_build(spark, tmp_path):
    df = changes(spark, 300, 4).where("k is not null and ts is not null")
    store = Store(spark, str(tmp_path / "s"))
    make = lambda d: scd.scd2(d, "k", "ts", ["n"], ["status"], ["x"]).select("k", "n", "status", "x", "valid_from_date", "valid_to_date", "is_current")
    for b in range(4):  # batches do not follow time: three of four bring late events
        scd.merge_batch(store, df.where(F.col("n") % 4 == b), "k", make, n_buckets=16)
    want = sorted(map(str, make(df).collect()))
    assert sorted(map(str, store.read("versions").drop("bucket").collect())) == want
    before = {f["path"] for f in store.files("versions")}
    late = spark.createDataFrame([(3, 9999, "2024-01-01 00:00:00", "z", None)], "k int, n int, ts string, status string, x int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert scd.merge_batch(store, late, "k", make, n_buckets=16) == 1  # one key, one bucket
    after = {f["path"] for f in store.files("versions")}
    assert len(before & after) >= len(before) - 2 and len(after - before) == 1
    assert sorted(map(str, store.read("versions").drop("bucket").collect())) == sorted(map(str, make(df.unionByName(late)).collect()))
    assert scd.merge_batch(store, df.where("false"), "k", make) == 0


def test_asof_merge_equals_the_interval_join(spark):
    versions = [(1, D("2020-01-10"), D("2020-01-14"), "a"), (1, D("2020-01-15"), D("2020-01-14"), "gone the same day"), (1, D("2020-01-15"), D("2020-01-17"), "b"), (1, D("2020-01-20"), None, "c"), (2, D("2020-01-01"), D("2020-01-02"), "d"), (None, D("2020-01-01"), None, "no key")]
    v = spark.createDataFrame(versions, "k int, valid_from_date date, valid_to_date date, name string")
    days = [(k, d) for k in (1, 2, 3, None) for d in [None, *[D(f"2020-01-{n:02d}") for n in range(1, 26)]]]
    ev = spark.createDataFrame([(i, *x) for i, x in enumerate(days)], "id int, k int, day date")
    want = rows(star.interval_join(ev, v, "k", F.col("day")).fillna("-", ["name"]), "id", "name")
    for segment in (None, incremental.segments(ev, "day", 4), F.month("day")):
        got = star.asof_merge(ev, v, "k", "day", ["name"], segment)
        assert got.columns == ["id", "k", "day", "name"] and rows(got.fillna("-", ["name"]), "id", "name") == want
    assert star.asof_merge(ev, v.where("false"), "k", "day", ["name"]).where("name is not null").count() == 0


def test_reasons_of_missed_keys(spark):
    v = spark.createDataFrame([("s1", 1, D("2020-01-10"), D("2020-01-12")), ("s2", 1, D("2020-01-15"), None)], "sk string, k int, valid_from_date date, valid_to_date date")
    f = spark.createDataFrame([(1, 1, D("2020-01-09")), (2, 1, D("2020-01-11")), (3, 1, D("2020-01-13")), (4, 7, D("2020-01-11")), (5, None, D("2020-01-11")), (6, 1, None), (7, 1, D("2030-01-01"))], "id int, k int, day date")
    got = star.resolve(f, star.Lookup(v, "sk", {"k": "k"}, "v_sk", day="day"), reasons=True)
    assert {r.id: r.v_sk_miss_reason for r in got.collect()} == {1: "before first version", 2: None, 3: "between versions", 4: "unknown key", 5: "no key", 6: "no key", 7: None}
    plain = star.resolve(f, star.Lookup(v, "sk", {"k": "k"}, "v_sk"), reasons=True)
    assert {r.v_sk_miss_reason for r in plain.collect()} == {None, "unknown key", "no key"}


# ---------------------------------------------------------------- one pass


def test_fan_out_reads_its_input_once(spark, tmp_path):
    spark.range(100).select("id", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("z"), F.lit(None)), (F.col("id") % 4 + 1).cast("int")).alias("kind")).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    assert sinks.fan_out(df, str(tmp_path / "out"), "kind", ["a", "b", "empty"]) == {"a": 25, "b": 25, "empty": 0, "other": 50}
    assert {n: sinks.read_target(spark, str(tmp_path / "out"), n, df.schema).count() for n in ("a", "b", "empty", "other")} == {"a": 25, "b": 25, "empty": 0, "other": 50}
    assert rows(sinks.read_target(spark, str(tmp_path / "out"), "a", df.schema), "kind") == [("a",)] * 25


def test_row_tests_share_a_scan(spark, tmp_path):
    df = spark.createDataFrame([(1, "A", 5.0), (2, None, -1.0), (3, "X", None), (4, "X", 99.0)], "id int, flag string, q double")
    df.write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    tests = [quality.null_test("flag"), quality.values_test("flag", ["A"]), quality.range_test("q", 0.0, 10.0), quality.true_test("q_known", F.col("q") > 0, "warn"), quality.null_test("id")]
    want = {"not_null_flag": (1, "fail"), "accepted_values_flag": (2, "warn"), "range_q": (2, "warn"), "q_known": (2, "warn"), "not_null_id": (0, "pass")}
    log = quality.row_test_results(df, "r", "m", tests)
    assert nodes(log, "FileScan") == 1 and {r.test: (r.failures, r.status) for r in log.collect()} == want
    kept = quality.run_row_tests(df, "r", "m", tests, str(tmp_path / "failures"))
    assert {r.test: (r.failures, r.status) for r in kept.collect()} == want
    of = lambda n: [r.id for r in quality.read_failures(spark, str(tmp_path / "failures"), n, df.schema).orderBy("id").collect()]
    assert (of("not_null_flag"), of("accepted_values_flag"), of("range_q"), of("q_known"), of("not_null_id")) == ([2], [3, 4], [2, 4], [2, 3], [])


# ---------------------------------------------------------------- erasure


def test_erasure_writes_few_files_again(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    people = spark.range(100).select(F.col("id").alias("k"), F.concat(F.lit("name "), "id").alias("name"))
    orders = people.select("k", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"), F.lit("note").alias("note")).unionByName(spark.createDataFrame([(None, 9, "no one")], "k long, n int, note string"))
    store.commit(store.stage("people", people.repartitionByRange(6, "k"), layer="a"), store.stage("orders", orders.repartitionByRange(6, "k"), layer="b"))
    digest = lambda: {f["path"]: hashlib.sha256(open(f"{tmp_path}/s/{f['path']}", "rb").read()).hexdigest() for t in ("people", "orders") for f in store.files(t)}
    before = digest()
    layers = [govern.Personal("people", "k", ("name",)), govern.Personal("orders", "k", ("note",))]
    subjects = spark.createDataFrame([(3,), (4,), (4,), (None,), (777,)], "who long")
    written = govern.erase_in_place(store, subjects, "who", layers, "r1")
    after = digest()
    assert all(0 < n <= 2 for n in written.values())
    kept = before.keys() & after.keys()
    assert len(kept) == len(before) - sum(written.values()) and all(before[k] == after[k] for k in kept)
    assert rows(store.read("people").where("name is null"), "k") == [(3,), (4,)] and store.read("people").count() == 100
    assert store.read("orders").where("note is null").count() == 6 and store.read("orders").count() == 301
    assert {(r.layer, r.subject): r.rows_erased for r in store.read("erasure_log").collect()} == {(t, k): n for t, n in (("people", 1), ("orders", 3)) for k in (3, 4)} | {(t, 777): 0 for t in ("people", "orders")}
    gone = govern.forget(store)
    assert set(gone) == before.keys() - after.keys() and not any(os.path.exists(f"{tmp_path}/s/{p}") for p in gone)
    assert store.read("people").count() == 100
    assert govern.erase_in_place(store, spark.createDataFrame([(555,)], "who long"), "who", layers, "r2") == {"people": 0, "orders": 0}


# ---------------------------------------------------------------- streams


def test_late_and_resent_rows_are_evidence(spark, tmp_path):
    store, source = Store(spark, str(tmp_path / "s")), str(tmp_path / "in")
    schema = "id int, ts timestamp_ntz"

    def arrive(*pairs):
        spark.createDataFrame([(i, t) for i, t in pairs], "id int, t string").selectExpr("id", "cast(t as timestamp_ntz) as ts").coalesce(1).write.mode("append").parquet(source)
        stream = append.read_events(spark, source, spark.createDataFrame([], schema).schema)
        append.append_with_late(stream, "ts", ["id", "ts"], dt.timedelta(days=2), store, str(tmp_path / "cp")).awaitTermination()

    arrive((1, "2024-01-01"), (2, "2024-01-05"), (2, "2024-01-05"), (3, None))
    arrive((4, "2024-01-03"), (5, "2024-01-02"), (2, "2024-01-05"), (3, None))  # 4 is just in time, 5 is late
    arrive((6, "2024-01-09"), (7, "2024-01-03"))  # the mark is that of the rows before, so 7 is in time
    arrive((8, "2024-01-06"))
    assert rows(store.read("events"), "id") == [(1,), (2,), (3,), (4,), (6,), (7,)]
    assert rows(store.read("evidence"), "id", "outcome") == [(2, "resent"), (2, "resent"), (3, "resent"), (5, "late"), (8, "late")]


def test_stream_that_starts_again_does_not_read_its_target(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        spark.range(10 * k, 10 * k + 15).write.mode("append").parquet(source)  # five of each are sent again
        query = append.append_new(append.read_events(spark, source, spark.range(1).schema), target, ["id"], str(tmp_path / "cp"))
        query.awaitTermination()
        assert query.lastProgress["numInputRows"] == 15 and query.lastProgress["stateOperators"][0]["operatorName"] == "dedupe"
    assert rows(spark.read.parquet(target), "id") == [(i,) for i in range(35)]


# ---------------------------------------------------------------- layers


def test_gold_reads_written_silver(spark, tmp_path):
    from tests_data import write_batches

    from tidemark.plans import gold, warehouse
    from test_warehouse import NAMES

    os.makedirs(tmp_path / "in")
    write_batches(tmp_path / "in")
    bronze = warehouse.read_bronze(spark, str(tmp_path / "in"), NAMES, F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"))
    for name, build in gold.MODELS.items():  # what is declared is what the builders ask for
        asked, get = set(), warehouse.models(bronze)
        build(lambda n: (asked.add(n), get(n))[1])
        assert asked == set(gold.READS[name]), name
    parents = warehouse.silver_parents(["fact_trade"])
    assert {"silver_trade", "silver_account", "silver_customer"} <= set(parents) and "silver_prospect" not in parents
    built = warehouse.build(bronze, ["fact_trade"], str(tmp_path / "silver"))
    df = built("fact_trade")
    assert set(os.listdir(tmp_path / "silver")) == set(parents)
    assert all(f"{tmp_path}/silver" in p for p in df.inputFiles()) and sorted(map(str, df.collect())) == sorted(map(str, warehouse.models(bronze)("fact_trade").collect()))
