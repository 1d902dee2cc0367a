"""Batches of files into stored bronze tables: whole, once, replaced by force, with evidence."""

import pytest
from pyspark.sql import functions as F
from tests_data import write_batches  # beside this file

from tidemark.plans import ingest, warehouse
from tidemark.sources.store import Store

HEADER = "DataSet, BatchID , Date, Attribute , Value, DValue\n"
AT = "2024-03-01 00:00:00"


def at():
    return F.lit(AT).cast("timestamp_ntz")


@pytest.fixture()
def files(tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    write_batches(root)
    (root / "Batch1" / "Batch1_audit.csv").unlink()
    (root / "Batch1" / "Trade_audit.csv").write_text(HEADER + "Trade,1,,T_RECORDS,2,\n")
    (root / "Batch1" / "FINWIRE2001Q1_audit.csv").write_text(HEADER + "FINWIRE2001Q1,1,,FW_CMP,1,\nFINWIRE2001Q1,1,,FW_SEC,2,\nFINWIRE2001Q1,1,,FW_FIN,2,\nFINWIRE2001Q1,1,,FW_LOW,-3,\n")
    (root / "Batch1" / "Nothing_audit.csv").write_text(HEADER + "Nothing,1,,N_RECORDS,7,\n")
    (root / "Batch2" / "Trade_audit.csv").write_text(HEADER + "Trade,2,,T_RECORDS,5,\n")
    return root


def counts(store, *tables):
    return {t: sorted((r["_batch_id"], r["count"]) for r in store.read(t).groupBy("_batch_id").count().collect()) for t in tables}


def test_batches_go_in_once_and_by_force(spark, files, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    load = lambda b, run, **more: {r.dataset: (r.expected, r.actual, r.status, r.message) for r in ingest.load_batch(store, str(files), b, at(), run, **more).collect()}
    assert load(1, "r1") == {"Trade": (2, 2, "PASS", "counts agree"), "FINWIRE2001Q1": (5, 5, "PASS", "counts agree"), "Nothing": (7, None, "WARNING", "no source loaded")}
    assert load(2, "r2") == {"Trade": (5, 1, "WARNING", "counts differ")}
    assert load(3, "r3") == {} and ingest.loaded_batches(store) == {1, 2, 3}
    assert counts(store, "trade", "account", "mgmt_account", "finwire_fin") == {"trade": [(1, 2), (2, 1), (3, 1)], "account": [(2, 1)], "mgmt_account": [(1, 2)], "finwire_fin": [(1, 2)]}
    assert {r._source_file for r in store.read("trade").collect()} == {"Trade.txt"} and {r._source_file for r in store.read("finwire_sec").collect()} == {"FINWIRE2001Q1"}
    before = store.version()
    with pytest.raises(ingest.AlreadyLoaded):
        load(2, "again")
    # The models over the store are those over the files.
    names = {n: f"Batch*/{g}" for n, g in ingest.FILES.items()}
    direct, stored = warehouse.models(warehouse.read_bronze(spark, str(files), names, at())), warehouse.models(ingest.bronze_of(store))
    for name in ("silver_account", "silver_trade", "dim_security", "fact_trade"):
        assert sorted(map(str, stored(name).collect())) == sorted(map(str, direct(name).collect()))
    # By force: other trades, and a file that is no longer sent.
    (files / "Batch2" / "Trade.txt").write_text("".join(f"U|1|{k}|2017-07-08 10:00:00|CMPT|TMB|1|ABC|100|9.5|10|Ann|9.4|1|2|3\n" for k in range(1, 6)))
    (files / "Batch2" / "Account.txt").unlink()
    assert load(2, "r4", force=True) == {"Trade": (5, 5, "PASS", "counts agree")}
    assert counts(store, "trade", "account", "prospect") == {"trade": [(1, 2), (2, 5), (3, 1)], "account": [], "prospect": [(1, 1), (2, 1)]}
    assert store.version() == before + 1 and sorted(r.run_id for r in store.read("dq_audit_log").where("dataset = 'Trade'").collect()) == ["r1", "r2", "r4"]


def test_a_bad_batch_leaves_nothing(spark, files, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ingest.load_batch(store, str(files), 1, at(), "r1")
    with (files / "Batch2" / "Trade.txt").open("a") as f:
        f.write("too|few|fields\n")
    with pytest.raises(Exception, match="unexpected field count"):
        ingest.load_batch(store, str(files), 2, at(), "r2")
    assert store.version() == 1 and ingest.loaded_batches(store) == {1} and counts(store, "trade") == {"trade": [(1, 2)]}
    (files / "Batch3" / "BatchDate.txt").unlink()
    with pytest.raises(ingest.MissingFile):
        ingest.load_batch(store, str(files), 3, at(), "r3")
    assert store.clean() and store.read("trade").count() == 2
