import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import casting
from tidemark.functions.casting import Cast
from tidemark.plans import specs
from tidemark.sources import control, delimited, fixed_width, sinks, xml

TRADE = "1|2017-07-07 10:00:00|SBMT|TMB|1|ABC|100|9.5|11|Ann|9.4|1|2|3"


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_schema_shift_in_one_file(spark):
    rows = delimited.parse_lines(lines(spark, TRADE, "U|77|" + TRADE, "", "  "), specs.DELIMITED["trade"]).orderBy("_cdc_dsn").collect()
    assert [(r._cdc_flag, r._cdc_dsn, r.t_id, r.t_s_symb) for r in rows] == [("I", 0, 1, "ABC"), ("U", 77, 1, "ABC")]
    assert rows[0].t_is_cash is True and str(rows[0].t_bid_price) == "9.50"
    with pytest.raises(Exception, match="unexpected field count 15"):
        delimited.parse_lines(lines(spark, "x|" + TRADE), specs.DELIMITED["trade"]).collect()


def test_safe_casts(spark):
    df = spark.createDataFrame([("1933k-04-19", "X", "00000000", "7", "12.0"), (" ", "Y", "20010203", " 8 ", "5"), ("2017-7-8", "", "bad", "x", "6")], "d string, b string, c string, i string, n string")
    casts = [Cast("d", casting.as_date), Cast("b", casting.as_bool), Cast("c", casting.as_compact_date, casting.ZEROS), Cast("i", casting.as_int), Cast("n", casting.as_int)]
    a, b, c = casting.cast_all(df, casts).collect()
    assert a.d is None and a.b is False and a.c is None and a.i == 7 and a.n is None
    assert [e["column"] for e in json.loads(a._dq_errors)] == ["d", "n"] and json.loads(a._dq_errors)[0]["raw_value"] == "1933k-04-19"
    assert b.d is None and b.b is True and b.c == dt.date(2001, 2, 3) and b.i == 8 and b._dq_errors is None
    assert c.d == dt.date(2017, 7, 8) and c.b is None and [e["column"] for e in json.loads(c._dq_errors)] == ["c", "i"]


def test_quoted_comma_file_with_names(spark, tmp_path):
    (tmp_path / "HR.csv").write_text('1,2,Ann,"O, Neil",x,314,B,O1,555\n\n')
    (tmp_path / "HR_audit.csv").write_text("1,2\n")
    rows = delimited.read_delimited(spark, str(tmp_path / "HR*"), specs.DELIMITED["hr"]).collect()
    assert [(r.employeeid, r.employeelastname, r._source_file) for r in rows] == [(1, "O, Neil", "HR.csv")]


def wire(kind, *fields):
    return "20010203-040506" + kind + "".join(str(v).ljust(w) for v, w in fields)


def test_fixed_width_records(spark):
    sec = wire("SEC", ("ABC", 15), ("COMMON", 6), ("ACTV", 4), ("A name", 70), ("NYSE", 6), ("1000", 13), ("19990101", 8), ("00000000", 8), ("1.25", 12), ("0000000081", 10))
    named = sec[:-10] + "Acme Corp"
    blank = sec[:-10] + "   "
    df = fixed_width.checked(lines(spark, sec, named, blank, wire("CMP", ("Acme", 60))), list(specs.WIRE.values()))
    rows = fixed_width.split_reference(fixed_width.parse_records(df, specs.WIRE["finwire_sec"]), "conameorcik", "cocik", "coname").collect()
    assert [(r.cocik, r.coname) for r in rows] == [("0000000081", None), (None, "Acme Corp"), (None, None)]
    assert rows[0].pts == dt.datetime(2001, 2, 3, 4, 5, 6) and rows[0].firsttradeexchg is None and rows[0]._dq_errors is None and rows[0].shout == 1000
    with pytest.raises(Exception, match="unknown record type"):
        fixed_width.checked(lines(spark, "20010203-040506XYZabc"), list(specs.WIRE.values())).collect()


XML = """<?xml version="1.0"?><TPCDI:Actions xmlns:TPCDI="http://www.tpc.org/tpc-di">
<TPCDI:Action ActionType="NEW" ActionTS="2007-07-07T01:02:03"><Customer C_ID="1" C_TAX_ID="t" C_GNDR="F" C_TIER="2" C_DOB="1970-01-02"><Name><C_L_NAME>Lee</C_L_NAME></Name>
<ContactInfo><C_PHONE_1><C_LOCAL>5</C_LOCAL></C_PHONE_1></ContactInfo><Account CA_ID="10" CA_TAX_ST="1"><CA_B_ID>3</CA_B_ID><CA_NAME>x</CA_NAME></Account><Account CA_ID="11" CA_TAX_ST="0"><CA_B_ID>4</CA_B_ID></Account></Customer></TPCDI:Action>
<TPCDI:Action ActionType="UPDCUST" ActionTS="2007-07-08T00:00:00"><Customer C_ID="1"><Name><C_L_NAME>Li</C_L_NAME></Name></Customer></TPCDI:Action>
<TPCDI:Action ActionType="INACT" ActionTS="2007-07-09T00:00:00"><Customer C_ID="2"/></TPCDI:Action>
<TPCDI:Action ActionType="NEW" ActionTS="2007-07-09T00:00:00"></TPCDI:Action></TPCDI:Actions>"""


def test_xml_parent_and_children(spark, tmp_path):
    (tmp_path / "CustomerMgmt.xml").write_text(XML)
    acts = xml.read_actions(spark, str(tmp_path / "CustomerMgmt.xml"))
    rows = xml.customers(acts).orderBy("actionts").collect()
    assert [(r.actiontype, r.c_id, r.c_l_name, r.c_tier) for r in rows] == [("NEW", 1, "Lee", 2), ("UPDCUST", 1, "Li", None), ("INACT", 2, None, None)]
    assert rows[0].c_local_1 == "5" and rows[0].c_local_2 is None
    assert [(r.ca_id, r.ca_b_id, r.ca_name, r.ca_c_id) for r in xml.accounts(acts).orderBy("ca_id").collect()] == [(10, 3, "x", 1), (11, 4, None, 1)]


def test_control_and_audit(spark, tmp_path):
    for n, day in ((1, "2017-07-07"), (2, " 2017-7-8\n")):
        (tmp_path / f"Batch{n}").mkdir()
        (tmp_path / f"Batch{n}" / "BatchDate.txt").write_text(day)
    rows = control.read_batch_calendar(spark, str(tmp_path / "Batch*" / "BatchDate.txt")).orderBy("_batch_id").collect()
    assert [(r._batch_id, str(r.asofdate)) for r in rows] == [(1, "2017-07-07"), (2, "2017-07-08")]
    (tmp_path / "Batch3").mkdir()
    (tmp_path / "Batch3" / "BatchDate.txt").write_text("soon")
    with pytest.raises(Exception, match="no batch date"):
        control.read_batch_calendar(spark, str(tmp_path / "Batch*" / "BatchDate.txt")).collect()
    (tmp_path / "a_audit.csv").write_text("DataSet, BatchID , Date, Attribute , Value, DValue\nDimBroker,1,,HR_BROKERS, 4293,\nDimX,x,2017-07-07,A,,1.5\n")
    a, b = control.read_audit(spark, str(tmp_path / "a_audit.csv")).collect()
    assert (a.dataset, a.batchid, a.value, a.dvalue) == ("DimBroker", 1, 4293, None) and (b.batchid, b.value, str(b.dvalue)) == (None, None, "1.50000")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (3, 2, "c")], "id int, _batch_id int, v string")
    path = str(tmp_path / "t")
    sinks.append(df, path, df.schema)
    sinks.overwrite_batches(df.where("_batch_id = 2 and id = 3"), path, df.schema)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 3]
    sinks.overwrite_batches(df.where("_batch_id = 2"), path, df.schema)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(sinks.ContractError):
        sinks.append(df.withColumn("id", F.col("id").cast("bigint")), path, df.schema)
    assert [r.id for r in sinks.unloaded_batches(df, df.where("_batch_id = 2")).collect()] == [1]
    sinks.fan_out(df, str(tmp_path / "f"), "v", ["x"])
    assert spark.read.parquet(str(tmp_path / "f")).count() == 3
    sinks.full_refresh(df.limit(1), path, df.schema)
    assert spark.read.parquet(path).count() == 1


def test_field_count_profile(spark):
    df = spark.createDataFrame([("a|b", "f"), ("U|1|a|b", "f"), ("a", "g")], "value string, _source_file string")
    assert {(r._source_file, r.n_fields, r["shape"]) for r in delimited.field_count_profile(df, 2).collect()} == {("f", 2, "base"), ("f", 4, "shifted"), ("g", 1, "unexpected")}


@pytest.mark.parametrize("prefix", ["", "TPCDI:", "x-y:"])
def test_a_large_xml_file_is_split(spark, tmp_path, prefix):
    path, n = tmp_path / "big.xml", 3000
    inner = "".join(
        f'<{prefix}Action ActionType="NEW"\n ActionTS="2007-07-07T02:56:25"><Customer C_ID="{i}" C_TAX_ID="t{i}"><Account CA_ID="{i}" CA_TAX_ST="1"><CA_B_ID>3</CA_B_ID><CA_NAME>Actions &lt;é{i}&gt;</CA_NAME></Account>'
        f'</Customer></{prefix}Action>' + "\n" * (i % 2) for i in range(n)
    )
    path.write_text(f'<?xml version="1.0" encoding="UTF-8"?>\n<{prefix}Actions note="Action">{inner}</{prefix}Actions>\n', encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        read = xml.read_actions(spark, str(path), keep_path=True)
        assert xml.row_prefix(spark, str(path)) == prefix
        rows = xml.accounts(read).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r.ca_id for r in rows) == list(range(n)) and all(r.ca_name == f"Actions <é{r.ca_id}>" and r.ca_c_id == r.ca_id for r in rows)
    assert len({r.part for r in rows}) > 5 and read.first()._path.endswith("big.xml")
    path.write_text("<Nothing/>")
    assert xml.read_actions(spark, str(path)).count() == 0
