"""Hand-written source files of three batches, small enough to follow by eye."""

XML = """<TPCDI:Actions xmlns:TPCDI="http://www.tpc.org/tpc-di">
<TPCDI:Action ActionType="NEW" ActionTS="2007-07-07T01:02:03"><Customer C_ID="1" C_TAX_ID="t" C_GNDR="f" C_TIER="2" C_DOB="1970-01-02"><Name><C_L_NAME>Lee</C_L_NAME><C_F_NAME>Ann</C_F_NAME></Name><TaxInfo><C_LCL_TX_ID>us1</C_LCL_TX_ID></TaxInfo><Account CA_ID="10" CA_TAX_ST="1"><CA_B_ID>3</CA_B_ID><CA_NAME>Main</CA_NAME></Account></Customer></TPCDI:Action>
<TPCDI:Action ActionType="UPDACCT" ActionTS="2007-07-09T01:02:03"><Customer C_ID="1"><Account CA_ID="10"><CA_NAME>Other</CA_NAME></Account></Customer></TPCDI:Action>
<TPCDI:Action ActionType="UPDCUST" ActionTS="2007-07-10T01:02:03"><Customer C_ID="1"><Name><C_L_NAME>Li</C_L_NAME></Name></Customer></TPCDI:Action></TPCDI:Actions>"""


def wire(kind, *fields):
    return "20010203-040506" + kind + "".join(str(v).ljust(w) for v, w in fields)


def write_batches(folder):
    cmp = wire("CMP", ("Acme", 60), ("0000000081", 10), ("ACTV", 4), ("HR", 2), ("AA", 4), ("00000000", 8), ("1 Road", 80), ("", 80), ("1", 12), ("Town", 25), ("ST", 20), ("USA", 24), ("Boss", 46), ("Makes things", 150))
    sec = lambda s, who: wire("SEC", (s, 15), ("COMMON", 6), ("ACTV", 4), ("A name", 70), ("NYSE", 6), ("1000", 13), ("19990101", 8), ("19990101", 8), ("1.25", 12), (who, 10))
    fin = lambda pts, rev: pts + wire("FIN", ("2001", 4), ("1", 1), ("20170707", 8), ("20170708", 8), (rev, 17), ("5", 17), ("1.0", 12), ("1.0", 12), ("0.1", 12), ("1", 17), ("1", 17), ("1", 17), ("10", 13), ("10", 13), ("0000000081", 10))[15:]
    trade = "|{ts}|{st}|TMB|1|ABC|100|9.5|10|Ann|9.4|1|2|3"
    dates = "\n".join(f"201707{d:02}|2017-07-{d:02}|x|2017|2017|20173|Q3|20177|July|201727|W|{d % 7}|Day|2017|2017|20173|Q3|0" for d in (7, 8, 9))
    phones = "|" * 11
    customer = f"U|1|1|t||Li|Ann||F|3|1970-01-02|1 Road||1|Town|ST|USA|{phones}|a@b.example|||"
    files = {
        1: {
            "BatchDate.txt": "2017-07-07", "Date.txt": dates, "Time.txt": "36000|10:00:00|10|x|0|x|0|x|1|1\n0|00:00:00|0|x|0|x|0|x|0|0", "StatusType.txt": "ACTV|Active\nSBMT|Submitted\nCMPT|Completed", "TaxRate.txt": "US1|A rate|0.12345",
            "Industry.txt": "HR|Hotels|CG", "TradeType.txt": "TMB|Market Buy|0|1", "HR.csv": "3,,Eve,Broker,x,314,Branch,,555", "Prospect.csv": "P1,Lee,Ann,x,f,1 Road,,1,Town,ST,USA,5,100,1,0,M,40,700,O,Firm,2,1000",
            "Trade.txt": "1" + trade.format(ts="2017-07-07 10:00:00", st="SBMT") + "\n2|1999-01-01 10:00:00|CMPT|TMB|0|NOPE|1|1|99|x|1|1|1|1", "TradeHistory.txt": "1|2017-07-07 10:00:00|SBMT",
            "HoldingHistory.txt": "1|1|0|100\n9|9|0|1", "WatchHistory.txt": "1|ABC|2017-07-07 10:00:00|ACTV", "DailyMarket.txt": "2017-07-07|ABC|1.5|2|1|10", "CashTransaction.txt": "10|2017-07-07 10:00:00|12.50|Pay",
            "FINWIRE2001Q1": "\n".join([cmp, sec("ABC", "0000000081"), sec("DEF", "Acme"), fin("20010203-040506", "10"), fin("20010209-040506", "20")]), "FINWIRE2001Q1_audit.csv": "x", "CustomerMgmt.xml": XML,
            "Batch1_audit.csv": "DataSet, BatchID , Date, Attribute , Value, DValue\nDimTrade,1,,T_RECORDS,2,",
        },
        2: {
            "BatchDate.txt": "2017-07-08", "Prospect.csv": "P1,Lee,Ann,x,f,2 Road,,1,Town,ST,USA,5,100,1,0,M,40,700,O,Firm,2,1000", "Account.txt": "U|5|10|3|1|Other|1|INAC", "Customer.txt": customer,
            "Trade.txt": "U|1|1" + trade.format(ts="2017-07-08 10:00:00", st="CMPT"), "CashTransaction.txt": "I|9|10|2017-07-07 10:00:00|12.50|Pay",
        },
        3: {"BatchDate.txt": "2017-07-09", "Trade.txt": "U|2|1" + trade.format(ts="2017-07-09 10:00:00", st="CMPT")},
    }
    for n, names in files.items():
        (folder / f"Batch{n}").mkdir(exist_ok=True)
        for name, text in names.items():
            (folder / f"Batch{n}" / name).write_text(text + "\n")
