"""Statement files from disk to holdings."""

import pytest
from pyspark.sql import functions as F

from barloom.operators import holdings as hld
from barloom.sources.dimensions import isins
from barloom.sources.statements import rows_of, scan_statements

STATEMENT = """Client,Some Person
Branch,17
Positions on 01-04-2025
Totals
Paid in,64000

Security Name,ISIN,Quantity,Average price,Buy value,Closing price,Closing value
BANK ONE LTD,INE040A01034,8,900,7200,812.5,6500
MOTOR WORKS LTD,INE155A01022,30,400,12000,410,12300
ZINC WORKS LTD,INE267A01025,9,500,4500,480,4320
GOLD FUND,INF204KB17I5,20,100,2000,104.5,2090
FUND NOBODY KNOWS,INF999XX9XX9,5,90,450,95,475
"""
COMPACT = 'Symbol,Investment Value\nRELIANCE,"₹41,000"\nTCS.NS,12500\nHDFCBANK,"2,10,000"\nINFY-EQ,"Rs 7,500"\n'
DETAILED = "Stock,Qty,Avg Price\nRELIANCE,4,1500.0\nTCS,3,2000.0\nTCS,1,2500\n"
DOTTED = "scrip,investment value\nITC,\"Rs.18,000\"\n"
JUNK = "hello,world\n1,2\n"


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("statements")
    for name, text in {"statement": STATEMENT, "compact": COMPACT, "detailed": DETAILED, "dotted": DOTTED, "junk": JUNK}.items():
        (folder / f"{name}.csv").write_text(text)
    docs = scan_statements(spark, str(folder))


    return rows_of(docs.withColumn("file", F.regexp_extract("file", r"([a-z]+)\.csv$", 1))).cache()


def by_ticker(spark, rows, file):
    got = hld.holdings(rows, isins(spark)).filter(f"file = '{file}'").collect()
    return {r.ticker: r for r in got}


def test_statement_with_preamble(spark, rows):
    got = by_ticker(spark, rows, "statement")
    assert got["HDFCBANK.NS"].amount == 6500 and got["HDFCBANK.NS"].quantity == 8 and got["HDFCBANK.NS"].invested == 7200
    assert got["GOLDBEES.NS"].amount == 2090
    assert set(got) == {"HDFCBANK.NS", "TMPV.NS", "HINDZINC.NS", "GOLDBEES.NS"}
    assert got["TMPV.NS"].amount_basis == "current_value"
    left_out = hld.skipped(rows, isins(spark)).filter("file = 'statement'").collect()
    assert [r.label for r in left_out] == ["FUND NOBODY KNOWS"]


def test_compact_and_detailed(spark, rows):
    got = by_ticker(spark, rows, "compact")
    assert {k: v.amount for k, v in got.items()} == {"RELIANCE.NS": 41000, "TCS.NS": 12500, "HDFCBANK.NS": 210000, "INFY.NS": 7500}
    got = by_ticker(spark, rows, "detailed")
    assert got["TCS.NS"].amount == 8500 and got["TCS.NS"].quantity == 4 and got["TCS.NS"].amount_basis == "qty_x_avg_price"


def test_a_dot_after_the_currency_word_is_kept(spark, rows):
    assert by_ticker(spark, rows, "dotted")["ITC.NS"].amount == pytest.approx(0.18)


def test_unusable_files_are_reported(spark, rows):
    assert [(r.file, r.reason) for r in hld.unusable_files(rows, isins(spark)).collect()] == [("junk", "no ticker or ISIN column")]


def test_header_names(spark):
    df = spark.createDataFrame([(["Qty", "", "Qty", " nan ", "Qty"],)], "cells array<string>")
    assert df.select(hld.header_names(df.cells)).collect()[0][0] == ["Qty", "Unnamed: 1", "Qty.1", "Unnamed: 3", "Qty.2"]


@pytest.mark.parametrize(
    "raw,statement,typed",
    [
        ("infy-eq", "INFY.NS", "INFY.NS"),
        ("TCS - Tata", "TCS.NS", "TCS-TATA.NS"),
        ("tata steel", "TATA.NS", "TATASTEEL.NS"),
        ("SBINEQ", "SBIN.NS", "SBINEQ.NS"),
        ("EQ", "EQ.NS", "EQ.NS"),
        ("^NSEI", "^NSEI", "^NSEI"),
        ("abc.bo", "ABC.BO", "ABC.BO"),
        ("-", None, None),
        ("nan", None, "NAN.NS"),
        ("  ", None, None),
    ],
)
def test_ticker_rules(spark, raw, statement, typed):
    df = spark.createDataFrame([(raw,)], "t string")
    assert tuple(df.select(hld.clean_ticker(df.t), hld.typed_ticker(df.t)).collect()[0]) == (statement, typed)


def test_typed_lines(spark):
    lines = ["# note", "", " TCS.NS , ₹1,000 ", "BAD", "X, abc", "TCS.NS, Rs 2,500", "Y,-3"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file string, line_no int, line string")
    assert {r.ticker: r.amount for r in hld.typed_lines(df).collect()} == {"TCS.NS": 2500.0, "Y": -3.0}


def test_search_ranks_prefixes_first_and_matches_brute_force(spark):
    names = [("TCS.NS", "Tata Consultancy"), ("TATASTEEL.NS", "Tata Steel"), ("ITC.NS", "I T C"), ("MTAT.NS", "Metal Tat"), ("A.NS", "alpha")]
    asks = ["tat", "t", "TA", "steel", "zzz", " ", "a steel"]
    n = spark.createDataFrame(names, "ticker string, name string")
    q = spark.createDataFrame([(a,) for a in asks], "query string")
    got = {}
    for r in hld.search(n, q).orderBy("query", "place").collect():
        got.setdefault(r.query, []).append(r.ticker)
    for ask in asks:
        u = ask.strip().upper()
        hit = [(t, m) for t, m in names if u and (u in t.replace(".NS", "") or u in m.upper())]
        first = [x for x in hit if x[0].replace(".NS", "").startswith(u) or x[1].upper().startswith(u)]
        rest = [x for x in hit if x not in first]
        want = [t for t, _ in sorted(first, key=lambda x: x[1]) + sorted(rest, key=lambda x: x[1])]
        assert got.get(u, []) == want


def test_search_deals_long_lists_into_parts(spark):
    rows = [(f"T{k}.NS", f"{'Common' if k % 3 else 'Rare'} name {k}") for k in range(120)]
    n = spark.createDataFrame(rows, "ticker string, name string")
    q = spark.createDataFrame([("common name",), ("na",), ("e",), ("rare name 1",), ("absent",), ("name 11",)], "query string")
    one = hld.search(n, q, limit=200, list_rows=10_000).collect()
    many = hld.search(n, q, limit=200, list_rows=7).collect()
    assert sorted(one) == sorted(many) and len(one) > 120
    for r in one:
        assert r.query in r.name.upper()
    want = sum(text in name.upper() or text in ticker for text in ("COMMON NAME", "NA", "E", "RARE NAME 1", "NAME 11") for ticker, name in rows)
    assert len(one) == want
