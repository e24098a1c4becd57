"""Facts and contexts of small instances, plain and inline, and the metrics of a year."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.sources.xbrl import annual_metrics, contexts, facts

INSTANCE = """<?xml version="1.0"?><xbrli:xbrl xmlns:xbrli="http://x" xmlns:ifrs-full="http://y">
<!-- <ifrs-full:Revenue contextRef="c1">999</ifrs-full:Revenue> -->
<xbrli:context id="c1"><xbrli:entity><xbrli:identifier scheme="s">E1</xbrli:identifier><xbrli:segment><xbrldi:explicitMember dimension="a:axis">
 ifrs-full:ConsolidatedMember</xbrldi:explicitMember></xbrli:segment></xbrli:entity><xbrli:period><xbrli:startDate>2020-01-01</xbrli:startDate><xbrli:endDate>2020-12-31</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:context id='c2'><xbrli:entity><xbrli:identifier scheme="s">E1</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:instant>2020-12-31T00:00:00</xbrli:instant></xbrli:period><xbrli:scenario><xbrldi:explicitMember dimension="b">q:SeparateMember</xbrldi:explicitMember><xbrldi:typedMember dimension="t"><x>1</x></xbrldi:typedMember></xbrli:scenario></xbrli:context>
<context id="plain"><entity><identifier scheme="s">E1</identifier></entity><period><instant>2020-12-31</instant></period></context>
<ifrs-full:Revenue contextRef="c1" unitRef="KRW" decimals="-3"> 1,234.50 </ifrs-full:Revenue><ifrs-full:Revenue contextRef="c1">-2000</ifrs-full:Revenue>
<ifrs-full:Assets unitRef='KRW' contextRef='c2'>5&amp;6</ifrs-full:Assets><d:Empty contextRef="c1"/><d:Nested contextRef="c1"><d:Inner>7</d:Inner></d:Nested><ifrs-full:Inventories contextRef="nowhere">8</ifrs-full:Inventories>
</xbrli:xbrl>"""
INLINE = """<html><body><p>Sales of <ix:nonFraction name="us-gaap:Revenues" contextRef="d" unitRef="USD" scale="6" decimals="-6">1,200</ix:nonFraction> and
<ix:nonFraction name="us-gaap:OperatingIncomeLoss" contextRef="d" scale="3">(45)</ix:nonFraction> <ix:nonNumeric name="dei:Name" contextRef="d">A &lt; B</ix:nonNumeric><br><ix:header><ix:resources>
<xbrli:context id="d"><xbrli:entity><xbrli:identifier scheme="cik">1</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:startDate>2021-01-01</xbrli:startDate><xbrli:endDate>2021-12-31</xbrli:endDate></xbrli:period></xbrli:context></ix:resources></ix:header>"""


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, INSTANCE), (2, INLINE), (3, None), (4, ""), (5, "<broken <context id='z'>")], "id int, body string")


def test_contexts(docs):
    got = {(r["id"], r["context_id"]): r for r in contexts(docs, "id", "body").collect()}
    assert set(got) == {(1, "c1"), (1, "c2"), (1, "plain"), (2, "d")}
    one = got[1, "c1"]
    assert (one["entity"], one["start"], one["end"], one["instant"]) == ("E1", dt.date(2020, 1, 1), dt.date(2020, 12, 31), None)
    assert [tuple(m) for m in one["members"]] == [("a:axis", "ifrs-full:ConsolidatedMember")]
    assert got[1, "c2"]["instant"] == dt.date(2020, 12, 31) and [tuple(m) for m in got[1, "c2"]["members"]] == [("b", "q:SeparateMember"), ("t", "typed")]
    assert got[1, "plain"]["members"] == []


def test_facts(docs):
    got = [(r["id"], r["concept"], r["context_id"], r["unit"], r["decimals"], r["raw"], None if r["value"] is None else float(r["value"]), r["end"] or r["instant"]) for r in facts(docs, "id", "body").orderBy("id", "seq").collect()]
    end, year = dt.date(2020, 12, 31), dt.date(2021, 12, 31)
    assert got == [
        (1, "Revenue", "c1", "KRW", "-3", "1,234.50", 1234.5, end), (1, "Revenue", "c1", None, None, "-2000", -2000.0, end), (1, "Assets", "c2", "KRW", None, "5&6", None, end), (1, "Inventories", "nowhere", None, None, "8", 8.0, None),
        (2, "Revenues", "d", "USD", "-6", "1,200", 1.2e9, year), (2, "OperatingIncomeLoss", "d", None, None, "(45)", -45000.0, year), (2, "Name", "d", None, None, "A < B", None, year),
    ]


def test_metrics_take_the_best_context(spark):
    def context(name, period, *members):
        told = "".join(f'<explicitMember dimension="m">{m}</explicitMember>' for m in members)
        return f'<context id="{name}"><entity><identifier scheme="s">1</identifier><segment>{told}</segment></entity><period>{period}</period></context>'

    year, quarter, point = "<startDate>2020-01-01</startDate><endDate>2020-12-31</endDate>", "<startDate>2020-10-01</startDate><endDate>2020-12-31</endDate>", "<instant>2020-12-31</instant>"
    told = [
        context("Y", year, "ifrs:ConsolidatedMember"), context("YS", year, "ifrs:SeparateMember"), context("YX", year, "ifrs:ConsolidatedMember", "x:Segment"), context("YN", year), context("Q", quarter, "ifrs:ConsolidatedMember"),
        context("P", point, "ifrs:ConsolidatedMember"), context("PN", point),
    ]
    values = [
        ("Revenue", "Y", 100), ("Revenue", "YS", 900), ("Revenue", "Q", 800), ("Revenue", "YX", 700), ("Revenue", "Y", -150), ("OperatingIncomeLoss", "YN", 7), ("OperatingIncomeLoss", "YS", 70),
        ("PurchaseOfPropertyPlantAndEquipment", "Y", 10), ("PurchaseOfIntangibleAssets", "Y", -10), ("PurchaseOfIntangibleAssets", "Y", 4), ("CashAndCashEquivalents", "PN", 3), ("CashAndCashEquivalents", "Y", 99),
        ("ShortTermBorrowings", "P", 5), ("Bonds", "P", 6), ("LeaseLiabilities", "P", 5), ("Inventories", "PN", 2), ("TradePayables", "P", 9),
    ]
    xml = "".join(told) + "".join(f'<i:{c} contextRef="{k}">{v}</i:{c}>' for c, k, v in values)
    df = spark.createDataFrame([(1, f"<r>{xml}</r>"), (2, f'<r>{told[0]}<i:Borrowings contextRef="Y">1</i:Borrowings></r>')], "id int, x string")
    got = {r["id"]: r.asDict() for r in annual_metrics(facts(df, "id", "x"), "id", F.lit(dt.date(2020, 12, 31))).collect()}
    want = {"revenue": -150, "ebit": 7, "capex": 14, "depreciation": None, "cash": 3, "debt": 11, "nwc": -7}
    assert {k: None if got[1][k] is None else float(got[1][k]) for k in want} == want and got[1]["facts"] == len(values) and got[1]["covered"] == 6
    assert got[2]["facts"] == 1 and got[2]["covered"] == 0


def test_a_document_is_read_once(spark):
    """Facts take their contexts without a join, the last one of an id; metrics need one shuffle."""
    context = '<context id="c"><entity><identifier scheme="s">{}</identifier></entity><period><instant>2020-12-31</instant></period></context>'
    xml = "<r>" + context.format("A") + '<i:Inventories contextRef="c">1</i:Inventories><i:Other contextRef="c">2</i:Other>' + context.format("B") + "</r>"
    found = facts(spark.createDataFrame([(1, xml), (2, "<r/>")], "id int, x string"), "id", "x")
    assert [(r["concept"], r["entity"]) for r in found.orderBy("seq").collect()] == [("Inventories", "B"), ("Other", "B")]
    made = annual_metrics(found, "id", F.lit(dt.date(2020, 12, 31)))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert [(r["id"], r["facts"], float(r["nwc"]), r["covered"]) for r in made.collect()] == [(1, 2, 1.0, 1)]
