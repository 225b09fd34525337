"""Operators that SQL cannot say, and edges of those it can."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from tallyweir.functions import cutoffs, periods
from tallyweir.functions import texts as T
from tallyweir.functions.metrics import BY_NAME, envelope, value
from tallyweir.operators import discovery, documents, events, evidence, exhibits, facts, incremental, ownership, series

from .conftest import rows

D = dt.date


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_normalised(spark):
    assert one(spark, T.normalised, " a b​c “d” –\n e ") == 'a bc "d" - e'
    assert one(spark, T.normalised, None) is None


@pytest.mark.parametrize(
    "text, want",
    [
        ("One. Two! Three? Four", ["One.", "Two!", "Three?", "Four"]),
        ("Acme Inc. Bought it. Then John A. Smith left.", ["Acme Inc. Bought it.", "Then John A. Smith left."]),
        ("The U.S. Court sat. No. 5 won.", ["The U.S. Court sat.", "No. 5 won."]),
        ('He said "Yes." $5 was paid. lower case stays. ', ['He said "Yes."', "$5 was paid. lower case stays."]),
        ("page 3\n\nA block.\n\nTable of Contents\n\nB block.", ["A block.", "B block."]),
        ("x" * 61 + " cut\n\nhere it goes on. End.", ["x" * 61 + " cut here it goes on.", "End."]),
        ("", []), ("  \n\n ", []),
    ],
)
def test_sentences(spark, text, want):
    assert one(spark, T.sentences, text) == want


def test_figures(spark):
    got = one(spark, T.figures, "Paid $1,234.50 and $2.5 million for 30,000 ordinary shares, or 12.5% of it.")
    assert [(f.type, f.value) for f in got] == [("money", 1234.5), ("money", 2.5e6), ("shares", 30000.0), ("percent", 12.5)]


def test_events(spark):
    text = (
        "As previously disclosed, the company entered into a merger agreement with Beta on May 1. On July 3 the board appointed Ann Lee as chief financial officer "
        "with effect from August at a salary.\n\nThe company entered into a securities purchase agreement for its shares."
    )
    got = {(r.event_type, r.pos, r.background) for r in events.text_events(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")).collect()}
    assert got == {("management_change", 1, False), ("cfo_change", 1, False), ("financing", 2, False)}


def test_recaps_stay_where_nothing_is_fresh(spark):
    df = spark.createDataFrame([(1, "As previously announced, the company filed for bankruptcy in May.")], "doc_id int, text string")
    assert rows(events.text_events(df), "event_type", "background") == [("bankruptcy", True)]


def test_plain_text(spark):
    page = "<DOCUMENT><TYPE>6-K\n<TEXT><html><head><title>no</title></head><body><p>A &amp; B</p><!-- <p>no</p> --><script>x</script><table><tr><td>1</td><td>2</td></tr></table>C<br>D <b>b</b>old &lt;p&gt;</body></html></TEXT></DOCUMENT>"
    texts = [page, "a\nb\n\n c ", "5 < 6 and 7 > 3", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", documents.document_text("t"))
    assert [r[1] for r in rows(df)] == ["A & B\n\n1 2\n\nC\n\nD bold <p>", "a b\n\nc", "5 < 6 and 7 > 3", "", ""]


def test_document_text_in_batches(spark):
    df = spark.createDataFrame([("<p>x</p>",), (None,), ("",)], "t string").select(documents.document_text("t").alias("x"))
    assert rows(df) == [("",), ("",), ("x",)]


def test_index_rows(spark):
    page = "<table><tr><th>Seq</th><th>Description</th><th>Document</th><th>Type</th></tr><tr><td>1</td><td>Report</td><td><a href='/x.htm'>x.htm</a> iXBRL</td><td>10-K</td><td>9</td></tr><tr><td>short</td></tr></table>"
    df = spark.createDataFrame([(7, page), (8, None)], "doc_id bigint, text string")
    assert rows(documents.index_documents(df)) == [(7, "1", "Report", "x.htm", "10-K", "/x.htm")]


def test_sections():
    text = "Item 1. Business\nItem 7. Discussion\n\nItem 1. Business\n" + "We sell. " * 40 + "\nItem 7. Discussion\nGrew.\n"
    got = {s[0]: (s[1], s[3][:7], s[4]) for s in documents.sections_of(text)}
    assert got == {"1": ("Business", "We sell", "medium"), "7": ("Discussion", "Grew.", "low")}
    assert documents.sections_of(None) == []


def test_phrase(spark):
    df = spark.createDataFrame([(1, "the big Big cat, the big cat"), (2, "big the cat"), (3, None)], "doc_id int, text string")
    index = documents.token_index(df)
    assert rows(documents.phrase_hits(index, "the big")) == [(1, 2)]
    assert rows(documents.phrase_hits(index, "big cat")) == [(1, 2)]
    assert rows(documents.phrase_hits(index, "big big")) == [(1, 1)]
    with pytest.raises(ValueError):
        documents.phrase_hits(index, "--")


OWNERSHIP = """<?xml version="1.0"?><o:ownershipDocument xmlns:o="u"><o:documentType>4</o:documentType><o:issuer><o:issuerCik>7</o:issuerCik><o:issuerName>N</o:issuerName></o:issuer>
<o:reportingOwner><o:reportingOwnerId><o:rptOwnerCik>9</o:rptOwnerCik><o:rptOwnerName>A</o:rptOwnerName></o:reportingOwnerId></o:reportingOwner>
<o:nonDerivativeTable><o:nonDerivativeTransaction><o:securityTitle><o:value>Common</o:value></o:securityTitle><o:transactionDate><o:value>2020-01-02</o:value></o:transactionDate>
<o:transactionCoding><o:transactionCode>P</o:transactionCode></o:transactionCoding><o:transactionAmounts><o:transactionShares><o:value>1,000</o:value></o:transactionShares>
<o:transactionPricePerShare><o:value>2.5</o:value></o:transactionPricePerShare><o:transactionAcquiredDisposedCode><o:value>A</o:value></o:transactionAcquiredDisposedCode></o:transactionAmounts>
<o:postTransactionAmounts><o:sharesOwnedFollowingTransaction><o:value>5000</o:value></o:sharesOwnedFollowingTransaction></o:postTransactionAmounts></o:nonDerivativeTransaction></o:nonDerivativeTable></o:ownershipDocument>"""
INFO = """<t xmlns="u"><infoTable><nameOfIssuer>X</nameOfIssuer><titleOfClass>C</titleOfClass><cusip>1</cusip><value>5</value><shrsOrPrnAmt><sshPrnamt>7</sshPrnamt><sshPrnamtType>SH</sshPrnamtType></shrsOrPrnAmt>
<putCall>Put</putCall><investmentDiscretion>SOLE</investmentDiscretion><votingAuthority><Sole>1</Sole><Shared>2</Shared><None>3</None></votingAuthority></infoTable></t>"""


def test_xml_documents(spark):
    df = spark.createDataFrame([(1, OWNERSHIP), (2, INFO), (3, "<broken"), (4, None)], "doc_id bigint, text string")
    got = ownership.parsed(df, ownership.ownership_rows, ownership.OWNERSHIP).collect()
    assert [tuple(r) for r in got] == [(1, "4", "7", "N", "9", "A", False, "Common", "2020-01-02", "P", 1000.0, 2.5, 2500.0, "A", 5000.0)]
    got = ownership.parsed(df, ownership.info_rows, ownership.INFO_TABLE).collect()
    assert [tuple(r) for r in got] == [(2, "X", "C", "1", 5.0, 7.0, "SH", "put", "SOLE", 1.0, 2.0, 3.0)]


def test_bodies_never_cut_a_character(spark):
    texts = ["abc", "aé中😀", "😀😀", "", None]
    for most in range(4, 9):
        df = spark.createDataFrame([(t,) for t in texts], "text string")
        for r in incremental.bodies(df, most=most).collect():
            if r.text is None:
                assert r.body is None
                continue
            want = r.text.encode()[:most].decode("utf-8", "ignore")
            assert (r.body, r.truncated) == (want, len(r.text.encode()) > most)


def test_append_absent_twice(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    path = f"{tmp_path}/table"
    assert incremental.append_absent(df, path, ["k"]) == 2
    assert incremental.append_absent(df, path, ["k"]) == 2


def test_marks_lose_no_late_filing(spark):
    schema = "cik string, form string, filed date, accession string"
    first = spark.createDataFrame([("1", "8-K", D(2020, 1, 1), "a"), ("1", "8-K", D(2020, 1, 2), "b")], schema)
    marks = incremental.advanced(spark.createDataFrame([], "cik string, form string, day date, seen array<string>"), first)
    later = spark.createDataFrame([("1", "8-K", D(2020, 1, 2), "b"), ("1", "8-K", D(2020, 1, 2), "c"), ("1", "8-K", D(2020, 1, 3), "d"), ("1", "8-K", D(2019, 1, 3), "e"), ("2", "8-K", D(2019, 1, 3), "f")], schema)
    assert rows(incremental.new_since(later, marks), "accession") == [("c",), ("d",), ("f",)]
    again = incremental.advanced(marks, later.where("filed = '2020-01-02'"))
    assert rows(again, "day", "seen") == [(D(2020, 1, 2), ["b", "c"])]


def test_identifiers(spark):
    df = spark.createDataFrame([(1, "aapl, msft # comment"), (2, "MSFT,,goog"), (3, "# none"), (4, None)], "line int, text string")
    assert rows(discovery.identifiers(df, "text"), "identifier", "line") == [("AAPL", 1), ("GOOG", 2), ("MSFT", 1)]


def test_suggestions(spark):
    df = spark.createDataFrame([("NetIncomeLoss",), ("Assets",), (None,), ("NetIncomeLoss",)], "tag string")
    assert [r.tag for r in discovery.suggestions(df, "NetIncomLoss").collect()] == ["netincomeloss"]


def test_envelope(spark):
    df = spark.createDataFrame([(10.0, None, 5.0), (None, 1.0, 5.0), (10.0, 2.0, 0.0)], "assets_current double, inventory double, liabilities_current double")
    got = [r.e for r in df.select(envelope(BY_NAME["quick_ratio"]).alias("e")).collect()]
    assert [(e.value, e.caveats, e.missing_inputs) for e in got] == [(2.0, ["inventory not reported; taken as 0"], []), (None, [], ["assets_current"]), (None, [], [])]
    assert [r.x for r in df.select(value(BY_NAME["current_ratio"]).alias("x")).collect()] == [2.0, None, None]


def test_availability(spark):
    df = spark.createDataFrame([("a", D(2020, 6, 30)), ("b", D(2020, 6, 30)), ("c", D(2020, 6, 29)), ("d", D(2020, 6, 28)), ("e", None)], "accession string, filed date")
    acc = spark.createDataFrame([("a", dt.datetime(2020, 6, 30, 17)), ("b", dt.datetime(2020, 6, 30, 19))], "accession string, acceptance_ts timestamp")
    assert rows(facts.as_of(df, acc, "2020-06-30 18:00:00", intraday=True), "accession") == [("a",), ("d",)]
    assert rows(facts.as_of(df, acc, "2020-06-30 23:59:59"), "accession") == [("a",), ("b",), ("c",), ("d",)]


def test_four_quarters_need_no_gap(spark):
    ends = [D(2019, 12, 31), D(2020, 3, 31), D(2020, 6, 30), D(2020, 9, 30), D(2021, 3, 31)]
    df = spark.createDataFrame([("1", e, float(i)) for i, e in enumerate(ends)] + [("2", ends[0], 1.0)], "cik string, end date, val double")
    assert rows(series.ttm_quarters(df)) == [("1", 6.0, ends[3], ends[0], ends[4]), ("2", None, None, None, ends[0])]


def test_change_point_and_label(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 3.0, 2.0, 1.0, 0.0]
    df = spark.createDataFrame([("1", D(2020, m + 1, 1), v) for m, v in enumerate(vals)] + [("2", D(2020, 1, 1), 1.0)], "cik string, end date, val double")
    got = series.change_points(df).collect()
    assert [(r.cik, r.split) for r in got] == [("1", 4)] or [(r.cik, r.split) for r in got] == [("1", 3)]
    label = series.trend_label(F.lit(1.0), F.lit(10.0), F.lit(2.0), F.lit(1.0))
    assert spark.range(1).select(label.alias("x")).first().x == "decelerating"


def test_statements(spark):
    text = "As of June 23, 2023 there were 60,788,115 ordinary shares outstanding, held by 167 holders. Holders approved a 1-for-148 reverse split of the shares. A 5-for-1 split may be required to be done if necessary."
    got = {(r.topic, str(r.as_of), r.ratio, tuple(f.value for f in r.figures)) for r in evidence.statements(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")).collect()}
    assert got == {("shares_outstanding", "2023-06-23", None, (60788115.0,)), ("reverse_split", "None", "1-for-148", ())}


def test_statements_are_capped_in_order(spark):
    text = " ".join(f"Warrants for {i},000 shares are exercisable now." for i in range(1, 13))
    got = rows(evidence.statements(spark.createDataFrame([(1, text)], "doc_id int, text string")), "pos")
    assert got == [(i,) for i in range(8)]


def test_highlights(spark):
    text = "Revenue grew 5% to $3 million. Q1 Q2 revenue 1 2 3 4 5 6 7 8. No numbers in revenue here. Revenue grew 5% to $3 million. Weather was 20 degrees."
    assert rows(evidence.earnings_highlights(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string"))) == [(1, 0, "Revenue grew 5% to $3 million.")]


def test_governance(spark):
    text = "Our Board of Directors consists of nine (9) directors. Audit Fees: $1,250,000\nTax fees $5,000\nProposal 1 Election of Directors\nthe Proposal 2 was withdrawn\nProposal 2: Ratify the Plan. The Chief Executive\nOfficer agrees."
    df = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc_id int, text string")
    got = evidence.governance(df).collect()
    assert [(r.doc_id, r.board_size, [tuple(f) for f in r.audit_fees], r.officers) for r in got] == [(1, 9, [("audit fees", 1250000)], ["chief executive officer"])]
    assert rows(evidence.proposals(df)) == [(1, 1, "Election of Directors"), (1, 2, "Ratify the Plan")]


def test_owners(spark):
    cover = "<f xmlns='u'><securitiesClassTitle>Common</securitiesClassTitle><dateOfEvent>01/02/2020</dateOfEvent><reportingPersonInfo><reportingPersonName>A</reportingPersonName><reportingPersonCIK>9</reportingPersonCIK><aggregateAmountOwned>1,234.00</aggregateAmountOwned><percentOfClass>5.5</percentOfClass></reportingPersonInfo></f>"
    legacy = "NAMES OF REPORTING PERSONS (entities)\nBeta LP\n9 AGGREGATE AMOUNT BENEFICIALLY OWNED BY EACH REPORTING PERSON\n\n2,000\n11 PERCENT OF CLASS REPRESENTED BY AMOUNT IN ROW (9): 6.1%\nNAME OF REPORTING PERSON\nLost\nAGGREGATE AMOUNT BENEFICIALLY OWNED\nCheck the box\n"
    df = spark.createDataFrame([(1, cover), (2, legacy), (3, None), (4, "<x/>")], "doc_id bigint, text string")
    got = ownership.parsed(df, ownership.owner_rows, ownership.OWNERS)
    assert rows(got) == [(1, "A", "9", 1234.0, 5.5, "Common", "01/02/2020", "elements"), (2, "Beta LP", None, 2000.0, 6.1, None, None, "labels")]


def test_cutoffs():
    assert cutoffs.parse_cutoff("2020-06-30") == (dt.datetime(2020, 6, 30, 23, 59, 59, 999999, dt.UTC), False)
    assert cutoffs.parse_cutoff("2020-06-30T18:00:00-04:00") == (dt.datetime(2020, 6, 30, 22, tzinfo=dt.UTC), True)
    for bad in ("2020-06-30T18:00:00", "2020-02-30", "yesterday", ""):
        with pytest.raises(ValueError):
            cutoffs.parse_cutoff(bad)
    assert cutoffs.tighter("2020-06-30", "2020-06-30T18:00:00Z") == "2020-06-30T18:00:00Z" and cutoffs.tighter(None, None) is None


def test_exhibits(spark):
    docs = [("10-K", "a.htm"), ("EX-99.1", "b.htm"), ("EX-101.SCH", "c.xml"), ("ex-10 ", "d.TXT"), ("EX-99.2", "e.jpg"), (None, "f.htm"), ("EX-1", None)]
    df = spark.createDataFrame(docs, "doc_type string, document string")
    assert rows(exhibits.exhibits(df), "document") == [("b.htm",), ("d.TXT",)]
    assert rows(exhibits.exhibits(df, ["99"]), "document") == [("b.htm",)]
    links = ["https://www.x.org/ix?doc=/a/b.htm", "https://www.x.org/a", "http://www.x.org/a", "https://evil.org/www.x.org", "https://www.x.org@evil.org/a", "https://www.x.org:99/", None]
    got = spark.createDataFrame([(u,) for u in links], "u string").select(exhibits.direct_url(F.col("u"), ["www.x.org"]).alias("x")).collect()
    assert [r.x for r in got] == ["https://www.x.org/a/b.htm", "https://www.x.org/a", None, None, None, None, None]
    got = spark.createDataFrame([("<p>x</p>",), (" ",), (None,), ("<script>loadViewer()</script>",)], "b string").select(exhibits.readable_body(F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == [True, False, False, False]


def test_dates(spark):
    df = spark.createDataFrame([("July 1, 2026",), ("1/2/2020",), ("2020-01-02",), ("soon",), (None,)], "t string")
    got = df.select(periods.long_date(F.col("t")).cast("string").alias("a"), periods.reported_date(F.col("t")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("2026-07-01", "July 1, 2026"), (None, "2020-01-02"), (None, "2020-01-02"), (None, "soon"), (None, None)]
