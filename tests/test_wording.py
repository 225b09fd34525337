"""What sentences say: the vocabulary engine, events, reports and figures."""

import re

import pytest
from pyspark.sql import functions as F

from tallyweir.functions import texts as T
from tallyweir.functions import wording as W
from tallyweir.operators import events as E
from tallyweir.operators import evidence as V

from .conftest import rows


def test_plain_words(spark):
    df = spark.createDataFrame([("A 1-for-20 split, of 1,234.5 shares (the \"Split\").",), ("",), (None,)], "t string")
    assert [r.w for r in df.select(W.worded(F.col("t")).alias("w")).collect()] == [' a 1 for 20 split of 12345 shares the " split " ', "  ", None]


@pytest.mark.parametrize(
    "sentence, want",
    [("the board approved a split", True), ("a split was approved", False), ("approved x x x split", False), ("disapproved a split", False), ("approving split", True)],
)
def test_near(spark, sentence, want):
    df = spark.createDataFrame([(sentence,)], "t string")
    assert df.select(W.near(W.worded(F.col("t")), ("approv*",), ("split",), 2).alias("x")).first().x is want


def test_plain_search_hides_no_match(spark):
    """``holds`` is true wherever the expressions match: tried on all sayings with phrases put together at random."""
    import random

    rng = random.Random(1)
    fill = lambda p: re.sub(r"\*", lambda m: rng.choice(["", "s", "ing"]), p).replace("#", "12")
    lines = []
    for s in (*E.EVENTS, *V.TOPICS, *V.KINDS):
        for c in s.clauses:
            for _ in range(6):
                lines.append(" ".join(["x", fill(rng.choice(c.one)), *["y"] * rng.randrange(3), *([fill(rng.choice(c.other))] if c.other else []), "12345"]))
    df = spark.createDataFrame([(x,) for x in lines], "t string").select(W.worded(F.col("t")).alias("w"))
    for s in (*E.EVENTS, *V.TOPICS):
        for c in s.clauses:
            bare = f" {W._one_of(c.one)}" + (f" (?:[^ ]+ ){{0,{c.within}}}?{W._one_of(c.other)} " if c.other else " ")
            got = df.select(c.test(F.col("w")).alias("a"), F.col("w").rlike(bare).alias("b"))
            assert got.where("b and not a").count() == 0, (s.name, c)


EXAMPLES = [
    ("Northwind signed a securities purchase agreement for a private placement of its shares.", {"financing"}),
    ("The Company closed a registered direct offering of 2,000,000 shares.", {"financing"}),
    ("We entered into a warrant inducement agreement with two holders.", {"financing"}),
    ("We entered into a license agreement with Contoso.", {"material_agreement"}),
    ("The Company entered into a merger agreement with Fabrikam.", {"merger"}),
    ("The Company announced the termination of its merger agreement with Fabrikam.", {"agreement_termination"}),
    ("Northwind sold all of its shares in its wholly owned subsidiary to a buyer.", {"divestiture"}),
    ("The board approved a 1-for-40 reverse stock split of the shares.", {"reverse_split"}),
    ("We may regain compliance, including by effecting a reverse stock split, if necessary.", set()),
    ("The Company changed its corporate name to Woodgrove.", {"name_change"}),
    ("Holders approved the continuation from the Cayman Islands.", {"redomicile"}),
    ("Nasdaq told us that we are not in compliance with its rule.", {"listing_deficiency"}),
    ("The Company received a Nasdaq deficiency notice as its minimum bid price was below $1.00.", {"listing_deficiency", "minimum_bid_deficiency"}),
    ("Nasdaq confirmed that the Company regained compliance with the minimum bid price requirement.", {"listing_compliance"}),
    ("We received a delisting determination from Nasdaq in May.", {"listing_deficiency", "delisting_determination"}),
    ("We requested a hearing before the Nasdaq Hearings Panel.", {"hearing_panel_appeal"}),
    ("We may request a hearing before the Nasdaq Hearings Panel.", set()),
    ("Nasdaq notified us that it will suspend trading in our shares on Monday.", {"delisting", "delisting_determination"}),
    ("The voting results are given below.", {"shareholder_vote"}),
    ("The Company will hold its annual general meeting in June.", {"shareholder_meeting_notice"}),
    ("Our authorized share capital was increased to 500,000 shares.", {"authorized_capital_change"}),
    ("The board adopted amended and restated bylaws.", {"charter_amendment"}),
    ("Ann Lee resigned as a director of the Company.", {"management_change"}),
    ("The Company appointed Jo Doe as chief financial officer.", {"management_change", "cfo_change"}),
    ("The Company dismissed its independent registered public accounting firm.", {"auditor_change"}),
    ("Attached are six-month interim financial statements.", {"financial_results"}),
    ("Attached are unaudited pro forma financial statements.", set()),
    ("The Company filed a voluntary petition under chapter 11.", {"bankruptcy"}),
    ("The Company entered into an indenture for senior notes.", {"debt"}),
    ("The Company raised its full-year revenue guidance to $90 million.", {"guidance"}),
    ("The Company expects revenue of $5 million.", {"guidance"}),
    ("Notes to the financial statements and the outlook are on our website.", set()),
    ("The audit committee concluded that the statements should no longer be relied upon.", {"non_reliance_restatement"}),
]


def test_sayings(spark):
    df = spark.createDataFrame(list(enumerate(s for s, _ in EXAMPLES)), "doc_id int, text string")
    got = {i: set() for i in range(len(EXAMPLES))}
    for r in E.text_events(df).collect():
        got[r.doc_id].add(r.event_type)
    assert {EXAMPLES[i][0]: g for i, g in got.items()} == dict(EXAMPLES)


REPORT = """UNITED STATES

SECURITIES AND EXCHANGE COMMISSION

FORM 8-K

Item 7.01 Regulation FD Disclosure.

A copy of the press release is attached as Exhibit 99.1 and incorporated herein by reference.

{middle}

Item 9.01 Financial Statements and Exhibits.

99.1 Press Release Announcing a Merger Agreement

SIGNATURES

The Company has filed for bankruptcy in this line that no one reads."""


def test_reports_are_cut_to_their_body(spark):
    shield = "Forward-Looking Statements\n\nThe Company expects revenue of $4 million to grow.\n\nItem 5.02 Departure of Directors.\n\nThe Company appointed Jo Doe as chief financial officer."
    texts = [REPORT.format(middle=""), REPORT.format(middle=shield), None, "", "The Company announced the closing of a private placement for $10 million."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert rows(E.text_events(df), "doc_id", "event_type", "source") == [
        (0, "merger", "exhibit_index"), (1, "cfo_change", "body"), (1, "management_change", "body"), (4, "financing", "body"),
    ]
    leads = {r.doc_id: (r.needs_exhibit, r.items, r.exhibits) for r in E.report_leads(df).collect()}
    assert leads == {0: (True, "7.01", 1), 1: (False, "7.01,5.02", 1), 2: (True, "", 0), 3: (True, "", 0), 4: (False, "", 0)}


def test_long_sentences_are_cut_around_the_words(spark):
    text = "It is said " + "and said " * 200 + "that the Company filed for bankruptcy in May" + " as is said" * 100 + "."
    r = E.text_events(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert "bankruptcy" in r.sentence and r.sentence.startswith("... ") and r.sentence.endswith(" ...") and len(r.sentence) <= E.SNIPPET + 8


def test_events_of_items_and_texts_unite(spark):
    filings = spark.createDataFrame([("a", "8-K", "2020-01-02", "5.02,9.01"), ("b", "6-K", "2020-01-03", None), ("c", "8-K", None, "1.03")], "accession string, form string, filed string, item_list string")
    text = "The Company appointed Jo Doe as chief financial officer."
    docs = spark.createDataFrame([(1, "a", "8-K", text), (2, "b", "6-K", text), (3, None, "8-K", text)], "doc_id bigint, accession string, form string, text string")
    got = rows(E.filing_events(filings, docs), "accession", "event_type", "filed", "items", "sentence")
    assert got == sorted([("a", "cfo_change", "2020-01-02", None, text), ("a", "leadership", "2020-01-02", "5.02", text), ("b", "cfo_change", "2020-01-03", None, text), ("b", "management_change", "2020-01-03", None, text), ("c", "bankruptcy", None, "1.03", None)], key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


@pytest.mark.parametrize(
    "text, want",
    [
        ("an exercise price of US$1.30 per share for 2,500,000 Class A ordinary shares", [("exercise_price", 1.3, None), ("shares", 2.5e6, "A")]),
        ("at $0.85 per ordinary share, par value $0.0001 per share", [("price_per_share", 0.85, None)]),
        ("1,200,000 pre-funded warrants and warrants to purchase up to 300,000 shares", [("warrants", 1.2e6, None), ("warrants", 3e5, None)]),
        ("gross proceeds of $12.5 million, less 7% and $40,000", [("money", 12.5e6, None), ("percent", 7.0, None), ("money", 4e4, None)]),
        ("in 2020 there were 12 items", []), ("", []), (None, []),
    ],
)
def test_typed_figures(text, want):
    got = T.figures_of(text)
    assert [(k, v, c) for k, _, v, _, c in got] == want
    assert all(text[at:].startswith(t) for _, t, _, at, _ in got)
    assert [at for *_, at, _ in got] == sorted(at for *_, at, _ in got)


def test_paragraph_marks(spark):
    text = "F-12\n\n- 4 -\n\nxiv\n\nPage 3 of 10\n\nBody one.\n\nTable of Contents\n\n" + "w" * 70 + "\n\ngoes on here\n\nAnd ends."
    got = spark.createDataFrame([(text,)], "t string").select(T.paragraphs(F.col("t")).alias("p")).first().p
    assert got == ["Body one.", "w" * 70 + " goes on here", "And ends."]


def test_many_paragraphs_are_quick(spark):
    import time

    text = "\n\n".join(f"Block {i} ends." for i in range(60_000))
    df = spark.createDataFrame([(text,)], "t string")
    start = time.time()
    assert df.select(F.size(T.sentences(F.col("t"))).alias("n")).first().n == 60_000
    assert time.time() - start < 20


def test_topics(spark):
    text = (
        "We had 12,345,678 common shares outstanding as of June 5, 2024. We entered into an equity distribution agreement to sell shares from time to time. "
        "There is substantial doubt about our ability to continue as a going concern. The purchase price is the lower of two prices. We may offer and sell up to $50,000,000 of securities. "
        "The aggregate market value held by non-affiliates was small. Fractional warrants expire in 2029 at the exercise price. Acme acts as placement agent. We withdrew the registration statement."
    )
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = {(r.topic, r.kind) for r in V.statements(df).collect()}
    assert got == {
        ("shares_outstanding", None), ("offering", "atm"), ("going_concern", None), ("equity_line_terms", None), ("shelf", None), ("warrants", None), ("agent", None), ("withdrawal", None),
    }
    assert str(V.statements(df).where("topic = 'shares_outstanding'").first().as_of) == "2024-06-05"
    assert rows(V.going_concerns(df), "doc_id", "pos") == [(1, 2)]
