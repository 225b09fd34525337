"""Event types of filing text, each with the sentence it was read from.

What an event sounds like is written down as vocabularies and how close their
words stand (``functions.wording``), not as one pattern an event. A report is
first cut to its body: cover, signatures, disclaimers, exhibit list and mere
references to exhibits state no event. Sentences are exploded, all sayings are
tested in one pass by the JVM, and the best sentence per document and type is kept
by an aggregation that combines partially.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweir.functions.texts import clipped, cut_sentences, item_numbers, paragraphs, sentences
from tallyweir.functions.wording import Clause, Saying, let, near, said, sayings, worded
from tallyweir.session import spread

# What parties do.
SIGN = ("entered into", "enters into", "has entered", "signed", "executed")
CLOSE = ("closing of", "closed", "complet*", "consummat*")
TELL = ("announc*",)
APPROVE = ("approv*", "adopt*", "passed", "resolved")
LEAVE = ("resign*", "resignation", "step down", "stepped down", "steps down", "retire", "retires", "retired", "retirement", "removed as", "ceased to be", "ceased to serve", "employment terminated", "termination of employment")
JOIN = ("appoint*", "was elected", "was named", "were elected", "elected as", "named as", "named")
HEAR = ("received", "notif*", "notice", "deficien*", "not in compliance", "failed to", "failed")
# What they do it to.
RAISING = (
    "securities purchase agreement", "subscription agreement", "equity purchase agreement", "equity line", "at the market", "equity distribution agreement", "sales agreement",
    "underwriting agreement", "placement agency agreement", "placement agent agreement", "registered direct offering", "private placement", "public offering", "follow on offering",
    "rights offering", "convertible note*", "convertible promissory note*", "convertible senior note*", "convertible debenture*", "pre funded warrant*", "prefunded warrant*",
    "loan agreement", "credit agreement", "credit facility", "warrant inducement agreement", "warrant exercise agreement",
)
NOTES = ("senior note*", "convertible note*", "promissory note*", "senior convertible note*", "convertible promissory note*", "convertible senior note*")
OWNED = ("subsidiar*", "business unit", "all of its shares", "all of the shares", "all of its assets", "all of the assets", "all of its equity", "all of the equity", "all of its interest*", "equity interest*", "entire interest*", "its interest in", "its interests in", "its stake in", "entire stake", "substantially all")
MERGING = ("merger agreement", "acquisition agreement", "agreement to acquire", "agreement and plan of merger", "business combination")
VENUES = ("nasdaq", "nyse", "new york stock exchange", "exchange")
ROLES = ("director", "directors", "officer", "officers", "chief *", "chairman", "chairwoman", "chairperson", "chair", "president", "ceo", "cfo", "coo", "cto", "company secretary")
CHARTER = ("memorandum and articles of association", "memorandum of association", "articles of association", "articles of incorporation", "bylaws", "by laws")
ACCOUNTANTS = ("independent registered public accounting firm", "independent auditor", "independent auditors")
HOLDERS = ("shareholders", "stockholders")
AGAIN = ("reappoint*", "re appoint*", "reelect*", "re elect*")
SPLITS = ("reverse stock split", "reverse share split", "reverse split", "share consolidation", "# for 1", "# for one", "1 for #", "one for #")
PERIODS = ("interim", "unaudited", "half year*", "first half", "second half", "six month*", "three month*", "nine month*", "quarter*", "fiscal year", "full year", "annual")
RESULTS = ("financial statements", "financial results", "results of operations", "earnings release", "operating results")
SHORT_OF = (
    "not in compliance", "no longer in compliance", "no longer complies", "no longer compliant", "did not meet", "does not meet", "does not satisfy", "does not comply", "was below", "deficien*",
    "delisting determination", "notice of delisting", "failed to meet", "failed to satisfy", "failed to comply", "failed to maintain",
)
GUIDES = ("provid*", "issu*", "updat*", "rais*", "lower*", "reaffirm*", "withdr*", "suspend*", "announc*", "maintain*")
MEASURES = ("revenue", "revenues", "net income", "earnings", "sales", "ebitda", "eps")
DELISTED = ("delisted", "will delist", "will suspend trading", "suspended trading")

EVENTS = (
    Saying("financing", (Clause(SIGN + CLOSE + TELL + ("priced", "pricing of", "approv*", "agreed to sell", "agreed to issue", "agreed to purchase"), RAISING, 60), Clause(RAISING, SIGN + CLOSE + TELL, 30))),
    Saying("material_agreement", (Clause(SIGN[:3], ("agreement",), 25),), RAISING),
    Saying("divestiture", (Clause(("sold", "sell", "sale of", "dispos*", "divest*"), OWNED, 32), Clause(('the " divestiture "', 'the " disposal "', 'the " disposition "', '" divestiture "')))),
    Saying(
        "reverse_split",
        (Clause(SPLITS, APPROVE + TELL + ("effect*", "implement*", "consolidated into", "begin trading", "commence trading"), 55, True), Clause(("consolidation of",), ("shares", "share capital"), 18)),
        ("if necessary", "including by effecting", "subject to adjustment", "adjusted for", "adjustment for", "adjustments for", "adjusted upon", "adjustment upon", "in the event of", "such as share", "such as stock", "may need to", "may be required to", "may elect to"),
    ),
    Saying("name_change", (Clause(("chang*",), ("name",), 5), Clause(("renamed", "name change", "now known as")))),
    Saying("redomicile", (Clause(("by way of continuation", "continuation from", "continuation to", "continuation into", "continuation as a", "redomicil*", "re domicil*", "reincorporat*", "domesticat*")), Clause(("change of", "change in", "chang*"), ("jurisdiction of incorporation", "domicile of incorporation", "place of incorporation"), 4))),
    Saying("listing_deficiency", (Clause(VENUES[:3] + ("listing", "minimum bid"), SHORT_OF, 60, True),), ("regained compliance",)),
    Saying("listing_compliance", (Clause(("regained compliance",)), Clause(("confirm*",), ("in compliance", "compliance with"), 16))),
    Saying(
        "shareholder_vote",
        (Clause(("voting results", "submission of matters to a vote", "of business was acted upon", "of business were acted upon")), Clause(HOLDERS, ("approved", "voted", "passed", "adopted"), 0),
         Clause(("resolution", "resolutions"), ("passed", "approved", "adopted"), 2), Clause(("results of",), ("meeting",), 5), Clause(("was approved", "were approved", "was passed", "were passed", "was adopted", "were adopted"), HOLDERS + ("at the annual", "at the meeting", "at the extraordinary"), 5)),
    ),
    Saying(
        "shareholder_meeting_notice",
        (Clause(TELL + ("will hold", "to hold", "will be held", "notice of", "conven*"), ("general meeting", "annual meeting", "special meeting", "meeting of shareholders", "meeting of the shareholders", "meeting of stockholders"), 24), Clause(("notice and proxy statement", "form of proxy card"))),
        ("voting results", "was held", "held the", "acted upon"),
    ),
    Saying("authorized_capital_change", (Clause(("authorized share capital", "authorised share capital", "authorized shares", "authorised shares"), ("increas*", "decreas*", "reduc*", "chang*", "divided into"), 40, True),)),
    Saying("charter_amendment", (Clause(("adopt", "adopts", "adopted", "adoption", "filed", "approved", "replaced", "amendment to", "amendments to", "amendment of", "amendments of"), CHARTER, 24), Clause(CHARTER, ("hereby", "was approved", "were approved", "was adopted", "were adopted"), 30))),
    Saying("management_change", (Clause(LEAVE + JOIN, ROLES, 40, True),), (*ACCOUNTANTS[:1], "transfer agent", "placement agent", "auditor", "auditors", *AGAIN)),
    Saying("auditor_change", (Clause(("dismiss*", "resign*", "engag*", "appoint*", "replac*"), ACCOUNTANTS, 30),)),
    Saying("financial_results", (Clause(PERIODS, RESULTS, 24), Clause(("financial results for the",)), Clause(TELL, ("financial results", "operating results", "unaudited results"), 12)), ("pro forma",)),
    Saying("merger", (Clause(SIGN + TELL + CLOSE + ("approv*",), MERGING, 40), Clause(("merger", "acquisition", "business combination"), ("has closed", "was completed", "was consummated", "has been completed"), 15)), ("terminat*", "abandon*")),
    Saying("agreement_termination", (Clause(("terminated", "termination of"), ("agreement", "merger"), 15), Clause(("agreement", "merger"), ("was terminated", "has been terminated"), 15)), ("may terminate", "right to terminate")),
    Saying("bankruptcy", (Clause(("filed", "commenced"), ("chapter 7", "chapter 11", "bankruptcy", "voluntary petition"), 15), Clause(("appointed", "appointment of"), ("receiver",), 10)), ("may file", "risk of bankruptcy")),
    Saying("debt", (Clause(SIGN[:1] + ("signed", "executed", "approv*") + TELL + CLOSE, ("credit agreement", "credit facility", "loan agreement", "indenture", *NOTES), 28), Clause(("issued", "sold"), NOTES, 12))),
    Saying("guidance", (Clause(GUIDES, ("guidance", "outlook", "forecast"), 12), Clause(("expect", "expects", "projects", "forecasts"), MEASURES, 12, number=1)), ("does not provide", "does not issue", "not providing", "no guidance", "no forecast", "actual results", "forward looking")),
    Saying("delisting", (Clause(VENUES, DELISTED + ("has delisted",), 20), Clause(("was delisted", "has been delisted", "filed form 25", "filed a form 25"))), ("may delist", "may suspend", "could delist", "could suspend", "if the company")),
    Saying("delisting_determination", (Clause(("received", "issued", "notified", "notice of"), ("delisting determination", "determination to delist"), 24), Clause(VENUES, ("determined to delist", "will delist", "will suspend trading"), 24)), ("may delist", "may issue", "could delist", "could result", "regained compliance")),
    Saying("hearing_panel_appeal", (Clause(("requested a", "requested an", "requests a", "has requested", "will request", "intends to request", "plans to request", "filed an appeal", "appealed", "intends to appeal", "filed"), ("nasdaq", "nyse", "hearings panel", "hearing panel"), 26),), ("may request", "right to request", "right to appeal", "may appeal"), ("hearing", "hearings", "appeal", "appealed")),
    Saying("minimum_bid_deficiency", (Clause(HEAR, ("minimum bid", "bid price requirement"), 40, True),), ("regained compliance",)),
    Saying("non_reliance_restatement", (Clause(("concluded", "determined", "advised"), ("no longer be relied upon",), 30), Clause(("will restate", "must restate", "plans to restate"), ("financial statements",), 14))),
    Saying("ceo_change", (Clause(("appointed", "named", "resigned as", "will serve as", "to serve as", "stepped down as", "resigned", "was appointed"), ("chief executive officer", "ceo"), 16, True),), AGAIN),
    Saying("cfo_change", (Clause(("appointed", "named", "resigned as", "will serve as", "to serve as", "stepped down as", "resigned", "was appointed"), ("chief financial officer", "cfo"), 16, True),), AGAIN),
)

# Item number -> event type.
ITEM_EVENTS = {
    "1.01": "material_agreement", "1.02": "agreement_termination", "1.03": "bankruptcy", "2.01": "merger", "2.02": "earnings", "2.03": "debt",
    "2.04": "debt", "3.01": "delisting", "3.02": "financing", "3.03": "capitalization", "4.01": "auditor_change", "4.02": "non_reliance_restatement",
    "5.01": "merger", "5.02": "leadership", "5.03": "capitalization", "5.07": "shareholder_vote",
}
# What reports of domestic filers call the same things.
DOMESTIC = {"management_change": "leadership", "financial_results": "earnings", "charter_amendment": "capitalization"}
# The length of an informative sentence, and of a snippet.
INFORMATIVE, SNIPPET = 80, 900

_RECAP = tuple(f"as {a} {b}" for a in ("previously", "earlier") for b in ("disclosed", "announced", "reported"))
_COVER = (
    "indicate by check mark", "check the appropriate box", "address of principal executive", "commission file number", "exact name of registrant", "translation of registrant",
    "for the month of", "report of foreign private issuer", "date of report", "emerging growth company", "regulation s t rule 101", "pursuant to rule 13a 16", "form 20 f",
    "securities registered pursuant to section 12", "written communications pursuant to rule 425", "soliciting material pursuant to rule 14a", "pre commencement communications",
    "pursuant to section 13 or 15 d", "washington d c 20549",
)
_COVER_LINES = ("form 6 k", "form 8 k", "form 8 k a", "current report", "united states", "securities and exchange commission")
_DISCLAIMER = (
    "forward looking statement", "forward looking statements", "safe harbor", "private securities litigation reform act", "risks and uncertainties", "risk and uncertainties", "no assurance",
    "undertakes no obligation", "undertake no obligation", "actual results may differ", "actual results could differ", "actual results will differ", "guarantee of future", "guarantees of future",
)
_LISTS = ("exhibit", "exhibits", "exhibit index", "index to exhibits", "index of exhibits", "exhibit no description", "exhibit number description")
_ENCLOSED = ("attached", "furnished", "filed")


def _is_cover(words: Column, block: Column) -> Column:
    return ((F.length(block) < 320) & said(words, _COVER)) | F.trim(words).isin(*_COVER_LINES)


def _refers(words: Column) -> Column:
    """Only points to an exhibit."""
    exhibit = ("exhibit 99*",)
    return near(words, _ENCLOSED, exhibit, 14) | near(words, exhibit, (*_ENCLOSED, "incorporated"), 22) | said(words, ("incorporated herein by reference", "incorporated in this report by reference"))


def report_parts(text: Column) -> Column:
    """struct<body, exhibit_index, items>: the paragraphs that can state events, the
    lines of the exhibit list, and the item numbers that head paragraphs.

    The body ends at the signatures. A disclaimer's heading hides what follows it
    up to the next item; a list of exhibits goes on to the end. One pass over the
    paragraphs, each marked by one letter.
    """

    def mark(block: Column) -> Column:
        def of(words: Column) -> Column:
            plain = F.trim(words)
            signed = plain.isin("signature", "signatures") | said(words, ("has duly caused this report", "pursuant to the requirements of the securities exchange act"))
            heading = (F.length(block) < 90) & said(words, ("forward looking statement", "forward looking statements", "safe harbor", "safe harbor statement")) & ~block.rlike("[a-z] [a-z]+ed ")
            return (
                F.when(signed, "s").when(block.rlike(r"(?i)^item\s+9\.01") | plain.isin(*_LISTS), "x").when(block.rlike(r"(?i)^item\s+[1-9]\.\d\d"), "i")
                .when(heading, "d").when(_is_cover(words, block) | said(words, _DISCLAIMER), "c").otherwise("b")
            )

        return let(worded(block), of)

    def parts(blocks: Column, marks: Column) -> Column:
        """``marks``: one letter a block, up to the signatures."""
        body, lines = F.regexp_extract(marks, "^([^x]*)", 1), F.regexp_extract(marks, "(x.*)$", 1)
        hidden = F.transform(F.regexp_extract_all(body, F.lit("d[^i]*|[^d]"), 0), lambda run: F.when(run.startswith("d"), F.repeat(F.lit("c"), F.length(run))).otherwise(run))
        pairs = F.arrays_zip(F.slice(blocks, 1, F.length(body)).alias("block"), F.split(F.array_join(hidden, ""), "").alias("mark"))
        title = lambda b, m: (m == "i") & (F.length(b) < 260) & (F.size(F.split(b, r"[.!?]\s")) < 2)
        text_of = lambda p: F.when(p["mark"] == "i", F.regexp_replace(p["block"], r"(?i)^item\s+[1-9]\.\d\d[.\s:]*", "")).otherwise(p["block"])
        listed = F.filter(F.slice(blocks, F.length(body) + 1, F.length(lines)), lambda b: ~F.trim(worded(b)).isin(*_LISTS) & ~b.rlike(r"(?i)^item\s+9\.01"))

        def told(kept: Column) -> Column:
            statements = F.transform(F.filter(kept, lambda p: ~title(p["block"], p["mark"])), text_of)
            heads = F.transform(F.filter(kept, lambda p: p["mark"] == "i"), lambda p: F.regexp_extract(p["block"], r"(?i)^item\s+([1-9]\.\d\d)", 1))
            return F.struct(F.filter(statements, lambda b: b != "").alias("body"), listed.alias("exhibit_index"), F.array_distinct(F.filter(heads, lambda h: h != "")).alias("items"))

        return let(F.filter(pairs, lambda p: p["mark"].isin("b", "i")), told)

    return let(paragraphs(text), lambda blocks: let(F.regexp_replace(F.array_join(F.transform(blocks, mark), ""), "s.*$", ""), lambda marks: parts(blocks, marks)))


def sentence_rows(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, pos, sentence``; texts without a sentence have no row."""
    docs = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id")
    return docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))


def report_rows(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, source, pos, sentence, words``: the sentences of each report's body
    and the lines of its exhibit list."""
    docs = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id")
    both = let(report_parts(F.col("text")), lambda p: F.array(
        F.struct(F.lit("body").alias("source"), F.flatten(F.transform(p["body"], cut_sentences)).alias("s")),
        F.struct(F.lit("exhibit_index").alias("source"), p["exhibit_index"].alias("s")),
    ))
    # The words come out of the explosion with their sentence, so that no test computes them anew.
    pieces = F.transform("x.s", lambda s: F.struct(s.alias("sentence"), worded(s).alias("words")))
    rows = docs.select("doc_id", F.explode(both).alias("x")).select("doc_id", "x.source", F.posexplode(pieces).alias("pos", "y"))
    return rows.select("doc_id", "source", "pos", "y.sentence", "y.words")


def text_events(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, event_type, pos, sentence, background, source`` of each event a text states.

    Fresh statements come before recaps, informative sentences before terse ones,
    earlier before later. Types stated only in recaps are dropped where another
    type is stated afresh; a general agreement is dropped where its sentence
    carries a more specific type. The list of exhibits is evidence only where the
    body holds none.
    """
    s, words = F.col("sentence"), F.col("words")
    rows = report_rows(documents, doc_id, text).where((F.col("source") != "body") | ~_refers(words))
    found = sayings(words, EVENTS)
    recap = F.lit(False)
    for r in _RECAP:
        recap = recap | words.startswith(f" {r} ")
    hits = rows.select("doc_id", "source", "pos", "sentence", recap.alias("background"), F.explode(found).alias("event_type"))
    order = F.struct(F.col("source") != "body", F.col("background"), F.length("sentence") < INFORMATIVE, F.col("pos"))
    best = hits.groupBy("doc_id", "event_type").agg(F.min_by(F.struct("source", "pos", "sentence", "background"), order).alias("b")).select("doc_id", "event_type", "b.*")
    whole = best.groupBy("doc_id").agg(F.collect_list(F.struct("event_type", "source", "pos", "sentence", "background")).alias("all"))  # at most one a saying

    def kept_of(every: Column) -> Column:
        told = F.exists(every, lambda x: x["source"] == "body")
        fresh = F.exists(every, lambda x: (x["source"] == "body") & ~x["background"])
        general = lambda x: (x["event_type"] == "material_agreement") & F.exists(every, lambda y: (y["event_type"] != "material_agreement") & (y["source"] == x["source"]) & (y["pos"] == x["pos"]))
        return F.filter(every, lambda x: ((x["source"] == "body") | ~told) & ~(fresh & x["background"]) & ~general(x))

    kept = whole.select("doc_id", F.explode(kept_of(F.col("all"))).alias("x")).select("doc_id", "x.*")
    place = F.lit(1)
    for e in EVENTS:
        place = F.when(F.col("event_type") == e.name, e.place(s)).otherwise(place)
    cut = F.when(F.length(s) <= SNIPPET, s).otherwise(clipped(s, SNIPPET, place))
    return kept.select("doc_id", "event_type", "pos", cut.alias("sentence"), "background", "source")


def report_leads(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lead, body_chars, items, exhibits, needs_exhibit`` of every text: its
    first substantial sentence, and whether the body says nothing itself but points
    to an exhibit, or says nothing at all."""
    docs = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id")

    def lead(p: Column) -> Column:
        def of(s: Column) -> Column:
            def own(own: Column) -> Column:
                states = F.exists(own, lambda x: let(worded(x), lambda w: F.size(sayings(w, EVENTS)) > 0))
                return F.struct(
                    clipped(F.get(F.filter(own, lambda x: F.length(x) >= 40), F.lit(0)), 400).alias("lead"),
                    F.aggregate(own, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("body_chars"), F.array_join(p["items"], ",").alias("items"),
                    F.coalesce(F.size(p["exhibit_index"]), F.lit(0)).alias("exhibits"), (~states & ((F.size(own) == 0) | (F.size(own) < F.size(s)))).alias("needs_exhibit"),
                )

            return let(F.filter(s, lambda x: ~let(worded(x), _refers)), own)

        return let(F.coalesce(F.flatten(F.transform(p["body"], cut_sentences)), F.array().cast("array<string>")), of)

    return docs.select("doc_id", F.explode(F.array(let(report_parts(F.coalesce(F.col("text"), F.lit(""))), lead))).alias("r")).select("doc_id", "r.*")


def item_events(filings: DataFrame, key: str, items: str = "item_list") -> DataFrame:
    """``key, item, event_type`` of the item numbers a filing lists."""
    kinds = F.create_map(*[F.lit(x) for pair in ITEM_EVENTS.items() for x in pair])
    rows = filings.select(key, F.explode(item_numbers(F.col(items))).alias("item"))
    return rows.withColumn("event_type", F.element_at(kinds, F.col("item"))).where("event_type is not null")


def filing_events(filings: DataFrame, documents: DataFrame) -> DataFrame:
    """``accession, event_type, form, filed, items, sentence, background`` of every
    filing: what its item numbers name and what its texts state, united.

    ``filings(accession, form, filed, item_list)``, ``documents(doc_id, accession, form,
    text)``. Item numbers name a kind of disclosure, not an outcome; ``items`` is NULL
    where only a text states the event, ``sentence`` where only an item names it. Of
    several texts the fresh statement, then the first, is kept.
    """
    named = item_events(filings.where("accession is not null"), "accession").select("accession", "event_type", "item", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("sentence"), F.lit(None).cast("boolean").alias("background"))
    names = F.create_map(*[F.lit(x) for pair in DOMESTIC.items() for x in pair])
    homes = documents.where("accession is not null").groupBy("doc_id").agg(F.min("accession").alias("accession"), F.min("form").alias("form"))
    told = text_events(documents.select("doc_id", "text")).join(homes, "doc_id")
    kind = F.when(F.coalesce(F.col("form"), F.lit("")).startswith("6-K"), F.col("event_type")).otherwise(F.coalesce(F.element_at(names, F.col("event_type")), F.col("event_type")))
    stated = told.select("accession", kind.alias("event_type"), F.lit(None).cast("string").alias("item"), F.col("doc_id").cast("bigint").alias("doc_id"), "sentence", "background")
    both = named.unionByName(stated).groupBy("accession", "event_type").agg(
        F.array_join(F.array_sort(F.collect_set("item")), ",").alias("items"),  # item numbers are few
        F.min_by(F.struct("sentence", "background"), F.when(F.col("sentence").isNotNull(), F.struct("background", "doc_id"))).alias("t"),
    )
    about = filings.where("accession is not null").groupBy("accession").agg(F.max_by(F.struct("form", "filed"), F.struct("filed", "form")).alias("f"))
    return both.join(about, "accession", "left").select(
        "accession", "event_type", "f.form", "f.filed", F.nullif("items", F.lit("")).alias("items"), "t.sentence", "t.background"
    )
