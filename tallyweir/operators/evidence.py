"""Statements that filing texts make about shares and offerings, and fields of
proxies and earnings releases, each with the words it was read from.

What a topic sounds like is a vocabulary and how close its words stand
(``functions.wording``). Topics are tested on exploded sentences inside the JVM; a
statement keeps its sentence, so no figure is without its source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweir.functions.texts import clipped, collapsed, figures
from tallyweir.functions.wording import Clause, Saying, said, sayings, worded
from tallyweir.operators.events import EVENTS, SPLITS, sentence_rows

SHARES = (
    "ordinary shares", "common shares", "shares of common stock", "shares of our common stock", "shares of its common stock", "shares of the company s common stock", "shares of outstanding common stock",
    "shares of class * common stock", "shares of our class * common stock", "shares of voting common stock", "shares of non voting common stock", "american depositary shares", "adss",
)
OFFERED = ("entered into", "enters into", "we are offering", "is offering", "relates to an offering", "closed", "closing of", "consummated", "priced", "pricing of", "agreed to sell", "agreed to issue", "agreed to purchase", "offer and sale", "offer and sell", "gross proceeds")
# Kinds of raising, the more specific first.
KINDS = (
    Saying("equity_line", (Clause(("standby equity purchase agreement", "equity line", "committed equity", "equity purchase agreement")), Clause(("purchase agreement",), ("from time to time",), 30))),
    Saying("atm", (Clause(("at the market", "atm", "equity distribution agreement", "open market sale agreement", "sales agreement")),)),
    Saying("registered_direct", (Clause(("registered direct",)),)),
    Saying("private_placement", (Clause(("private placement", "private investment in public equity", "pipe")),)),
    Saying("convertible", (Clause(("convertible note*", "convertible promissory note*", "convertible senior note*", "convertible debenture*", "convertible preferred")),)),
    Saying("public_offering", (Clause(("underwritten", "underwriting agreement", "public offering", "follow on offering", "best efforts")),)),
)
_ANY_KIND = tuple(p for k in KINDS for c in k.clauses for p in c.one)
_UNLESS_SPLIT = (*next(e for e in EVENTS if e.name == "reverse_split").unless, "no fractional", "we may effect", "we may implement", "could effect", "could implement", "if approved")
TOPICS = (
    Saying(
        "shares_outstanding",
        (Clause(SHARES, ("outstanding",), 14, number=4), Clause(("there were", "there are", "we had", "had", "has"), ("outstanding",), 16, number=4), Clause(("consisting of", "comprised of", "comprising"), SHARES, 4, number=4),
         Clause(("outstanding before", "outstanding prior to", "outstanding after", "outstanding immediately after"), ("#",), 8, number=4)),
        ("authorized", "authorised", "beneficial ownership limitation", "weighted average", "net tangible book value", "would have been", "issuable", "underlying", "reserved for", "subject to"),
    ),
    Saying("offering", (Clause(OFFERED, (*_ANY_KIND, "purchase agreement", "gross proceeds", "offering price"), 50), Clause(_ANY_KIND, OFFERED, 32))),
    Saying(
        "equity_line_terms",
        (Clause(("lower of", "of the lowest", "of the average", "of the closing", "of the vwap", "of the volume", "floor price", "commitment shares", "commitment fee", "commitment amount", "prepaid advance", "pre paid advance", "advance notice",
                 "direct the investor to purchase", "right but not the obligation to sell")),),
    ),
    Saying(
        "shelf",
        (Clause(("baby shelf", "general instruction i b 5", "general instruction i b 6", "public float", "held by non affiliates", "offer and sell up to $*", "offer and sell up to us $*")), Clause(("shelf registration", "registration statement"), ("up to $*", "up to us $*", "up to us$*"), 32)),
        ("smaller reporting company", "accelerated filer", "emerging growth company", "minimum listing maintenance"),
    ),
    Saying("reverse_split", (Clause(SPLITS), Clause(("consolidation of",), ("shares", "share capital"), 18)), _UNLESS_SPLIT),
    Saying(
        "warrants",
        (Clause(("# warrants", "# pre funded warrants", "# prefunded warrants", "# common warrants", "# ordinary warrants")), Clause(("warrants to purchase", "warrants for"), ("#",), 6),
         Clause(("warrant", "warrants"), ("exercise price", "exercisable", "cashless", "expire", "expires", "exchange all", "exchange any"), 34)),
        ("we may offer", "may be offered", "description of warrants", "debt securities warrants"),
    ),
    Saying("agent", (Clause(("agent",), ("commission", "commissions"), 32), Clause(("placement agent", "sales agent", "book running manager", "as underwriter", "as the underwriter"))), ("transfer agent",)),
    Saying("going_concern", (Clause(("substantial doubt",), ("going concern",), 28, True),)),
    Saying("withdrawal", (Clause(("withdraw*", "withdrew", "rescind*", "deregister*")),)),
)
#: Statements kept of each topic in one text, unless all are asked for.
PER_TOPIC = 8


def split_ratio(sentence: Column) -> Column:
    """'148-for-1' or '1-for-148'; NULL without a ratio."""
    down = F.regexp_extract(sentence, r"(?i)\b(?:1|one)-for-(\d{1,5})\b", 1)
    up = F.regexp_extract(sentence, r"(?i)\b(\d{1,5})-for-(?:1|one)\b", 1)
    return F.when(down != "", F.concat(F.lit("1-for-"), down)).when(up != "", F.concat(up, F.lit("-for-1")))


def statements(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int | None = PER_TOPIC) -> DataFrame:
    """``doc_id, topic, pos, sentence, as_of, ratio, figures``: the first ``most``
    statements of each topic in each text (all where it is None), with the day they
    name and their figures. A sentence that recurs in a text counts once."""
    rows = sentence_rows(documents, doc_id, text).withColumn("words", worded(F.col("sentence")))
    words, sentence = F.col("words"), F.col("sentence")
    kind = F.element_at(F.concat(sayings(words, KINDS), F.array(F.lit(None).cast("string"))), 1)
    found = rows.select("doc_id", "pos", "sentence", kind.alias("kind"), F.explode(sayings(words, TOPICS)).alias("topic"))
    first = found.groupBy("doc_id", "topic", "sentence").agg(F.min("pos").alias("pos"), F.first("kind").alias("kind"))
    if most is not None:
        first = first.withColumn("_k", F.row_number().over(W.partitionBy("doc_id", "topic").orderBy("pos"))).where(F.col("_k") <= most)
    place = F.lit(1)
    for t in TOPICS:
        place = F.when(F.col("topic") == t.name, t.place(sentence)).otherwise(place)
    return first.select(
        "doc_id", "topic", "pos", F.when(F.length(sentence) <= 600, sentence).otherwise(clipped(sentence, 600, place)).alias("sentence"), day_named(sentence).alias("as_of"),
        F.when(F.col("topic") == "reverse_split", split_ratio(sentence)).alias("ratio"), F.when(F.col("topic") == "offering", F.col("kind")).alias("kind"), figures(sentence).alias("figures"),
    )


def day_named(sentence: Column) -> Column:
    """The day that "as of" names, written with the month's name; NULL without one."""
    words = F.split(F.substring_index(F.regexp_replace(sentence, "(?i)as of ", "\u0003"), "\u0003", -1), " ")
    said = F.array_join(F.slice(words, 1, 3), " ")
    return F.when(F.lower(sentence).contains("as of "), F.try_to_date(F.regexp_replace(said, "[.;:)]+$", ""), "MMMM d, yyyy"))


def going_concerns(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, pos, sentence`` of the first sentence of each text that doubts the
    going concern: the doubt and the concern stand near each other."""
    rule = next(t for t in TOPICS if t.name == "going_concern")
    rows = sentence_rows(documents, doc_id, text).where(F.lower("sentence").contains("going concern"))
    hits = rows.where(rule.test(worded(F.col("sentence"))))
    return hits.groupBy("doc_id").agg(F.min("pos").alias("pos"), F.min_by("sentence", "pos").alias("sentence"))


# What an earnings sentence speaks of.
EARNINGS_WORDS = ("revenue", "net income", "net loss", "ebitda", "guidance", "outlook", "cash flow", "margin", "earnings per share")


def earnings_highlights(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = 12) -> DataFrame:
    """``doc_id, pos, highlight``: narrative sentences about results, table rows left
    out (many numbers, more digits than prose has, repeated period labels)."""
    pieces = F.posexplode(F.split(F.col(text), r"(?<=[.!?])\s+")).alias("pos", "raw")
    rows = documents.select(F.col(doc_id).alias("doc_id"), pieces).withColumn("s", collapsed(F.col("raw"))).where(F.length("s").between(1, 600))
    low = F.lower("s")
    digits, letters = F.length(F.regexp_replace("s", r"[^0-9]", "")), F.length(F.regexp_replace("s", r"[^\p{L}]", ""))
    kept = (
        rows.where(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in EARNINGS_WORDS])).where(digits > 0)
        .where(F.size(F.regexp_extract_all("s", F.lit(r"\$?\d[\d,]*(?:\.\d+)?%?"), 0)) <= 6)
        .where(F.size(F.regexp_extract_all("s", F.lit(r"\bQ[1-4]\b"), 0)) < 2)
        .where((letters == 0) | (digits / F.greatest(letters, F.lit(1)) <= 0.4))
    )
    single = kept.groupBy("doc_id", "s").agg(F.min("pos").alias("pos"))
    ranked = single.withColumn("_k", F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))).where(F.col("_k") <= most)
    return ranked.select("doc_id", "pos", F.substring("s", 1, 420).alias("highlight"))


# Number words of board sizes.
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen")
# The fees a proxy states.
FEES = ("audit fees", "audit-related fees", "tax fees", "all other fees")


def audit_fees(text: Column) -> Column:
    """array<struct<label, usd>> of stated fees between 10,000 and 200 million.

    The text is cut before each label; the first amount behind a label, no
    further than its line goes, is the fee.
    """
    low = F.lower(collapsed(F.regexp_replace(text, "\n", " \u0004 ")))
    cut = F.split(low, "(?=(?:audit|audit-related|tax|all other) fees)")
    label = lambda p: F.coalesce(*[F.when(p.startswith(f), F.lit(f)) for f in FEES])
    amount = lambda p: F.regexp_replace(F.regexp_extract(F.substring(p, 1, 60), r"fees(?: \(1\))?[^0-9a-z]*([0-9,]{5,})", 1), ",", "").try_cast("bigint")
    pairs = F.transform(cut, lambda p: F.struct(label(p).alias("label"), amount(p).alias("usd")))
    return F.filter(pairs, lambda p: p["label"].isNotNull() & p["usd"].between(10_000, 200_000_000))


def board_size(text: Column) -> Column:
    """The stated number of directors, if it is between 3 and 30."""
    words = worded(text)
    behind = F.coalesce(
        F.nullif(F.regexp_extract(words, " board of directors (?:currently )?consists of ([a-z0-9]+) (?:[0-9]+ )?(?:directors?|members?) ", 1), F.lit("")),
        F.nullif(F.regexp_extract(words, " currently have ([a-z0-9]+) (?:[0-9]+ )?(?:directors?|members?) ", 1), F.lit("")),
    )
    place = F.array_position(F.array(*[F.lit(w) for w in NUMBER_WORDS]), behind).cast("int")
    size = F.coalesce(behind.try_cast("int"), F.nullif(place, F.lit(0)))
    return F.when(size.between(3, 30), size)


def proposals(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, number, title``: numbered proposals, the first heading of each number;
    a mention within a sentence, which goes on in lower case, is no heading."""
    pattern = r"\b(?:Proposal|PROPOSAL)\s+(?:No\.?\s+)?(\d{1,2})[\s:.–—-]*([^\n.?]{4,120})"
    numbers, titles = (F.regexp_extract_all(F.col(text), F.lit(pattern), i) for i in (1, 2))
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.zip_with(numbers, titles, lambda n, t: F.struct(n.cast("int").alias("number"), F.trim(t).alias("title")))).alias("pos", "p"))
    named = rows.select("doc_id", "pos", "p.*").where("number between 1 and 20").where(~F.col("title").rlike(r"^\p{Ll}"))
    return named.groupBy("doc_id", "number").agg(F.min_by("title", "pos").alias("title"))


def governance(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, board_size, audit_fees, officers`` of the texts that state any."""
    body = F.col(text)
    titles = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(r"(?i)\b(chief\s+(?:executive|financial|operating)\s+officer)\b"), 1), lambda t: F.lower(collapsed(t)))))
    out = documents.select(F.col(doc_id).alias("doc_id"), board_size(body).alias("board_size"), audit_fees(body).alias("audit_fees"), titles.alias("officers"))
    return out.where("board_size is not null or size(audit_fees) > 0 or size(officers) > 0")


def registrations(filings: DataFrame) -> DataFrame:
    """Per file number: its filer, number of filings and amendments, first and last
    day, the forms filed under it, and whether it was declared effective."""
    return filings.where("file_number is not null and file_number <> ''").groupBy("file_number").agg(
        F.min("cik").alias("cik"), F.count(F.lit(1)).alias("n"), F.sum(F.col("form").endswith("/A").cast("bigint")).alias("amendments"), F.min("filed").alias("first_filed"),
        F.max("filed").alias("last_filed"), F.array_join(F.array_sort(F.collect_set("form")), ",").alias("forms"), F.max(F.col("form") == "EFFECT").alias("effective"),
    )
