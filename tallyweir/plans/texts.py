"""Queries over filing texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.functions.keys import accession_18
from tallyweir.functions.texts import collapsed, figures, item_numbers, money, sentences, snippet
from tallyweir.operators import documents as D
from tallyweir.operators import events as E
from tallyweir.operators import evidence as V
from tallyweir.operators.incremental import bodies
from tallyweir.plans.facts import FILINGS_SQL, filings
from tallyweir.session import fresh_path, spread
from tallyweir.sources.tables import table

QUERIES, SQL = {}, {}


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


@_query(r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(t) AS digest, length(t) AS n FROM c""")
def collapse_ws(spark: SparkSession, d: str) -> DataFrame:
    plain = collapsed(F.col("text"))
    return _docs(spark, d).where("text is not null").select("doc_id", F.md5(plain).alias("digest"), F.length(plain).cast("bigint").alias("n"))


@_query(r"""SELECT filing_id, array_to_string(list_sort(list_distinct(regexp_extract_all(item_list, '\b([1-9]\.[0-9]{2})\b', 1))), ',') AS items FROM filings
WHERE item_list IS NOT NULL""")
def item_numbers_of(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "filings").where("item_list is not null")
    return f.select("filing_id", F.array_join(item_numbers(F.col("item_list")), ",").alias("items"))


@_query(r"""SELECT filing_id, item, CASE item WHEN '1.01' THEN 'material_agreement' WHEN '1.02' THEN 'agreement_termination' WHEN '1.03' THEN 'bankruptcy' WHEN '2.01' THEN 'merger'
WHEN '2.02' THEN 'earnings' WHEN '2.03' THEN 'debt' WHEN '2.04' THEN 'debt' WHEN '3.01' THEN 'delisting' WHEN '3.02' THEN 'financing' WHEN '3.03' THEN 'capitalization'
WHEN '4.01' THEN 'auditor_change' WHEN '4.02' THEN 'non_reliance_restatement' WHEN '5.01' THEN 'merger' WHEN '5.02' THEN 'leadership' WHEN '5.03' THEN 'capitalization'
WHEN '5.07' THEN 'shareholder_vote' END AS event_type FROM (SELECT filing_id, unnest(list_distinct(regexp_extract_all(item_list, '\b([1-9]\.[0-9]{2})\b', 1))) AS item FROM filings)
WHERE event_type IS NOT NULL""")
def events_from_items(spark: SparkSession, d: str) -> DataFrame:
    return E.item_events(table(spark, d, "filings"), "filing_id")


@_query(r"""SELECT delivery_id, regexp_extract(filing_url, '/([0-9]{18})/', 1) AS accession, regexp_extract(filing_url, '/data/([0-9]+)/', 1) AS cik FROM feed WHERE filing_url IS NOT NULL""")
def accession_extract(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "feed").where("filing_url is not null")
    return f.select("delivery_id", F.regexp_extract("filing_url", r"/([0-9]{18})/", 1).alias("accession"), F.regexp_extract("filing_url", r"/data/([0-9]+)/", 1).alias("cik"))


@_query("""SELECT doc_id, substring(text, greatest(1, instr(lower(text), 'going concern') - 50), 200) AS snippet FROM documents WHERE instr(lower(text), 'going concern') > 0""")
def going_concern_mentions(spark: SparkSession, d: str) -> DataFrame:
    found = snippet(F.col("text"), "going concern", 200)
    return _docs(spark, d).select("doc_id", found.alias("snippet")).where("snippet is not null")


@_query(r"""WITH t AS (SELECT doc_id, form, filed, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL AND filed >= DATE '2018-01-01'),
h AS (SELECT *, len(list_filter(range(1, len(w)), lambda i: w[i] = 'registration' AND w[i + 1] = 'statement')) AS hits FROM t)
SELECT doc_id, form, filed, hits, CASE WHEN instr(lower(text), 'registration statement') > 0 THEN substring(text, greatest(1, instr(lower(text), 'registration statement') - 50), 200) END AS snippet FROM h WHERE hits > 0""")
def body_search(spark: SparkSession, d: str) -> DataFrame:
    """A phrase looked up in a written index, with form, day and snippet, newest first."""
    path = fresh_path(spark, "index")
    D.write_index(_docs(spark, d), path)
    docs = table(spark, d, "documents").select("doc_id", "form", "filed", "text")
    return D.search(D.read_index(spark, path, "registration statement"), docs, "registration statement", since="2018-01-01")


@_query()
def going_concern(spark: SparkSession, d: str) -> DataFrame:
    """The sentence in which a text doubts the going concern."""
    return V.going_concerns(_docs(spark, d))


@_query()
def report_leads(spark: SparkSession, d: str) -> DataFrame:
    return E.report_leads(_docs(spark, d))


@_query()
def filing_events(spark: SparkSession, d: str) -> DataFrame:
    """What item numbers and texts say happened, filing by filing, newest first."""
    docs = table(spark, d, "documents").select("doc_id", accession_18(F.col("accession")).alias("accession"), "form", "text")
    return E.filing_events(filings(spark, d).select("accession", "form", "filed", "item_list"), docs).orderBy(F.desc("filed"), "accession", "event_type")


@_query("""SELECT doc_id, substring(text, greatest(1, instr(lower(text), 'reverse split') - 40), 160) AS snippet FROM documents WHERE instr(lower(text), 'reverse split') > 0""")
def keyword_snippet(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", snippet(F.col("text"), "reverse split", 160).alias("snippet")).where("snippet is not null")


@_query("""SELECT doc_id, (p * 2000)::BIGINT AS page_start, md5(substring(text, p * 2000 + 1, 2000)) AS digest, CASE WHEN (p + 1) * 2000 < length(text) THEN ((p + 1) * 2000)::BIGINT END AS next_offset
FROM (SELECT doc_id, text, unnest(range(0, greatest(1, (length(text) + 1999) // 2000))) AS p FROM documents WHERE text IS NOT NULL)""")
def paged_text(spark: SparkSession, d: str) -> DataFrame:
    """All texts in pages of 2,000 characters, with the offset of the next page."""
    docs = _docs(spark, d).where("text is not null")
    pages = docs.select("doc_id", "text", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr("(length(text) - 1) div 2000")))).alias("p"))
    start = F.col("p") * 2000
    return pages.select(
        "doc_id", start.cast("bigint").alias("page_start"), F.md5(F.substr("text", (start + 1).cast("int"), F.lit(2000))).alias("digest"),
        F.when(start + 2000 < F.col("n"), (start + 2000).cast("bigint")).alias("next_offset"),
    )


@_query(r"""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x) AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, n AS hits FROM (SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'registration' AND w[i + 1] = 'statement')) AS n FROM t) WHERE n > 0""")
def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    return D.phrase_hits(D.token_index(_docs(spark, d)), "registration statement")


@_query(r"""SELECT doc_id, len(regexp_extract_all(text, '\$\s?[0-9][0-9,]*(?:\.[0-9]+)?(?:\s(?:thousand|million|billion))?')) AS n_amounts FROM documents WHERE text IS NOT NULL""")
def money_counts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(money(F.col("text"))).cast("bigint").alias("n_amounts"))


# The byte behind the cut must begin a character; at most three steps back it does.
_M = 4194304
_CUT_SQL = " ".join(f"WHEN NOT (b[{_M + 1 - k}:{_M + 1 - k}] >= '\\x80'::BLOB AND b[{_M + 1 - k}:{_M + 1 - k}] < '\\xC0'::BLOB) THEN b[1:{_M - k}]" for k in range(4))


@_query(f"""WITH k AS (SELECT doc_id, text, CASE WHEN strlen(text) > {_M} THEN encode(text) END AS b FROM documents WHERE text IS NOT NULL AND text <> ''),
c AS (SELECT doc_id, text, CASE WHEN b IS NOT NULL THEN CASE {_CUT_SQL} END END AS cut FROM k)
SELECT doc_id, coalesce(octet_length(cut), strlen(text)) AS body_length, cut IS NOT NULL AS truncated, coalesce(md5(cut), md5(text)) AS digest FROM c""")
def body_rows(spark: SparkSession, d: str) -> DataFrame:
    """The body of every text; one over 4 MiB is cut between characters and marked."""
    docs = _docs(spark, d).where("text is not null and text <> ''")
    return bodies(docs).select("doc_id", F.col("body_length").cast("bigint").alias("body_length"), "truncated", F.md5("body").alias("digest"))


@_query()
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sentences and their total length of every text."""
    docs = _docs(spark, d).select("doc_id", sentences(F.col("text")).alias("s"))
    return docs.select("doc_id", F.size("s").alias("n_sentences"), F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("n_chars"))


@_query()
def text_events(spark: SparkSession, d: str) -> DataFrame:
    return E.text_events(_docs(spark, d))


@_query()
def grep_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that speak of a purchase agreement, with the ones around them."""
    s = _docs(spark, d).select("doc_id", sentences(F.col("text")).alias("s")).select("doc_id", "s", F.posexplode("s").alias("pos", "sentence"))
    hits = s.where(F.col("sentence").rlike(r"(?i)purchase agreement"))
    return hits.select("doc_id", "pos", "sentence", F.get("s", F.col("pos") - 1).alias("before"), F.get("s", F.col("pos") + 1).alias("after"))


@_query()
def typed_figures(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(figures(F.col("text"))).alias("pos", "f")).select("doc_id", "pos", "f.type", "f.text", "f.value", "f.start", "f.share_class")


@_query()
def item_sections(spark: SparkSession, d: str) -> DataFrame:
    return D.item_sections(_docs(spark, d))


@_query()
def plain_texts(spark: SparkSession, d: str) -> DataFrame:
    """Markup to text of every document, as its length in characters."""
    return _docs(spark, d).select("doc_id", F.length(D.document_text("text")).alias("n_chars"))


@_query()
def share_statements(spark: SparkSession, d: str) -> DataFrame:
    """All statements about shares, each sentence of a text once a topic."""
    return V.statements(_docs(spark, d), most=None).select("doc_id", "topic", "pos", "sentence", "as_of", "ratio", "kind", F.size("figures").alias("n_figures"))


@_query()
def earnings_highlights(spark: SparkSession, d: str) -> DataFrame:
    return V.earnings_highlights(_docs(spark, d))


@_query()
def governance_fields(spark: SparkSession, d: str) -> DataFrame:
    return V.governance(_docs(spark, d)).select("doc_id", "board_size", F.size("audit_fees").alias("n_fees"), F.array_join("officers", ",").alias("officers"))


@_query(r"""SELECT doc_id, CASE WHEN regexp_extract(text, '(?i)\b(?:1|one)-for-([0-9]{1,5})\b', 1) <> '' THEN '1-for-' || regexp_extract(text, '(?i)\b(?:1|one)-for-([0-9]{1,5})\b', 1)
WHEN regexp_extract(text, '(?i)\b([0-9]{1,5})-for-(?:1|one)\b', 1) <> '' THEN regexp_extract(text, '(?i)\b([0-9]{1,5})-for-(?:1|one)\b', 1) || '-for-1' END AS ratio FROM documents WHERE ratio IS NOT NULL""")
def split_ratios(spark: SparkSession, d: str) -> DataFrame:
    """The first reverse-split ratio that each text names."""
    return _docs(spark, d).select("doc_id", V.split_ratio(F.col("text")).alias("ratio")).where("ratio is not null")


@_query(f"""WITH {FILINGS_SQL}, n AS (SELECT filing_id, file_number FROM filings WHERE file_number IS NOT NULL AND file_number <> '')
SELECT file_number, min(cik) AS cik, count(*) AS n, sum(CASE WHEN form LIKE '%/A' THEN 1 ELSE 0 END)::BIGINT AS amendments, min(filed) AS first_filed, max(filed) AS last_filed,
array_to_string(list_sort(list(DISTINCT form)), ',') AS forms, max(form = 'EFFECT') AS effective FROM g JOIN n USING (filing_id) GROUP BY file_number""")
def registration_history(spark: SparkSession, d: str) -> DataFrame:
    numbers = table(spark, d, "filings").select("filing_id", "file_number")
    return V.registrations(filings(spark, d).join(numbers, "filing_id"))
