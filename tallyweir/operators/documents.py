"""Documents: markup to text, filing index tables, item sections, phrase search."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyweir.functions.texts import normalised, snippet

# Elements that hide their content, break a line, or part cells.
HIDDEN = ("script", "style", "head", "title", "noscript", "ix:header")
BLOCKS = "p div tr table li ul ol br hr h1 h2 h3 h4 h5 h6 section article header footer pre blockquote dl dt dd body html form document".split()
CELLS = ("td", "th")
MARKUP = r"(?i)<(?:html|body|div|p|table|span|font|\?xml|xbrl|ix:)"

_BREAK = "\u0001"


def unescaped(text: Column | str) -> Column:
    """Character references decoded, in Arrow batches; NULL stays NULL."""

    @F.pandas_udf(StringType())
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: html.unescape(t) if isinstance(t, str) else None)

    return run(text)


def _one_of(names) -> str:
    return "|".join(re.escape(n) for n in names)


def without_wrapper(content: Column) -> Column:
    """Without the submission's header and trailer around a document."""
    inner = F.regexp_replace(content, r"(?is)\A\s*<document>.*?<text>", "")
    return F.regexp_replace(inner, r"(?i)</text>\s*</document>\s*\z", "")


def document_text(content: Column | str) -> Column:
    """Blocks of a document with blank lines between them; NULL is the empty text.

    In markup hidden elements and comments go, block elements and table rows end a
    line, cells are parted by blanks and other tags vanish. Other text keeps its own
    blocks. Tags are handled by the JVM's regular expressions; only character
    references need Python.
    """
    col = F.col(content) if isinstance(content, str) else content
    body = without_wrapper(F.coalesce(col, F.lit("")))
    shown = F.regexp_replace(body, r"(?s)<!--.*?-->", " ")
    shown = F.regexp_replace(shown, rf"(?is)<({_one_of(HIDDEN)})(?=[\s>/])[^>]*>.*?</\1\s*>", " ")
    flat = F.regexp_replace(shown, r"\s+", " ")
    lined = F.regexp_replace(flat, rf"(?i)</?(?:{_one_of(BLOCKS)})(?=[\s>/])[^>]*>", _BREAK)
    spaced = F.regexp_replace(lined, rf"(?i)</?(?:{_one_of(CELLS)})(?=[\s>/])[^>]*>", " ")
    bare = unescaped(F.regexp_replace(spaced, r"<[/!?a-zA-Z][^>]*>", ""))
    is_markup = body.rlike(MARKUP)
    blocks = F.when(is_markup, F.split(bare, _BREAK)).otherwise(F.split(body, r"\n[ \t\r]*\n"))
    return F.array_join(F.filter(F.transform(blocks, normalised), lambda b: b != ""), "\n\n")


def index_documents(pages: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, sequence, description, document, doc_type, url``: rows of the document
    tables of filing index pages; rows of under four cells are left out."""
    line = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)).alias("line")
    rows = pages.select(F.col(doc_id).alias("doc_id"), line)
    plain = lambda c: normalised(F.regexp_replace(c, r"(?s)<[^>]*>", " "))
    cells = F.transform(F.regexp_extract_all("line", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), 1), plain)
    url = F.nullif(F.regexp_extract("line", r"(?i)href\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))
    parts = rows.select("doc_id", cells.alias("c"), url.alias("url")).where(F.size("c") >= 4)
    cell = lambda i: F.get("c", F.lit(i))
    return parts.select("doc_id", cell(0).alias("sequence"), cell(1).alias("description"), F.regexp_replace(cell(2), r" iXBRL$", "").alias("document"), cell(3).alias("doc_type"), "url")


_HEADING = re.compile(r"(?im)^[ \t]*item\s+(\d{1,2}(?:\.\d{2})?[A-C]?)\b[.:\s-]*([^\n]{0,120})")
SECTIONS = "doc_id bigint, item string, title string, start bigint, body string, confidence string"


def sections_of(text: str | None) -> list[tuple[str, str, int, str, str]]:
    """(item, title, start, body, confidence) per item: of several headings of one
    item the one with the longest body, as tables of contents have short ones."""
    marks = list(_HEADING.finditer(text or ""))
    best: dict[str, tuple] = {}
    seen: dict[str, int] = {}
    for m, after in zip(marks, [*marks[1:], None], strict=False):
        body = text[m.end() : after.start() if after else len(text)].strip()
        item = m[1].upper()
        seen[item] = seen.get(item, 0) + 1
        if item not in best or len(body) > len(best[item][3]):
            best[item] = (item, m[2].strip(), m.start(), body)
    return [(*row, "low" if len(row[3]) < 200 else "high" if seen[row[0]] == 1 else "medium") for row in best.values()]


def item_sections(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Sections of item headings that begin a line."""

    def run(frames):
        for frame in frames:
            rows = [(key, *s) for key, t in zip(frame[doc_id], frame[text], strict=True) for s in sections_of(t)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SECTIONS.split(", ")])

    return documents.select(doc_id, text).mapInPandas(run, SECTIONS)


# --- search ------------------------------------------------------------------


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), 1)


def token_index(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index: ``token, doc_id, pos``."""
    return documents.select(F.col(doc_id).alias("doc_id"), F.posexplode(tokens(F.col(text))).alias("pos", "token"))


def phrase_hits(index: DataFrame, phrase: str) -> DataFrame:
    """``doc_id, hits``: documents in which the words of the phrase stand one after
    another. Postings of the words are shifted to the phrase's start and counted,
    so words are never joined with one another."""
    words = re.findall(r"[a-z0-9]+", phrase.lower())
    if not words:
        raise ValueError("the phrase has no word")
    offsets = F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.lit(i).alias("offset")) for i, w in enumerate(words)])).alias("o")
    postings = index.where(F.col("token").isin(*set(words))).select("doc_id", "pos", "token", offsets).where("token = o.word")
    starts = postings.groupBy("doc_id", (F.col("pos") - F.col("o.offset")).alias("start")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(words))
    return starts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))


#: Parts of a written index; a search reads the parts its words fall in.
INDEX_PARTS = 64


def _part(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(INDEX_PARTS)).cast("int")


def write_index(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """The inverted index of ``documents`` as a table at ``path``, by parts of the
    vocabulary. A word that makes up much of all texts is spread over several files
    of its part."""
    rows = token_index(documents, doc_id, text).withColumn("part", _part(F.col("token")))
    spread_ = rows.repartition("part", F.pmod(F.xxhash64("doc_id"), F.lit(8)))
    spread_.sortWithinPartitions("token", "doc_id", "pos").write.mode("error").partitionBy("part").parquet(path)


def read_index(spark: SparkSession, path: str, phrase: str) -> DataFrame:
    """The postings a phrase can need: its words' parts, pruned by folder, and in
    them the words, pruned by the statistics of sorted files."""
    words = sorted(set(re.findall(r"[a-z0-9]+", phrase.lower())))
    if not words:
        raise ValueError("the phrase has no word")
    parts = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(_part(F.col("w"))).collect()]  # one a word
    index = spark.read.schema("doc_id bigint, pos int, token string, part int").parquet(path)
    return index.where(F.col("part").isin(*parts) & F.col("token").isin(*words)).drop("part")


def search(postings: DataFrame, documents: DataFrame, phrase: str, forms: tuple[str, ...] = (), since: str | None = None, until: str | None = None, width: int = 200) -> DataFrame:
    """``doc_id, form, filed, hits, snippet``: texts that hold the phrase, newest first,
    of the forms and days asked for. The snippet is NULL where the words stand apart
    by other marks than one blank."""
    kept = documents
    if forms:
        kept = kept.where(F.col("form").isin(*forms))
    if since:
        kept = kept.where(F.col("filed") >= since)
    if until:
        kept = kept.where(F.col("filed") <= until)
    found = kept.join(phrase_hits(postings, phrase), "doc_id")
    return found.select("doc_id", "form", "filed", "hits", snippet(F.col("text"), phrase, width).alias("snippet")).orderBy(F.desc_nulls_last("filed"), "doc_id")
