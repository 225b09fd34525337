"""Readers of landed bulk files, with fixed schemas: nothing is inferred."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.functions.instants import parse_instant
from tallyweir.functions.keys import cik_number
from tallyweir.functions.periods import strict_date
from tallyweir.operators.nested_tables import flat_tables

COMPANIES = "fields array<string>, data array<array<string>>"
# The parallel columns of a filing list, by their wire names.
_TEXTS = ("accessionNumber", "filingDate", "reportDate", "acceptanceDateTime", "act", "form", "fileNumber", "filmNumber", "items", "core_type", "primaryDocument", "primaryDocDescription")
_NUMBERS = ("size", "isXBRL", "isInlineXBRL", "isXBRLNumeric")
COLUMNS = ", ".join([f"{c}: array<string>" for c in _TEXTS] + [f"{c}: array<bigint>" for c in _NUMBERS])
SUBMISSIONS = (
    "cik string, entityType string, sic string, sicDescription string, name string, tickers array<string>, exchanges array<string>, fiscalYearEnd string, "
    f"filings struct<recent: struct<{COLUMNS}>, files: array<struct<name: string>>>"
)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per file; files that hold no such object are rows of NULLs and dropped by the readers below."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def companies(spark: SparkSession, path: str) -> DataFrame:
    """``cik, name, ticker, exchange`` of a ticker map given as fields and data."""
    rows = _json(spark, path, COMPANIES).select("fields", F.explode("data").alias("row"))
    pick = lambda name: F.get("row", F.array_position("fields", name).cast("int") - 1)
    return rows.select(F.lpad(cik_number(pick("cik")), 10, "0").alias("cik"), pick("name").alias("name"), F.upper(pick("ticker")).alias("ticker"), pick("exchange").alias("exchange"))


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=XBRL)(?=[A-Z])", "_", name).lower()


def _transposed(columns: DataFrame, prefix: str) -> DataFrame:
    """Parallel arrays to rows; shorter and missing ones end in NULLs, empty texts are NULL."""
    given = lambda c, kind: F.coalesce(F.col(f"{prefix}{c}"), F.array().cast(f"array<{kind}>")).alias(c)
    arrays = columns.select("cik", *[given(c, "string") for c in _TEXTS], *[given(c, "bigint") for c in _NUMBERS])
    rows = arrays.select("cik", F.inline(F.arrays_zip(*_TEXTS, *_NUMBERS)))
    text = lambda c: F.when(F.col(c) != "", F.col(c)).alias(_snake(c))
    out = rows.select("cik", *[text(c) for c in _TEXTS], *[F.col(c).alias(_snake(c)) for c in _NUMBERS])
    return out.withColumns({"filing_date": strict_date(F.col("filing_date")), "report_date": strict_date(F.col("report_date")), "acceptance_ts": parse_instant(F.col("acceptance_date_time"))}).where("accession_number is not null")


def filings(spark: SparkSession, path: str, chunks: str | None = None) -> DataFrame:
    """Filing rows of submissions files and, if given, of their history chunks; an
    accession of a filer counts once, the recent list first.

    Chunk files are named by the filer: ``CIK##########-submissions-###.json``.
    """
    recent = _transposed(_json(spark, path, SUBMISSIONS).where("filings is not null").withColumn("cik", F.lpad(cik_number("cik"), 10, "0")), "filings.recent.")
    rows = recent.withColumn("source", F.lit(0))
    if chunks:
        named = _json(spark, chunks, COLUMNS.replace(": ", " ")).withColumn("cik", F.lpad(F.regexp_extract(F.input_file_name(), r"CIK0*(\d+)", 1), 10, "0"))
        rows = rows.unionByName(_transposed(named, "").withColumn("source", F.lit(1)))
    rest = [c for c in rows.columns if c not in ("cik", "accession_number", "source")]
    best = F.min_by(F.struct(*rest), F.struct("source", "filing_date", "form", "primary_document"))
    return rows.groupBy("cik", "accession_number").agg(best.alias("r")).select("cik", "accession_number", "r.*")


def filers(spark: SparkSession, path: str) -> DataFrame:
    """One row of attributes per submissions file."""
    return _json(spark, path, SUBMISSIONS).where("cik is not null").select(
        F.lpad(cik_number("cik"), 10, "0").alias("cik"), F.get("tickers", F.lit(0)).alias("ticker"), "name", "sic", F.col("sicDescription").alias("sic_description"),
        F.col("fiscalYearEnd").alias("fiscal_year_end"), F.col("entityType").alias("entity_type"),
    )


def company_facts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Flat tables of company-facts files, through the nested-records operator."""
    texts = spark.read.text(path, wholetext=True)
    head = F.from_json("value", "cik string, entityName string, facts string")
    return flat_tables(texts.select(F.xxhash64(F.input_file_name()).alias("record_id"), head.alias("h")).select("record_id", F.col("h.cik").alias("cik"), F.col("h.entityName").alias("entityname"), F.col("h.facts").alias("facts")))


FEED = "title string, accession string, cik string, form string, updated string, url string, error string"
_ATOM = "{http://www.w3.org/2005/Atom}"


def feed_entries(text: str | None) -> list[tuple]:
    """Entries of one Atom page; an entry without identifier or instant comes out
    with its error, so one bad entry costs no other."""
    try:
        root = ET.fromstring(text or "")
    except ET.ParseError as e:
        return [(None, None, None, None, None, None, f"page: {e}")]
    out = []
    for entry in root.iter(f"{_ATOM}entry"):
        get = lambda tag, entry=entry: (entry.findtext(f"{_ATOM}{tag}") or "").strip() or None
        link, category = entry.find(f"{_ATOM}link"), entry.find(f"{_ATOM}category")
        url = link.get("href") if link is not None else None
        accession = re.search(r"\d{10}-\d{2}-\d{6}", " ".join(filter(None, (get("id"), url, get("summary")))))
        cik = re.search(r"/data/(\d+)/", url or "") or re.search(r"\((\d{1,10})\)", get("title") or "")
        error = "no accession" if not accession else "no filer" if not cik else "no offset" if not re.search(r"(?:Z|[+-]\d\d:?\d\d)$", get("updated") or "") else None
        out.append((get("title"), accession and accession[0], cik and cik[1].zfill(10), category.get("term") if category is not None else None, get("updated"), url, error))
    return out


def feed_pages(pages: DataFrame, text: str = "value") -> DataFrame:
    """Entries of Atom pages, one page per row."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([row for page in frame[text] for row in feed_entries(page)], columns=[c.split()[0] for c in FEED.split(", ")])

    return pages.select(text).mapInPandas(run, FEED)


def csv_ready(df: DataFrame) -> DataFrame:
    """Nested columns as JSON texts, for sinks of flat rows."""
    nested = {f.name: F.to_json(f.name) for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    return df.withColumns(nested) if nested else df


def compact_json(df: DataFrame) -> Column:
    """Rows as JSON without what is NULL or the empty text."""
    kept = [F.when(F.col(f.name) != "", F.col(f.name)).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in df.schema.fields]
    return F.to_json(F.struct(*kept))
