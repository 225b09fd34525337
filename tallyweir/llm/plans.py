"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyweir.llm.fusion import best_records, best_sources, source_quality, true_values
from tallyweir.llm.packing import containers, packing_quality
from tallyweir.llm.spans import shared_characters
from tallyweir.llm.tokenizer import encoded
from tallyweir.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return best_sources(table(spark, d, "facts"), table(spark, d, "fact_origins"))


def p1_quality(spark: SparkSession, d: str) -> DataFrame:
    return source_quality(table(spark, d, "facts"), table(spark, d, "fact_origins"))


def p1_values(spark: SparkSession, d: str) -> DataFrame:
    return true_values(table(spark, d, "facts"), table(spark, d, "fact_origins"))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return best_records(table(spark, d, "facts"), table(spark, d, "fact_origins"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return containers(table(spark, d, "documents"))


def p7_quality(spark: SparkSession, d: str) -> DataFrame:
    return packing_quality(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_characters(table(spark, d, "documents"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoded(table(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found, "p1_quality": p1_quality, "p1_values": p1_values, "p1_records": p1_records, "p6_ids": p6_ids, "p7_containers": p7_containers,
    "p7_quality": p7_quality,
    "p8_found": p8_found,
}
_USABLE = {
    "val_id": "val IS NOT NULL AND NOT isnan(val)",
    "accession_id": "regexp_full_match(a, '[0-9]{18}') AND a <> '000000000000000000'",
    "filed_id": "filed IS NOT NULL",
    "end_id": "end_date IS NOT NULL AND (filed IS NULL OR end_date <= filed)",
}
_PICKS = ", ".join(f"coalesce(arg_max(fact_id, (t, coalesce(filed, DATE '0001-01-01'), fact_id)) FILTER (WHERE {ok}), -1) AS {name}" for name, ok in _USABLE.items())
SQL: dict[str, str] = {
    "p1_found": rf"""WITH o AS (SELECT origin, max(coalesce(trust, 0)) AS t FROM fact_origins WHERE origin IS NOT NULL GROUP BY origin),
k AS (SELECT fact_id, regexp_replace(regexp_extract(cik, '([0-9]+)', 1), '^0+([0-9])', '\1') AS cik,
  regexp_replace(lower(regexp_replace(tag, '^\s+|\s+$', '', 'g')), '^(us-gaap|ifrs-full|dei)[:_]', '') AS tag,
  regexp_replace(lower(regexp_replace(unit, '^\s+|\s+$', '', 'g')), '^iso4217:', '') AS unit, lower(trim(context_id)) AS context, val, filed, end_date,
  replace(regexp_replace(accession, '^\s+|\s+$', '', 'g'), '-', '') AS a, coalesce(t, 0) AS t FROM facts LEFT JOIN o USING (origin))
SELECT min(fact_id) AS group_id, {_PICKS} FROM k WHERE cik <> '' AND tag IS NOT NULL AND unit IS NOT NULL AND context IS NOT NULL GROUP BY cik, tag, unit, context HAVING count(*) > 1""",
    # All windows of 240 characters, compared as they are; texts are read in pages.
    "p8_found": """WITH p AS (SELECT doc_id, k * 2000 AS base, substring(text, k * 2000 + 1, 2239) AS page FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 1760) // 2000)) AS k FROM documents WHERE length(text) >= 240)),
w AS (SELECT doc_id, base + i AS lo, substring(page, i, 240) AS passage FROM (SELECT doc_id, base, page, unnest(range(1, length(page) - 238)) AS i FROM p)),
c AS (SELECT passage FROM w GROUP BY passage HAVING min(doc_id) < max(doc_id)),
s AS (SELECT DISTINCT doc_id, lo FROM w SEMI JOIN c USING (passage)),
n AS (SELECT doc_id, least(240, lo - coalesce(lag(lo) OVER (PARTITION BY doc_id ORDER BY lo), lo - 240)) AS fresh FROM s)
SELECT doc_id, sum(fresh)::BIGINT AS shared_chars FROM n GROUP BY doc_id""",
}
