"""Queries over tagged facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.functions.aliases import PERIODIC_FORMS, alias_table, alias_values_sql
from tallyweir.functions.instants import parse_day
from tallyweir.operators import facts as O
from tallyweir.operators.asof_attributes import acceptances
from tallyweir.plans.pipeline import parts_sql
from tallyweir.session import require_utc
from tallyweir.sources.tables import table

CUTOFF = "2020-06-30 18:00:00"
REFERENCE = "2026-12-31"


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return O.canonical(table(spark, d, "facts"))


def filings(spark: SparkSession, d: str) -> DataFrame:
    """The filing index with days of any notation. Rows whose day is missing or
    unreadable stay, with NULL; queries that go by day leave them out themselves."""
    require_utc(spark)
    f = table(spark, d, "filings")
    return f.select(
        F.col("filing_id").cast("bigint").alias("filing_id"), F.lpad(O.cik_number("cik"), 10, "0").alias("cik"), O.accession_18("accession").alias("accession"),
        "form", parse_day(F.col("filed")).alias("filed"), "report_date", "item_list", "size_bytes", "is_xbrl", "is_inline_xbrl", "primary_document", "loaded_at",
    ).where("cik is not null and accession is not null")


FACTS_SQL = r"""
f AS (SELECT * FROM (
  SELECT fact_id, lpad(regexp_replace(regexp_extract(cik, '([0-9]+)', 1), '^0+([0-9])', '\1'), 10, '0') AS cik, entity_name,
    lower(trim(taxonomy)) AS taxonomy,
    regexp_replace(lower(regexp_replace(tag, '^\s+|\s+$', '', 'g')), '^(us-gaap|ifrs-full|dei)[:_]', '') AS tag,
    regexp_replace(lower(regexp_replace(unit, '^\s+|\s+$', '', 'g')), '^iso4217:', '') AS unit,
    start_date AS start, end_date AS "end", CASE WHEN NOT isnan(val) THEN val END AS val, filed,
    CASE WHEN regexp_full_match(replace(trim(accession), '-', ''), '[0-9]{18}') AND replace(trim(accession), '-', '') <> '000000000000000000'
      THEN replace(trim(accession), '-', '') END AS accession, fy, fp, form, frame
  FROM facts) WHERE cik IS NOT NULL AND tag IS NOT NULL AND unit IS NOT NULL AND "end" IS NOT NULL AND val IS NOT NULL AND filed IS NOT NULL)
"""
# Days of every notation by the SQL of problem 2; rows without a readable day stay, with NULL.
FILINGS_SQL = rf"""{parts_sql("SELECT 'filings' AS tbl, filing_id AS row_id, 'filed' AS fld, filed AS raw FROM filings").strip()},
g AS (SELECT * FROM (
  SELECT filing_id, lpad(regexp_replace(regexp_extract(cik, '([0-9]+)', 1), '^0+([0-9])', '\1'), 10, '0') AS cik,
    CASE WHEN regexp_full_match(replace(trim(accession), '-', ''), '[0-9]{{18}}') AND replace(trim(accession), '-', '') <> '000000000000000000'
      THEN replace(trim(accession), '-', '') END AS accession, form, day AS filed, report_date, item_list, size_bytes,
    is_xbrl, is_inline_xbrl, primary_document, loaded_at
  FROM filings LEFT JOIN days ON row_id = filing_id) WHERE cik IS NOT NULL AND accession IS NOT NULL)
"""
ACCEPTED_SQL = f"""{parts_sql("SELECT replace(trim(accessionnumber), '-', '') AS tbl, sub_id AS row_id, '' AS fld, acceptancedatetime AS raw FROM submissions WHERE regexp_full_match(replace(trim(accessionnumber), '-', ''), '[0-9]{18}')").strip()},
acc AS (SELECT tbl AS accession, min(utc) AS acceptance_ts FROM inst WHERE utc IS NOT NULL GROUP BY tbl)
"""
LENGTH_SQL = """coalesce(date_diff('day', start, "end"), 0)"""
TYPE_SQL = """CASE WHEN start IS NULL THEN 'instant' WHEN date_diff('day', start, "end") BETWEEN 300 AND 380 THEN 'annual'
  WHEN date_diff('day', start, "end") BETWEEN 70 AND 110 THEN 'quarterly' WHEN date_diff('day', start, "end") BETWEEN 111 AND 299 THEN 'ytd' ELSE 'other' END"""
_FRESH = f"""CASE WHEN "end" > filed THEN 1 ELSE 0 END, "end" DESC, (frame IS NOT NULL) DESC, {LENGTH_SQL} DESC, filed DESC, fact_id DESC"""
ALIASED_SQL = f"""
a(alias, precedence, taxonomy, tag, alias_unit) AS (VALUES {alias_values_sql()}),
x AS (SELECT f.*, a.alias, a.precedence FROM f JOIN a ON f.taxonomy = a.taxonomy AND f.tag = a.tag AND (a.alias_unit = '' OR a.alias_unit = f.unit))
"""
WINNER_SQL = f"""
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY cik, alias, precedence, unit ORDER BY {_FRESH}) = 1),
w AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY cik, alias ORDER BY "end" DESC, filed DESC, precedence, unit) = 1)
"""
_FORMS = ", ".join(f"'{x}'" for x in PERIODIC_FORMS)
REPORT_SQL = f"""
r AS (SELECT cik, accession, form, report_date AS report_end, filed AS report_filed FROM g WHERE report_date IS NOT NULL AND form IN ({_FORMS})
  QUALIFY row_number() OVER (PARTITION BY cik ORDER BY report_date DESC, filed DESC, filing_id DESC) = 1)
"""

QUERIES, SQL = {}, {}


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


@_query(f"""WITH {FACTS_SQL} SELECT fact_id, CAST({LENGTH_SQL} AS BIGINT) AS period_length_days, {TYPE_SQL} AS period_type,
coalesce(frame, CASE {TYPE_SQL} WHEN 'instant' THEN 'CY' || year("end") || 'Q' || quarter("end") || 'I' WHEN 'annual' THEN 'CY' || year("end")
  WHEN 'quarterly' THEN 'CY' || year("end") || 'Q' || quarter("end") END) AS calendar_period,
CASE WHEN fp = 'FY' THEN 'FY' || fy WHEN fp IS NOT NULL THEN fy || '-' || fp END AS fiscal_period,
coalesce(fp IN ('Q2', 'Q3') AND date_diff('day', start, "end") > 110, false) AS is_cumulative FROM f""")
def facts_enriched(spark: SparkSession, d: str) -> DataFrame:
    return O.enriched(_facts(spark, d)).select(
        "fact_id", F.col("period_length_days").cast("bigint").alias("period_length_days"), "period_type", "calendar_period", "fiscal_period", "is_cumulative"
    )


@_query(f"""WITH {FACTS_SQL} SELECT cik, tag, unit, fact_id, "end", val FROM f
QUALIFY row_number() OVER (PARTITION BY cik, tag, unit ORDER BY {_FRESH}) = 1""")
def freshest_fact(spark: SparkSession, d: str) -> DataFrame:
    return O.freshest(_facts(spark, d)).select("cik", "tag", "unit", "fact_id", "end", "val")


@_query(f"""WITH {FACTS_SQL} SELECT cik, tag, unit, start, "end", val, fact_id FROM f
QUALIFY row_number() OVER (PARTITION BY cik, tag, unit, start, "end" ORDER BY filed DESC, fact_id DESC) = 1""")
def facts_dedupe_period(spark: SparkSession, d: str) -> DataFrame:
    return O.one_per_period(_facts(spark, d)).select("cik", "tag", "unit", "start", "end", "val", "fact_id")


@_query(f"""WITH {FACTS_SQL}, {ALIASED_SQL}, {WINNER_SQL} SELECT cik, alias, tag, unit, "end", val, fact_id FROM w""")
def alias_winner(spark: SparkSession, d: str) -> DataFrame:
    return O.alias_winner(_facts(spark, d), alias_table(spark)).select("cik", "alias", "tag", "unit", "end", "val", "fact_id")


@_query(f"""WITH {FACTS_SQL}, {ALIASED_SQL} SELECT cik, alias, tag AS source_tag, unit, start, "end", accession, val, fact_id FROM x
QUALIFY row_number() OVER (PARTITION BY cik, alias, start, "end", accession, unit ORDER BY precedence, fact_id DESC) = 1""")
def canonical_union(spark: SparkSession, d: str) -> DataFrame:
    return O.canonical_union(_facts(spark, d), alias_table(spark)).select("cik", "alias", F.col("tag").alias("source_tag"), "unit", "start", "end", "accession", "val", "fact_id")


@_query(f"""WITH {FACTS_SQL}, l AS (SELECT *, last_value(val) OVER p AS latest, last_value(accession) OVER p AS latest_accession FROM f
WINDOW p AS (PARTITION BY cik, tag, unit, start, "end" ORDER BY filed, fact_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT fact_id, val, latest AS latest_known_value, val <> latest AS is_restated, CASE WHEN val <> latest THEN latest_accession END AS superseded_by FROM l""")
def restatement_lineage(spark: SparkSession, d: str) -> DataFrame:
    return O.lineage(_facts(spark, d)).select("fact_id", "val", "latest_known_value", "is_restated", "superseded_by")


@_query(f"""WITH {FACTS_SQL}, l AS (SELECT cik, tag, unit, start, "end", arg_max(val, (filed, fact_id)) AS latest_val FROM f GROUP BY ALL),
v AS (SELECT cik, tag, unit, start, "end", val, min((filed, fact_id, accession)) AS seen FROM f GROUP BY cik, tag, unit, start, "end", val)
SELECT v.cik, v.tag, v.unit, v.start, v."end", latest_val, count(*) AS n_prior, arg_min(val, seen) AS oldest_val, arg_max(val, seen) AS newest_prior_val
FROM v JOIN l ON v.cik = l.cik AND v.tag = l.tag AND v.unit = l.unit AND v.start IS NOT DISTINCT FROM l.start AND v."end" = l."end"
WHERE val <> latest_val GROUP BY v.cik, v.tag, v.unit, v.start, v."end", latest_val""")
def restatement_priors(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("filed", "fact_id")
    return O.prior_values(_facts(spark, d)).groupBy(*O.PERIOD, "latest_val").agg(
        F.count(F.lit(1)).alias("n_prior"), F.min_by("val", at).alias("oldest_val"), F.max_by("val", at).alias("newest_prior_val")
    )


@_query(f"""WITH {FACTS_SQL} SELECT cik, tag, unit, start, "end", count(DISTINCT val) AS n_values, count(*) AS n_filings, min(filed) AS first_filed,
max(filed) AS last_filed FROM f GROUP BY cik, tag, unit, start, "end" HAVING count(DISTINCT val) > 1""")
def audit_trail(spark: SparkSession, d: str) -> DataFrame:
    return O.audit_trail(_facts(spark, d))


@_query(f"""WITH {FACTS_SQL}, t AS (SELECT cik, taxonomy, tag, val, start, "end" FROM f WHERE tag IN ('revenues', 'netincomeloss', 'assets')),
u AS (SELECT cik, tag, start, "end", count(DISTINCT val) AS n FROM t GROUP BY cik, tag, start, "end")
SELECT cik, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END)::BIGINT AS restated_periods, count(*) AS periods FROM u GROUP BY cik""")
def restatement_counts(spark: SparkSession, d: str) -> DataFrame:
    t = _facts(spark, d).where(F.col("tag").isin("revenues", "netincomeloss", "assets"))
    u = t.groupBy("cik", "tag", "start", "end").agg(F.count_distinct("val").alias("n"))
    return u.groupBy("cik").agg(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).cast("bigint").alias("restated_periods"), F.count(F.lit(1)).alias("periods"))


@_query(f"""WITH {FACTS_SQL} SELECT cik, start, "end", fy, filed FROM f WHERE fp = 'FY' AND {TYPE_SQL} = 'annual' AND fy IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY cik, start, "end" ORDER BY filed, fact_id) = 1""")
def fiscal_grid(spark: SparkSession, d: str) -> DataFrame:
    return O.fiscal_grid(_facts(spark, d))


@_query(f"""WITH {FACTS_SQL} SELECT cik, taxonomy, tag, array_to_string(list_sort(list(DISTINCT unit)), ',') AS units, count(*) AS fact_count, max(filed) AS latest_filed
FROM f GROUP BY cik, taxonomy, tag""")
def concept_summary(spark: SparkSession, d: str) -> DataFrame:
    return O.concept_summary(_facts(spark, d))


@_query(f"""WITH {FACTS_SQL}, {ACCEPTED_SQL}
SELECT fact_id, acceptance_ts IS NOT NULL AS accepted_known FROM f LEFT JOIN acc USING (accession)
WHERE CASE WHEN acceptance_ts IS NOT NULL THEN acceptance_ts <= TIMESTAMP '{CUTOFF}' ELSE filed < DATE '{CUTOFF[:10]}' - 1 END""")
def asof_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts public at the cutoff: by the acceptance of their filing, else by ``filed``."""
    acc = acceptances(table(spark, d, "submissions")).select(F.col("acc").alias("accession"), F.col("accepted").alias("acceptance_ts"))
    return O.as_of(_facts(spark, d), acc, CUTOFF, intraday=True).select("fact_id", F.col("acceptance_ts").isNotNull().alias("accepted_known"))


def _reports(spark: SparkSession, d: str) -> DataFrame:
    g = filings(spark, d).where(F.col("report_date").isNotNull() & F.col("form").isin(*PERIODIC_FORMS))
    best = F.max_by(F.struct("accession", "form", F.col("report_date").alias("report_end"), F.col("filed").alias("report_filed")), F.struct("report_date", "filed", "filing_id"))
    return g.groupBy("cik").agg(best.alias("r")).select("cik", "r.*")


@_query(f"WITH {FILINGS_SQL}, {REPORT_SQL} SELECT cik, accession, form, report_end, report_filed FROM r")
def latest_periodic_report(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d)


@_query(f"""WITH {FACTS_SQL}, {FILINGS_SQL}, {REPORT_SQL}, {ALIASED_SQL}, {WINNER_SQL}
SELECT cik, alias, fact_id, CASE WHEN date_diff('day', w."end", report_end) > 7 THEN 'superseded'
  WHEN date_diff('day', w."end", DATE '{REFERENCE}') > 548 THEN 'old' END AS stale_reason FROM w LEFT JOIN r USING (cik)""")
def staleness(spark: SparkSession, d: str) -> DataFrame:
    winners = O.alias_winner(_facts(spark, d), alias_table(spark))
    reports = _reports(spark, d).select("cik", "report_end")
    return O.staleness(winners, reports, F.lit(REFERENCE).cast("date")).select("cik", "alias", "fact_id", "stale_reason")


@_query(f"""WITH {FACTS_SQL}, {FILINGS_SQL},
n AS (SELECT cik, accession, form, filed FROM g WHERE is_xbrl = 1 OR is_inline_xbrl = 1 QUALIFY row_number() OVER (PARTITION BY cik ORDER BY filed DESC, accession DESC, filing_id DESC) = 1)
SELECT cik, accession, form, filed FROM n ANTI JOIN f USING (cik, accession)""")
def xbrl_coverage_gap(spark: SparkSession, d: str) -> DataFrame:
    g = filings(spark, d).where("is_xbrl = 1 or is_inline_xbrl = 1")
    newest = g.groupBy("cik").agg(F.max_by(F.struct("accession", "form", "filed"), F.struct("filed", "accession", "filing_id")).alias("n")).select("cik", "n.*")
    return newest.join(_facts(spark, d).select("cik", "accession"), ["cik", "accession"], "left_anti")


@_query(f"""WITH {FACTS_SQL}, k AS (SELECT *, max(frame IS NOT NULL) OVER (PARTITION BY cik, tag, unit) AS framed FROM f),
s AS (SELECT * FROM k WHERE NOT framed OR frame IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cik, tag, unit, start, "end", frame ORDER BY filed DESC, fact_id DESC) = 1)
SELECT cik, tag, unit, fact_id, row_number() OVER (PARTITION BY cik, tag, unit ORDER BY "end" DESC, filed DESC, fact_id DESC)::BIGINT AS pos FROM s QUALIFY pos <= 4""")
def comparable_facts(spark: SparkSession, d: str) -> DataFrame:
    return O.comparable(_facts(spark, d), 4).select("cik", "tag", "unit", "fact_id", F.col("pos").cast("bigint").alias("pos"))


@_query(f"""WITH {FACTS_SQL} SELECT cik, unit, frame, val, fact_id FROM f WHERE frame = 'CY2020Q1' AND tag = 'revenues' AND unit = 'usd' """)
def frame_scan(spark: SparkSession, d: str) -> DataFrame:
    """One concept and calendar period across filers: all facts, largest first."""
    f = _facts(spark, d).where("frame = 'CY2020Q1' and tag = 'revenues' and unit = 'usd'")
    return f.orderBy(F.desc("val"), "fact_id").select("cik", "unit", "frame", "val", "fact_id")


@_query(f"""WITH {FACTS_SQL}, t AS (SELECT cik, tag, unit, fact_id, filed, row_number() OVER (PARTITION BY cik ORDER BY filed DESC, fact_id DESC) AS pos, count(*) OVER (PARTITION BY cik) AS total FROM f)
SELECT cik, fact_id, pos::BIGINT AS pos, total > 5 AS truncated FROM t WHERE pos <= 5""")
def truncation_probe(spark: SparkSession, d: str) -> DataFrame:
    """The five newest facts of each filer, and whether there are more."""
    return O.newest(_facts(spark, d), 5).select("cik", "fact_id", F.col("pos").cast("bigint").alias("pos"), "truncated")
