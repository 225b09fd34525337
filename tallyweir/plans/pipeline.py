"""Queries of the general data-pipeline operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyweir.operators.asof_attributes import facts_with_versions
from tallyweir.operators.instant_dictionary import normalised_cells
from tallyweir.operators.nested_tables import FACT_MEMBERS, PRIOR_MEMBERS, fact_paths, flat_tables
from tallyweir.sources.tables import table
from tallyweir.streaming.exactly_once import run_dedupe


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return normalised_cells(table(spark, d, "submissions"), table(spark, d, "filings"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "feed").schema
    return run_dedupe(spark, f"{d}/feed.parquet", schema).copies()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return facts_with_versions(table(spark, d, "facts"), table(spark, d, "submissions"), table(spark, d, "filer_history"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return fact_paths(table(spark, d, "companyfacts"))


def p5_concepts(spark: SparkSession, d: str) -> DataFrame:
    return flat_tables(table(spark, d, "companyfacts"), ("concept",))["concepts"]


def p5_facts(spark: SparkSession, d: str) -> DataFrame:
    return flat_tables(table(spark, d, "companyfacts"), ("fact",))["facts"]


def p5_priors(spark: SparkSession, d: str) -> DataFrame:
    return flat_tables(table(spark, d, "companyfacts"), ("prior",))["priors"]


QUERIES = {
    "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found,
    "p5_concepts": p5_concepts, "p5_facts": p5_facts, "p5_priors": p5_priors,
}

# The notations of instants and days in plain SQL: parts by pattern, offsets by rule. Only
# the regions that the tables name are known here; the operator knows all.
_MONTHS_SQL = "list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], substr({x}, 1, 3))"
_SUNDAY = "(make_date(y, {m}, {d}) + ((7 - dayofweek(make_date(y, {m}, {d}))) % 7)::INT)"
_ISO, _US, _MDY, _DMY = r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})", r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}|[0-9]{2})(?:$|[^0-9])", r"^([a-z]{3,9})\.? ([0-9]{1,2}), ([0-9]{4})", r"^([0-9]{1,2})[- ]([a-z]{3,9})[- ]([0-9]{4})"


def parts_sql(cells: str) -> str:
    """CTEs from ``cells(tbl, row_id, fld, raw)`` to ``inst``: with local time, offset,
    instant (UTC) and day of each cell."""
    pick = lambda iso, us, mdy, dmy, plain: (
        f"CASE WHEN regexp_matches(x, '{_ISO}') THEN regexp_extract(x, '{_ISO}', {iso}) WHEN regexp_matches(x, '{_US}') THEN regexp_extract(x, '{_US}', {us}) "
        f"WHEN regexp_matches(x, '{_MDY}') THEN regexp_extract(x, '{_MDY}', {mdy}) WHEN regexp_matches(x, '{_DMY}') THEN regexp_extract(x, '{_DMY}', {dmy}) "
        f"WHEN regexp_full_match(x, '[0-9]{{8}}') THEN substr(x, {plain}) END"
    )
    rest = f"CASE WHEN regexp_matches(x, '{_ISO}') THEN regexp_replace(x, '{_ISO}', '') WHEN regexp_matches(x, '{_US}') THEN regexp_replace(x, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]+', '') WHEN regexp_matches(x, '{_MDY}') THEN regexp_replace(x, '{_MDY}', '') WHEN regexp_matches(x, '{_DMY}') THEN regexp_replace(x, '{_DMY}', '') ELSE '' END"
    clock = r"^[t ]([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]+))?)?(?: ?([ap])m\b)?\s*(.*)$"
    return rf"""
cells AS ({cells}),
c1 AS (SELECT tbl, row_id, fld, regexp_replace(lower(regexp_replace(raw, '^\s+|\s+$', '', 'g')), '^(mon|tue|wed|thu|fri|sat|sun), ', '') AS x FROM cells WHERE raw IS NOT NULL),
c2 AS (SELECT *, {pick(1, 3, 3, 3, "1, 4")} AS ys, {pick(2, 1, 1, 2, "5, 2")} AS ms, {pick(3, 2, 2, 1, "7, 2")} AS ds, {rest} AS r FROM c1),
c3 AS (SELECT *, try_cast(CASE WHEN length(ys) = 2 THEN '20' || ys ELSE ys END AS INT) AS y, coalesce(try_cast(ms AS INT), nullif({_MONTHS_SQL.format(x="ms")}, 0)) AS m, try_cast(ds AS INT) AS d,
  regexp_matches(r, '{clock}') AS timed, try_cast(regexp_extract(r, '{clock}', 1) AS INT) AS h, regexp_extract(r, '{clock}', 2) AS mi, regexp_extract(r, '{clock}', 3) AS se,
  regexp_extract(r, '{clock}', 4) AS fr, regexp_extract(r, '{clock}', 5) AS half, replace(replace(regexp_extract(r, '{clock}', 6), '[', ''), ']', '') AS z FROM c2),
c4 AS (SELECT *, CASE half WHEN 'p' THEN h % 12 + 12 WHEN 'a' THEN h % 12 ELSE h END AS hh FROM c3),
c5 AS (SELECT *, try_cast(y || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') AS DATE) AS written,
  CASE WHEN timed AND hh < 24 THEN try_cast(y || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') || ' ' || lpad(hh::VARCHAR, 2, '0') || ':' || mi || ':' || CASE WHEN se = '' THEN '00' ELSE se END || '.' || rpad(substr(fr, 1, 6), 6, '0') AS TIMESTAMP) END AS loc FROM c4),
c6 AS (SELECT *, CASE WHEN z IN ('', 'z', 'utc', 'gmt') THEN 0 WHEN z = 'est' THEN -300 WHEN z = 'edt' THEN -240 WHEN z = 'asia/singapore' THEN 480
  WHEN z IN ('et', 'us/eastern', 'america/new_york') THEN CASE WHEN loc >= {_SUNDAY.format(m=3, d=8)} + INTERVAL 3 HOUR AND loc < {_SUNDAY.format(m=11, d=1)} + INTERVAL 2 HOUR THEN -240 ELSE -300 END
  WHEN z = 'europe/london' THEN CASE WHEN loc >= {_SUNDAY.format(m=3, d=25)} + INTERVAL 2 HOUR AND loc < {_SUNDAY.format(m=10, d=25)} + INTERVAL 2 HOUR THEN 60 ELSE 0 END
  WHEN regexp_full_match(z, '[+-][0-9]{{2}}:?[0-9]{{2}}') THEN (CASE substr(z, 1, 1) WHEN '-' THEN -1 ELSE 1 END) * (substr(z, 2, 2)::INT * 60 + right(z, 2)::INT) END AS off FROM c5),
inst AS (SELECT *, CASE WHEN regexp_full_match(x, '[0-9]{{10}}') THEN TIMESTAMP '1970-01-01' + to_seconds(x::BIGINT) WHEN regexp_full_match(x, '[0-9]{{13}}') THEN TIMESTAMP '1970-01-01' + to_milliseconds(x::BIGINT)
  WHEN regexp_full_match(x, '[0-9]{{14}}') THEN try_strptime(x, '%Y%m%d%H%M%S') WHEN timed THEN loc - to_minutes(off) END AS utc FROM c6),
days AS (SELECT *, CASE WHEN timed AND z <> '' THEN (utc + CASE WHEN utc >= {_SUNDAY.format(m=3, d=8)} + INTERVAL 7 HOUR AND utc < {_SUNDAY.format(m=11, d=1)} + INTERVAL 6 HOUR THEN INTERVAL (-4) HOUR ELSE INTERVAL (-5) HOUR END)::DATE
  WHEN r = '' OR loc IS NOT NULL THEN written END AS day FROM inst)
"""


# Unrolled by SQL's own JSON functions; an object in place of an array is its only element.
_ELEMENTS = "CASE json_type({x}) WHEN 'OBJECT' THEN json_array({x}) WHEN 'ARRAY' THEN {x} ELSE json_array() END"
_CONCEPTS_SQL = """
r AS (SELECT record_id, facts::JSON AS j FROM companyfacts WHERE json_valid(facts)),
t AS (SELECT record_id, e.key AS taxonomy, e.value AS v FROM r, json_each(CASE WHEN json_type(j) = 'OBJECT' THEN j ELSE '{}' END) e),
c AS (SELECT record_id, taxonomy, e.key AS tag, e.value AS v FROM t, json_each(CASE WHEN json_type(v) = 'OBJECT' THEN v ELSE '{}' END) e WHERE json_type(e.value) = 'OBJECT')
"""
_FACTS_SQL = f"""{_CONCEPTS_SQL},
u AS (SELECT record_id, taxonomy, tag, e.key AS unit, {_ELEMENTS.format(x="e.value")} AS v FROM c, json_each(CASE WHEN json_type(v -> 'units') = 'OBJECT' THEN v -> 'units' ELSE '{{}}' END) e),
f AS (SELECT record_id, taxonomy, tag, unit, e.key::BIGINT AS fact_pos, e.value AS v FROM u, json_each(v) e WHERE json_type(e.value) = 'OBJECT'),
p AS (SELECT record_id, taxonomy, tag, unit, fact_pos, e.key::BIGINT AS prior_pos, e.value AS v FROM (SELECT *, v -> 'prior_values' AS x FROM f) g, json_each({_ELEMENTS.format(x="x")}) e WHERE json_type(e.value) = 'OBJECT')
"""
_CELLS = """SELECT 'submissions' AS tbl, sub_id AS row_id, 'acceptancedatetime' AS fld, acceptancedatetime AS raw FROM submissions
UNION ALL SELECT 'submissions', sub_id, 'filingdate', filingdate FROM submissions UNION ALL SELECT 'filings', filing_id, 'filed', filed FROM filings"""
_ACCEPTED = "SELECT replace(trim(accessionnumber), '-', '') AS tbl, sub_id AS row_id, '' AS fld, acceptancedatetime AS raw FROM submissions WHERE regexp_full_match(replace(trim(accessionnumber), '-', ''), '[0-9]{18}')"
_NUMBER = r"regexp_replace(regexp_extract(cik, '([0-9]+)', 1), '^0+([0-9])', '\1')"
SQL = {
    "p2_found": f"""WITH {parts_sql(_CELLS)} SELECT tbl, row_id, fld, CASE fld WHEN 'acceptancedatetime' THEN strftime(utc, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' ELSE strftime(day, '%Y-%m-%d') END AS normal
FROM days WHERE CASE fld WHEN 'acceptancedatetime' THEN utc IS NOT NULL ELSE day IS NOT NULL END""",
    "p4_found": f"""WITH {parts_sql(_ACCEPTED)}, acc AS (SELECT tbl AS a, min(utc) AS utc FROM inst WHERE utc IS NOT NULL GROUP BY tbl),
e AS (SELECT fact_id, {_NUMBER} AS cik, coalesce(utc, filed::TIMESTAMP) AS t FROM facts LEFT JOIN acc ON a = replace(trim(accession), '-', '')),
v AS (SELECT {_NUMBER} AS cik, version_id, (valid_from AT TIME ZONE 'UTC') AS f, (known_at AT TIME ZONE 'UTC') AS k FROM filer_history)
SELECT fact_id, arg_max(version_id, (f, k, version_id)) AS version_id FROM e JOIN v ON e.cik = v.cik AND f <= t AND k <= t WHERE t IS NOT NULL GROUP BY fact_id""",
    "p3_found": r"""WITH k AS (SELECT regexp_replace(accession, '[^0-9]', '', 'g') AS acc, regexp_replace(regexp_extract(cik, '([0-9]+)', 1), '^0+([0-9])', '\1') AS cik, delivery_id FROM feed),
m AS (SELECT min(delivery_id) OVER (PARTITION BY acc, cik) AS first_id, delivery_id AS copy_id FROM k WHERE acc <> '' AND cik <> '') SELECT * FROM m WHERE first_id < copy_id""",
    "p5_found": f"""WITH {_FACTS_SQL} SELECT record_id, taxonomy, tag, unit, fact_pos, -1::BIGINT AS prior_pos FROM f UNION ALL SELECT record_id, taxonomy, tag, unit, fact_pos, prior_pos FROM p""",
    "p5_concepts": f"""WITH {_CONCEPTS_SQL} SELECT record_id, taxonomy, tag, v ->> 'label' AS label, v ->> 'description' AS description FROM c""",
    "p5_facts": f"""WITH {_FACTS_SQL} SELECT record_id, taxonomy, tag, unit, fact_pos, {", ".join(f"""v ->> '{m}' AS "{m}\"""" for m in FACT_MEMBERS)} FROM f""",
    "p5_priors": f"""WITH {_FACTS_SQL} SELECT record_id, taxonomy, tag, unit, fact_pos, prior_pos, {", ".join(f"""v ->> '{m}' AS "{m}\"""" for m in PRIOR_MEMBERS)} FROM p""",
}
