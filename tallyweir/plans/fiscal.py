"""Queries over fiscal calendars, statements and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.functions.aliases import alias_table
from tallyweir.functions.keys import cik_number
from tallyweir.functions.texts import without_tags
from tallyweir.operators import fiscal as O
from tallyweir.operators.compare import pivot_aliases
from tallyweir.operators.facts import alias_winner
from tallyweir.plans.facts import ALIASED_SQL, FACTS_SQL, FILINGS_SQL, WINNER_SQL, _facts, filings
from tallyweir.sources.tables import table

QUERIES, SQL = {}, {}


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# The lines of a balance sheet, in order.
BALANCE = ["cash", "inventory", "assets_current", "goodwill", "intangibles", "assets", "short_term_debt", "liabilities_current", "debt", "liabilities", "equity"]

_GRID_SQL = r"""
y AS (SELECT lpad(regexp_replace(regexp_extract(cik, '([0-9]+)', 1), '^0+([0-9])', '\1'), 10, '0') AS cik, arg_max(fiscal_year_end, (valid_from, known_at, version_id)) AS e
  FROM filer_history WHERE valid_from IS NOT NULL AND known_at IS NOT NULL AND fiscal_year_end IS NOT NULL GROUP BY 1),
m AS (SELECT cik, try_cast(substr(e, 1, 2) AS INT) AS m, try_cast(substr(e, 3, 2) AS INT) AS d FROM y),
z AS (SELECT cik, fy, m, d, make_date(fy, m, 1) AS a, make_date(fy - 1, m, 1) AS b FROM (SELECT *, unnest(range(2010, 2028)) AS fy FROM m WHERE m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31)),
grid AS (SELECT cik, fy, least((a + (d - 1) * INTERVAL 1 DAY)::DATE, CASE WHEN m = 2 THEN make_date(fy, 2, 28) ELSE last_day(a) END) AS "end",
  least((b + (d - 1) * INTERVAL 1 DAY)::DATE, CASE WHEN m = 2 THEN make_date(fy - 1, 2, 28) ELSE last_day(b) END) + 1 AS start FROM z)
"""


def _grid(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "filer_history").where("valid_from is not null and known_at is not null and fiscal_year_end is not null")
    last = F.max_by("fiscal_year_end", F.struct("valid_from", "known_at", "version_id"))
    return O.year_ends(v.groupBy(F.lpad(cik_number("cik"), 10, "0").alias("cik")).agg(last.alias("fiscal_year_end")), 2010, 2027)


@_query(f"""WITH {_GRID_SQL} SELECT cik, fy::INT AS fy, start, "end" FROM grid""")
def synthetic_fiscal_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d)


@_query(f"""WITH {FACTS_SQL}, {_GRID_SQL} SELECT fact_id, grid.fy::INT AS fy,
greatest(1, round_even((date_diff('day', grid.start, f."end") + 1) * 4 / (date_diff('day', grid.start, grid."end") + 1), 0))::INT AS quarter
FROM f JOIN grid ON f.cik = grid.cik AND f."end" BETWEEN grid.start AND grid."end" """)
def fiscal_labels(spark: SparkSession, d: str) -> DataFrame:
    return O.fiscal_periods(_facts(spark, d), _grid(spark, d))


_PLACES = " ".join(f"WHEN '{x}' THEN {i + 1}" for i, x in enumerate(BALANCE))


@_query(f"""WITH {FACTS_SQL}, {ALIASED_SQL}, {WINNER_SQL}, e AS (SELECT cik, "end" AS anchor_end FROM w WHERE alias = 'equity'),
l AS (SELECT w.cik, alias AS line, CASE alias {_PLACES} END AS position, val, CASE WHEN start IS NULL THEN "end" = anchor_end ELSE abs(date_diff('day', anchor_end, "end")) <= 7 END AS aligned FROM w JOIN e ON e.cik = w.cik)
SELECT cik, line, position, CASE WHEN aligned THEN val END AS val, aligned FROM l WHERE position IS NOT NULL""")
def statement_lines(spark: SparkSession, d: str) -> DataFrame:
    return O.statement(alias_winner(_facts(spark, d), alias_table(spark)), BALANCE, "equity")


@_query(f"""WITH {FACTS_SQL}, {ALIASED_SQL}, {WINNER_SQL} SELECT cik, abs(diluted_eps - net_income / nullif(shares, 0)) <= 0.05 * greatest(abs(diluted_eps), abs(net_income / nullif(shares, 0))) AS eps_ties,
abs(gross_profit - (revenue - cogs)) <= 0.01 * greatest(abs(gross_profit), abs(revenue - cogs)) AS gross_profit_ties FROM (SELECT w.cik, {", ".join(f"max(CASE WHEN alias = '{n}' THEN val END) AS {n}" for n in ("diluted_eps", "net_income", "shares", "gross_profit", "revenue", "cogs"))} FROM w GROUP BY w.cik)""")
def verify_checks(spark: SparkSession, d: str) -> DataFrame:
    w = alias_winner(_facts(spark, d), alias_table(spark))
    v = pivot_aliases(w, ["diluted_eps", "net_income", "shares", "gross_profit", "revenue", "cogs"])
    eps = O.tied(F.col("diluted_eps"), F.try_divide("net_income", "shares"), 0.05)
    gross = O.tied(F.col("gross_profit"), F.col("revenue") - F.col("cogs"), 0.01)
    return v.select("cik", eps.alias("eps_ties"), gross.alias("gross_profit_ties"))


@_query(f"""WITH {FACTS_SQL}, s AS (SELECT cik, tag, arg_max(val, ("end", filed, fact_id)) AS val FROM f WHERE unit = 'shares' AND tag IN ('entitycommonstocksharesoutstanding', 'commonstocksharesoutstanding') GROUP BY cik, tag),
p AS (SELECT cik, max(CASE WHEN tag = 'entitycommonstocksharesoutstanding' THEN val END) AS cover, max(CASE WHEN tag = 'commonstocksharesoutstanding' THEN val END) AS balance FROM s GROUP BY cik)
SELECT cik, cover, balance, cover / nullif(balance, 0) > 3 OR cover / nullif(balance, 0) < 0.33 AS diverges FROM p WHERE cover IS NOT NULL AND balance IS NOT NULL""")
def share_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Filers whose cover-page and balance-sheet share counts are far apart."""
    s = _facts(spark, d).where("unit = 'shares' and tag in ('entitycommonstocksharesoutstanding', 'commonstocksharesoutstanding')")
    last = s.groupBy("cik", "tag").agg(F.max_by("val", F.struct("end", "filed", "fact_id")).alias("val"))
    pick = lambda tag, name: F.max(F.when(F.col("tag") == tag, F.col("val"))).alias(name)
    p = last.groupBy("cik").agg(pick("entitycommonstocksharesoutstanding", "cover"), pick("commonstocksharesoutstanding", "balance")).where("cover is not null and balance is not null")
    return p.select("cik", "cover", "balance", O.diverges(F.col("cover"), F.col("balance")).alias("diverges"))


@_query(f"""WITH {FILINGS_SQL} SELECT cik, accession, report_date, filed FROM g WHERE date_trunc('month', report_date) = DATE '2020-03-01'
QUALIFY row_number() OVER (PARTITION BY cik ORDER BY (report_date = DATE '2020-03-31') DESC, filed DESC, filing_id DESC) = 1""")
def filing_of_quarter(spark: SparkSession, d: str) -> DataFrame:
    return O.of_quarter(filings(spark, d), F.lit("2020-03-31").cast("date"))


@_query(r"""WITH a AS (SELECT doc_id, regexp_replace(text, '<script\b.*?</script>', ' ', 'gis') AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '<style\b.*?</style>', ' ', 'gis'), '<table\b.*?</table>', ' ', 'gis') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'gs'), '[ \t\n\r\f\v]+', ' ', 'g'), '^ | $', '', 'g') AS t FROM b)
SELECT doc_id, length(t) AS n, md5(t) AS digest FROM c""")
def strip_tags(spark: SparkSession, d: str) -> DataFrame:
    plain = without_tags(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length(plain).cast("bigint").alias("n"), F.md5(plain).alias("digest"))


@_query(f"""WITH {FACTS_SQL} SELECT fact_id, entity_name, fy FROM f WHERE entity_name ILIKE '%bancorp%' AND fy = 2020""")
def facts_of_name(spark: SparkSession, d: str) -> DataFrame:
    """Case-insensitive substring filter over names."""
    return _facts(spark, d).where(F.contains(F.lower("entity_name"), F.lit("bancorp")) & (F.col("fy") == 2020)).select("fact_id", "entity_name", "fy")



@_query(f"""WITH {FACTS_SQL}, {ALIASED_SQL}, {WINNER_SQL}, o AS (SELECT cik, unit, "end", date_diff('day', start, "end") AS days, val FROM w WHERE alias = 'operating_cash_flow' AND start IS NOT NULL),
c AS (SELECT cik, unit, "end", val AS cash FROM w WHERE alias = 'cash'), z AS (SELECT cik, "end", CASE WHEN val < 0 THEN -val / (days / 30.4375::DOUBLE) END AS monthly_burn, cash FROM o JOIN c USING (cik, unit, "end") WHERE days > 0)
SELECT cik, "end", monthly_burn, cash / monthly_burn AS months FROM z""")
def cash_runway(spark: SparkSession, d: str) -> DataFrame:
    return O.runway(alias_winner(_facts(spark, d), alias_table(spark)))


@_query(f"""WITH {FILINGS_SQL}, n AS (SELECT filing_id, file_number FROM filings WHERE file_number <> ''), s AS (SELECT cik, file_number, max(filed) AS filed FROM g JOIN n USING (filing_id) GROUP BY cik, file_number),
t AS (SELECT * FROM s QUALIFY rank() OVER (PARTITION BY cik ORDER BY filed DESC) = 1) SELECT cik, filed, min(file_number) AS file_number FROM t GROUP BY cik, filed HAVING count(*) = 1""")
def latest_series(spark: SparkSession, d: str) -> DataFrame:
    numbers = table(spark, d, "filings").where("file_number <> ''").select("filing_id", "file_number")
    return O.latest_unless_tied(filings(spark, d).join(numbers, "filing_id"), ["cik"], "file_number", "filed")
