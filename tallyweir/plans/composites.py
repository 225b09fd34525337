"""Queries that put several operators together over all filers: ratios aligned to
one period, quality flags, and the series operators over tagged facts.

The SQL of a series query is that of its twin over orders, with another series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.functions.aliases import alias_table
from tallyweir.operators.facts import available
from tallyweir.functions.instants import parse_day, parse_instant
from tallyweir.functions.keys import accession_18, cik_number
from tallyweir.functions.metrics import METRICS, value
from tallyweir.operators import facts as O
from tallyweir.operators import series as S
from tallyweir.operators.compare import nearest_instants, pivot_aliases
from tallyweir.plans import series as P
from tallyweir.plans.facts import ALIASED_SQL, CUTOFF, FACTS_SQL, TYPE_SQL, _facts
from tallyweir.plans.pipeline import parts_sql
from tallyweir.sources.tables import table

QUERIES, SQL = {}, {}

# Aliases of flows and of instants, the ones an anchor is taken from, and the days an instant may be off.
FLOWS = ("revenue", "cogs", "gross_profit", "operating_income", "net_income", "dna", "operating_cash_flow", "capex", "stock_compensation")
INSTANTS = ("assets", "equity", "cash", "debt", "short_term_debt", "assets_current", "liabilities_current", "inventory", "goodwill", "intangibles", "accounts_receivable", "shares_outstanding")
ANCHORS = ("revenue", "net_income", "operating_income")
ALIGNED_DAYS = 14


def _query(sql: str | None = None, name: str | None = None):
    def add(fn: Callable) -> Callable:
        QUERIES[name or fn.__name__] = fn
        if sql:
            SQL[name or fn.__name__] = sql
        return fn

    return add


def aligned(spark: SparkSession, d: str) -> DataFrame:
    """One row per filer with annual flows: the freshest value of each flow, and of
    each instant the one nearest to the end of the flows (an earlier one before a later
    one thrice as near). ``period_end`` is that end, ``misaligned`` lists the
    instants more than 14 days off."""
    f = _facts(spark, d)
    annual = O.alias_winner(O.enriched(f).where("period_type = 'annual'"), alias_table(spark)).where(F.col("alias").isin(*FLOWS))
    ends = {n: F.max(F.when(F.col("alias") == n, F.col("end"))) for n in ANCHORS}
    anchor = annual.groupBy("cik").agg(F.coalesce(*ends.values()).alias("period_end")).where("period_end is not null")
    instants = O.with_alias(f.where("start is null"), alias_table(spark)).where(F.col("alias").isin(*INSTANTS))
    near = nearest_instants(instants, anchor)
    off = near.where(F.col("off") > ALIGNED_DAYS).groupBy("cik").agg(F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("misaligned"))  # few aliases
    flows, stocks = pivot_aliases(annual, list(FLOWS)), pivot_aliases(near, list(INSTANTS))
    return anchor.join(flows, "cik").join(stocks, "cik", "left").join(off, "cik", "left").withColumn("shares", F.col("shares_outstanding"))


_pick = lambda names, rel: ", ".join(f"max(CASE WHEN alias = '{n}' THEN val END) AS {n}" for n in names)
ALIGNED_SQL = f"""WITH {FACTS_SQL}, {ALIASED_SQL},
xa AS (SELECT * FROM x WHERE {TYPE_SQL} = 'annual' AND alias IN ({", ".join(f"'{n}'" for n in FLOWS)})),
ba AS (SELECT * FROM xa QUALIFY row_number() OVER (PARTITION BY cik, alias, precedence, unit ORDER BY CASE WHEN "end" > filed THEN 1 ELSE 0 END, "end" DESC, (frame IS NOT NULL) DESC, date_diff('day', start, "end") DESC, filed DESC, fact_id DESC) = 1),
wa AS (SELECT * FROM ba QUALIFY row_number() OVER (PARTITION BY cik, alias ORDER BY "end" DESC, filed DESC, precedence, unit) = 1),
an AS (SELECT cik, coalesce({", ".join(f"max(CASE WHEN alias = '{n}' THEN \"end\" END)" for n in ANCHORS)}) AS period_end FROM wa GROUP BY cik),
ni AS (SELECT x.cik, alias, val, abs(date_diff('day', period_end, "end")) * CASE WHEN "end" > period_end THEN 3 ELSE 1 END AS off, precedence, filed, fact_id FROM x JOIN an ON an.cik = x.cik AND period_end IS NOT NULL
  WHERE start IS NULL AND alias IN ({", ".join(f"'{n}'" for n in INSTANTS)}) QUALIFY row_number() OVER (PARTITION BY x.cik, alias ORDER BY off, precedence, filed DESC, fact_id DESC) = 1),
fl AS (SELECT cik, {_pick(FLOWS, "wa")} FROM wa GROUP BY cik),
st AS (SELECT cik, {_pick(INSTANTS, "ni")}, nullif(string_agg(DISTINCT CASE WHEN off > {ALIGNED_DAYS} THEN alias END, ',' ORDER BY CASE WHEN off > {ALIGNED_DAYS} THEN alias END), '') AS misaligned FROM ni GROUP BY cik),
v AS (SELECT an.cik, period_end, misaligned, shares_outstanding AS shares, {", ".join(FLOWS + INSTANTS)} FROM an JOIN fl ON fl.cik = an.cik LEFT JOIN st ON st.cik = an.cik WHERE period_end IS NOT NULL)
"""


@_query(f"{ALIGNED_SQL} SELECT cik, period_end, misaligned, {', '.join(P._metric_sql(m.name) for m in METRICS)} FROM v")
def ratios_aligned(spark: SparkSession, d: str) -> DataFrame:
    """All ratios of all filers, flows and instants of one fiscal year."""
    return aligned(spark, d).select("cik", "period_end", "misaligned", *[value(m).alias(m.name) for m in METRICS])


_RESTATED_SQL = """u AS (SELECT cik, tag, start, "end", count(DISTINCT val) AS n FROM f WHERE tag IN ('revenues', 'netincomeloss', 'assets') GROUP BY ALL),
k AS (SELECT cik, count(*) AS restated FROM u WHERE n > 1 GROUP BY cik)"""


@_query(f"""{ALIGNED_SQL}, {_RESTATED_SQL}, q AS (SELECT v.cik, period_end, (net_income - operating_cash_flow) / nullif(assets, 0) AS accruals_ratio, operating_cash_flow / nullif(net_income, 0) AS ocf_to_ni,
  accounts_receivable / nullif(revenue, 0) AS ar_to_revenue, stock_compensation / nullif(revenue, 0) AS sbc_to_revenue, inventory / nullif(cogs / 365, 0) AS inventory_days, coalesce(restated, 0) AS restatement_count FROM v LEFT JOIN k ON k.cik = v.cik)
SELECT *, CASE WHEN abs(accruals_ratio) > 0.10 THEN 1 ELSE 0 END + CASE WHEN ocf_to_ni < 0.80 THEN 1 ELSE 0 END + CASE WHEN sbc_to_revenue > 0.15 THEN 1 ELSE 0 END + CASE WHEN restatement_count > 0 THEN 1 ELSE 0 END AS flagged_count FROM q""")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    """The six quality figures of each filer and how many of them are flagged:
    accruals beyond a tenth of assets, cash flow under 0.8 of income, stock compensation
    over 0.15 of revenue, any restated period; two have no threshold."""
    over = lambda a, b: F.try_divide(F.col(a), F.col(b))
    restated = _facts(spark, d).where(F.col("tag").isin("revenues", "netincomeloss", "assets")).groupBy("cik", "tag", "start", "end").agg(F.count_distinct("val").alias("n"))
    counts = restated.where("n > 1").groupBy("cik").agg(F.count(F.lit(1)).alias("restated"))
    q = aligned(spark, d).join(counts, "cik", "left").select(
        "cik", "period_end", F.try_divide(F.col("net_income") - F.col("operating_cash_flow"), F.col("assets")).alias("accruals_ratio"), over("operating_cash_flow", "net_income").alias("ocf_to_ni"),
        over("accounts_receivable", "revenue").alias("ar_to_revenue"), over("stock_compensation", "revenue").alias("sbc_to_revenue"),
        F.try_divide(F.col("inventory"), F.col("cogs") / 365).alias("inventory_days"), F.coalesce("restated", F.lit(0).cast("bigint")).alias("restatement_count"),
    )
    flags = (F.abs("accruals_ratio") > 0.10, F.col("ocf_to_ni") < 0.80, F.col("sbc_to_revenue") > 0.15, F.col("restatement_count") > 0)
    return q.withColumn("flagged_count", sum((F.coalesce(f.cast("int"), F.lit(0)) for f in flags), F.lit(0)))


def fact_series(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """``cik, start, end, val`` of every filer and flow (``cik`` holds both): of each
    end the first concept in precedence, latest filed, of facts of the kind asked for."""
    x = O.with_alias(O.enriched(_facts(spark, d)).where(F.col("period_type") == kind), alias_table(spark)).where(F.col("alias").isin(*FLOWS))
    best = F.min_by(F.struct("start", "val"), F.struct("precedence", -F.unix_date("filed"), -F.col("fact_id"))).alias("b")
    return x.groupBy(F.concat("cik", F.lit("|"), "alias").alias("cik"), "end").agg(best).select("cik", "b.start", "end", "b.val")


def _series_sql(kind: str, name: str = "q") -> str:
    flows = ", ".join(f"'{n}'" for n in FLOWS)
    return f"""{name} AS (SELECT cik || '|' || alias AS cik, start, "end", val FROM x WHERE {TYPE_SQL} = '{kind}' AND alias IN ({flows})
  QUALIFY row_number() OVER (PARTITION BY cik, alias, "end" ORDER BY precedence, filed DESC, fact_id DESC) = 1)"""


def _twin(name: str, kind: str, run: Callable[[DataFrame], DataFrame]) -> None:
    sql = P.SQL[name].replace(P.Q_SQL, f"{FACTS_SQL}, {ALIASED_SQL}, {_series_sql(kind)}\n")

    def query(spark: SparkSession, d: str) -> DataFrame:
        return run(fact_series(spark, d, kind))

    query.__name__ = f"facts_{name}"
    _query(sql, query.__name__)(query)


_twin("ttm_quarters", "quarterly", S.ttm_quarters)
_twin("growth_yoy", "annual", lambda q: S.growth(q, S.YEAR_GAP))
_twin("growth_qoq", "quarterly", lambda q: S.growth(q, S.QUARTER_GAP))
_twin("deltas", "annual", lambda q: S.deltas(q).select("cik", "end", "val", "delta"))


@_query(f"""WITH {FACTS_SQL}, {ALIASED_SQL}, {_series_sql("annual")}, k AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY cik ORDER BY "end" DESC) <= 6),
e AS (SELECT cik, arg_max(val, "end") AS last, arg_min(val, "end") AS first, count(*) AS n FROM k GROUP BY cik)
SELECT cik, last, first, n, round(CASE WHEN first > 0 AND last > 0 AND n > 1 THEN pow(last / first, 1.0 / (n - 1)) - 1 END, 6) AS cagr FROM e""")
def facts_cagr(spark: SparkSession, d: str) -> DataFrame:
    return S.cagr(fact_series(spark, d, "annual"), 5, 1).select("cik", "last", "first", "n", F.round("cagr", 6).alias("cagr"))


_STUB_SQL = P.SQL["ttm_stub"][P.SQL["ttm_stub"].index("y AS (SELECT cik, max") :].replace("FROM a GROUP BY", "FROM full_years GROUP BY")
_FOUR_SQL, _FOUR_END = P.SQL["ttm_quarters"].replace(f"WITH {P.Q_SQL}, ", "").split("\nSELECT cik, arg_max(four")


@_query(f"""WITH {FACTS_SQL}, {ALIASED_SQL}, {_series_sql("quarterly")}, {_series_sql("annual", "full_years")}, {_series_sql("ytd", "h")},
{_FOUR_SQL}, tq AS (SELECT cik, arg_max(four{_FOUR_END}), sb AS (WITH {_STUB_SQL})
SELECT coalesce(tq.cik, sb.cik) AS cik, coalesce(tq.ttm, sb.ttm) AS ttm, CASE WHEN tq.ttm IS NOT NULL THEN tq.period_end ELSE sb.period_end END AS period_end,
CASE WHEN tq.ttm IS NOT NULL THEN 'quarters' ELSE sb.basis END AS basis FROM tq FULL JOIN sb ON tq.cik = sb.cik WHERE coalesce(tq.ttm, sb.ttm) IS NOT NULL""")
def facts_ttm(spark: SparkSession, d: str) -> DataFrame:
    """The last twelve months of every filer and flow: four quarters that follow one
    another where there are, else the year with its stubs."""
    return S.ttm(fact_series(spark, d, "quarterly"), fact_series(spark, d, "annual"), fact_series(spark, d, "ytd"))


_SUBS = "SELECT 'acceptancedatetime' AS tbl, sub_id AS row_id, 'a' AS fld, acceptancedatetime AS raw FROM submissions UNION ALL SELECT 'filingdate', sub_id, 'f', filingdate FROM submissions"


@_query(rf"""WITH {parts_sql(_SUBS).strip()},
m AS (SELECT replace(trim(accessionnumber), '-', '') AS accession, lpad(regexp_replace(regexp_extract(cik, '([0-9]+)', 1), '^0+([0-9])', '\1'), 10, '0') AS cik, sub_id FROM submissions
  WHERE regexp_full_match(replace(trim(accessionnumber), '-', ''), '[0-9]{{18}}') AND replace(trim(accessionnumber), '-', '') <> '000000000000000000' AND regexp_extract(cik, '([0-9]+)', 1) <> ''),
s AS (SELECT cik, accession, min(a.utc) AS accepted, min(f.day) AS filed FROM m LEFT JOIN days a ON a.row_id = sub_id AND a.tbl = 'acceptancedatetime' LEFT JOIN days f ON f.row_id = sub_id AND f.tbl = 'filingdate' GROUP BY cik, accession)
SELECT cik, count(*) AS filings, count(*) FILTER (WHERE CASE WHEN accepted IS NOT NULL THEN accepted <= TIMESTAMP '{CUTOFF}' ELSE coalesce(filed < DATE '{CUTOFF[:10]}' - 1, false) END) AS public_filings,
count(*) FILTER (WHERE accepted IS NULL) AS by_day, count(*) FILTER (WHERE accepted IS NULL AND filed IS NULL) AS unplaced, max(accepted) FILTER (WHERE accepted <= TIMESTAMP '{CUTOFF}') AS last_accepted FROM s GROUP BY cik""")
def replay_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What of each filer's list was public at the cutoff, over all fetched entries, and
    how well that is known: filings placed by their day alone, and not at all."""
    s = table(spark, d, "submissions").select(
        F.lpad(cik_number("cik"), 10, "0").alias("cik"), accession_18("accessionnumber").alias("accession"),
        parse_instant(F.col("acceptancedatetime").cast("string")).alias("accepted"), parse_day(F.col("filingdate").cast("string")).alias("filed"),
    ).where("cik is not null and accession is not null").groupBy("cik", "accession").agg(F.min("accepted").alias("accepted"), F.min("filed").alias("filed"))
    public = available(F.col("filed"), F.col("accepted"), F.lit(CUTOFF).cast("timestamp"), True)
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return s.groupBy("cik").agg(
        F.count(F.lit(1)).alias("filings"), n(public, "public_filings"), n(F.col("accepted").isNull(), "by_day"), n(F.col("accepted").isNull() & F.col("filed").isNull(), "unplaced"),
        F.max(F.when(F.col("accepted") <= F.lit(CUTOFF).cast("timestamp"), F.col("accepted"))).alias("last_accepted"),
    )
