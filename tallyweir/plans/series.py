"""Queries over ordered series and derived metrics.

The series here is quarterly order value per nation, which is dense; the filing
facts themselves are sparse in time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.functions.metrics import BY_NAME, METRICS, envelope, value, Metric
from tallyweir.functions.periods import quarter_end
from tallyweir.functions.aliases import alias_table
from tallyweir.operators import series as S
from tallyweir.operators import facts as O
from tallyweir.operators.compare import pivot_aliases
from tallyweir.plans.facts import ALIASED_SQL, FACTS_SQL, WINNER_SQL, _facts
from tallyweir.sources.tables import table

QUERIES, SQL = {}, {}


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def quarterly(spark: SparkSession, d: str) -> DataFrame:
    """``cik, start, end, val``: value of the orders of each nation and quarter."""
    orders = table(spark, d, "orders").select("o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.col("o_orderdate").cast("date").alias("day"))
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("cik"))
    sums = orders.join(customer, "o_custkey").groupBy("cik", F.year("day").alias("y"), F.quarter("day").alias("q")).agg(F.sum("price").cast("double").alias("val"))
    end = quarter_end(F.col("y"), F.col("q"))
    return sums.select(F.col("cik").cast("bigint").alias("cik"), F.add_months(F.date_add(end, 1), -3).alias("start"), end.alias("end"), "val")


Q_SQL = """
q AS (SELECT c_nationkey::BIGINT AS cik, date_trunc('quarter', o_orderdate)::DATE AS start, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS "end",
  sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS val FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
"""
NUMBERED_SQL = """i AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY "end") - 1 AS i, count(*) OVER (PARTITION BY cik) AS n FROM q)"""
SLOPE_SQL = """s AS (SELECT cik, regr_slope(val, i) AS slope, avg(abs(val)) AS mean_size, count(*) AS n, arg_min(val, "end") AS first, arg_max(val, "end") AS last FROM i GROUP BY cik)"""
POINT_SQL = """
p AS (SELECT cik, split, regr_slope(CASE WHEN i < split THEN val END, i) AS left_slope, regr_slope(CASE WHEN i >= split THEN val END, i) AS right_slope,
  avg(abs(val)) AS mean_size, min(CASE WHEN i = split THEN "end" END) AS split_end FROM (SELECT *, unnest(range(3, n - 2)) AS split FROM i WHERE n >= 6) GROUP BY cik, split),
c AS (SELECT *, round(abs(right_slope - left_slope), 4) AS change FROM p QUALIFY row_number() OVER (PARTITION BY cik ORDER BY change DESC, split) = 1)
"""


@_query(f"""WITH {Q_SQL}, l AS (SELECT *, date_diff('day', lag("end", 1) OVER w, "end") AS g0, date_diff('day', lag("end", 2) OVER w, lag("end", 1) OVER w) AS g1,
  date_diff('day', lag("end", 3) OVER w, lag("end", 2) OVER w) AS g2, sum(val::DECIMAL(38,2)) OVER (PARTITION BY cik ORDER BY "end" ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS four,
  lag("end", 3) OVER w AS begin FROM q WINDOW w AS (PARTITION BY cik ORDER BY "end")),
ok AS (SELECT *, coalesce(g0 BETWEEN 80 AND 110 AND g1 BETWEEN 80 AND 110 AND g2 BETWEEN 80 AND 110, false) AS good FROM l)
SELECT cik, arg_max(four, "end") FILTER (WHERE good)::DOUBLE AS ttm, max("end") FILTER (WHERE good) AS period_end, arg_max(begin, "end") FILTER (WHERE good) AS first_end,
max("end") AS latest_end FROM ok GROUP BY cik""")
def ttm_quarters(spark: SparkSession, d: str) -> DataFrame:
    return S.ttm_quarters(quarterly(spark, d))


def _annual_and_ytd(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = quarterly(spark, d).select("cik", "end", F.year("end").alias("y"), F.quarter("end").alias("n"), F.col("val").cast("decimal(38,2)").alias("val"))
    annual = q.groupBy("cik", "y").agg(F.sum("val").cast("double").alias("val"), F.count(F.lit(1)).alias("k"), F.max("end").alias("end")).where("k = 4").select("cik", "end", "val")
    start = F.make_date("y", F.lit(1), F.lit(1))
    half = q.where("n <= 2").groupBy("cik", "y").agg(F.sum("val").cast("double").alias("val"), F.count(F.lit(1)).alias("k"), F.max("end").alias("end")).where("k = 2")
    return annual, half.select("cik", start.alias("start"), "end", "val")


@_query(f"""WITH {Q_SQL}, a AS (SELECT cik, year("end") AS y, sum(val::DECIMAL(38,2))::DOUBLE AS val, max("end") AS "end" FROM q GROUP BY cik, y HAVING count(*) = 4),
h AS (SELECT cik, year("end") AS y, make_date(year("end"), 1, 1) AS start, sum(val::DECIMAL(38,2))::DOUBLE AS val, max("end") AS "end" FROM q WHERE quarter("end") <= 2 GROUP BY ALL HAVING count(*) = 2),
y AS (SELECT cik, max("end") AS fy_end, arg_max(val, "end") AS fy_val FROM a GROUP BY cik),
n AS (SELECT h.* FROM h JOIN y USING (cik) WHERE "end" > fy_end QUALIFY row_number() OVER (PARTITION BY cik ORDER BY "end" DESC, start DESC) = 1),
b AS (SELECT n.cik, h.val AS was FROM n JOIN h USING (cik) WHERE date_diff('day', h."end", n."end") BETWEEN 350 AND 380
  AND abs(date_diff('day', n.start, n."end") - date_diff('day', h.start, h."end")) <= 7
  QUALIFY row_number() OVER (PARTITION BY n.cik ORDER BY abs(date_diff('day', n.start, n."end") - date_diff('day', h.start, h."end")), date_diff('day', h."end", n."end")) = 1)
SELECT y.cik, CASE WHEN n.cik IS NULL THEN fy_val ELSE fy_val + n.val - was END AS ttm, coalesce(n."end", fy_end) AS period_end, CASE WHEN n.cik IS NULL THEN 'fy' ELSE 'stub' END AS basis
FROM y LEFT JOIN n ON n.cik = y.cik LEFT JOIN b ON b.cik = y.cik""")
def ttm_stub(spark: SparkSession, d: str) -> DataFrame:
    return S.ttm_stub(*_annual_and_ytd(spark, d))


def _growth_sql(low: int, high: int) -> str:
    return f"""WITH {Q_SQL}, p AS (SELECT a.cik, a."end", a.val, b."end" AS prior_end, b.val AS prior_val FROM q a JOIN q b ON a.cik = b.cik AND date_diff('day', b."end", a."end") BETWEEN {low} AND {high}
  QUALIFY row_number() OVER (PARTITION BY a.cik, a."end" ORDER BY b."end" DESC) = 1)
SELECT cik, "end", val, prior_end, prior_val, (val - prior_val) / abs(prior_val) AS rate FROM p WHERE prior_val <> 0"""


@_query(_growth_sql(350, 380))
def growth_yoy(spark: SparkSession, d: str) -> DataFrame:
    return S.growth(quarterly(spark, d), S.YEAR_GAP)


@_query(_growth_sql(80, 110))
def growth_qoq(spark: SparkSession, d: str) -> DataFrame:
    return S.growth(quarterly(spark, d), S.QUARTER_GAP)


@_query(f"""WITH {Q_SQL}, l AS (SELECT *, lag(val) OVER w AS p, lag(date_diff('day', start, "end")) OVER w AS pl FROM q WINDOW w AS (PARTITION BY cik ORDER BY "end"))
SELECT cik, "end", val, CASE WHEN abs(date_diff('day', start, "end") - pl) <= 7 AND p <> 0 THEN (val - p) / abs(p) END AS delta FROM l""")
def deltas(spark: SparkSession, d: str) -> DataFrame:
    return S.deltas(quarterly(spark, d)).select("cik", "end", "val", "delta")


@_query(f"""WITH {Q_SQL}, k AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY cik ORDER BY "end" DESC) <= 13),
e AS (SELECT cik, arg_max(val, "end") AS last, arg_min(val, "end") AS first, count(*) AS n FROM k GROUP BY cik)
SELECT cik, last, first, n, round(CASE WHEN first > 0 AND last > 0 AND n > 1 THEN pow(last / first, 4.0 / (n - 1)) - 1 END, 8) AS cagr FROM e""")
def cagr(spark: SparkSession, d: str) -> DataFrame:
    return S.cagr(quarterly(spark, d), 3, 4).select("cik", "last", "first", "n", F.round("cagr", 8).alias("cagr"))


@_query(f"""WITH {Q_SQL}, {NUMBERED_SQL}, {SLOPE_SQL} SELECT cik, round(slope, 2) AS slope, n, first, last FROM s""")
def trend_slope(spark: SparkSession, d: str) -> DataFrame:
    return S.slopes(quarterly(spark, d)).select("cik", F.round("slope", 2).alias("slope"), "n", "first", "last")


@_query(f"""WITH {Q_SQL}, {NUMBERED_SQL}, {POINT_SQL} SELECT cik, split::INT AS split, split_end, round(left_slope, 0) AS left_slope, round(right_slope, 0) AS right_slope FROM c
WHERE mean_size > 0 AND change / mean_size >= 0.05""")
def change_point(spark: SparkSession, d: str) -> DataFrame:
    return S.change_points(quarterly(spark, d)).select("cik", "split", "split_end", F.round("left_slope", 0).alias("left_slope"), F.round("right_slope", 0).alias("right_slope"))


@_query(f"""WITH {Q_SQL}, {NUMBERED_SQL}, {SLOPE_SQL}, {POINT_SQL}, j AS (SELECT s.cik, s.slope, s.mean_size, k.left_slope AS l, k.right_slope AS r FROM s
  LEFT JOIN (SELECT * FROM c WHERE mean_size > 0 AND change / mean_size >= 0.05) k ON k.cik = s.cik)
SELECT cik, CASE WHEN slope IS NULL THEN 'unknown'
  WHEN l IS NOT NULL THEN CASE WHEN (l < 0) <> (r < 0) THEN 'inflecting' WHEN r > 0 AND r > l THEN 'accelerating' WHEN r > 0 THEN 'decelerating' WHEN r < l THEN 're-decelerating' ELSE 'contracting' END
  WHEN abs(slope) < 0.005 * mean_size THEN 'stable' WHEN slope > 0 THEN 'expanding' ELSE 'contracting' END AS label FROM j""")
def trend_label(spark: SparkSession, d: str) -> DataFrame:
    q = quarterly(spark, d)
    points = S.change_points(q).select("cik", "left_slope", "right_slope")
    label = S.trend_label(F.col("slope"), F.col("mean_size"), F.col("left_slope"), F.col("right_slope"))
    return S.slopes(q).join(points, "cik", "left").select("cik", label.alias("label"))


# Metrics over the aliased facts of each filer.
_NAMES = sorted({n for m in METRICS for n in (*m.inputs, *(m.instead.inputs if m.instead else ()))})
_WIDE_SQL = "v AS (SELECT cik, " + ", ".join(f"max(CASE WHEN alias = '{n}' THEN val END) AS {n}" for n in _NAMES) + " FROM w GROUP BY cik)"
_BASE_SQL = f"WITH {FACTS_SQL}, {ALIASED_SQL}, {WINNER_SQL}, {_WIDE_SQL}"


def wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per filer with the freshest value of every alias the metrics need."""
    return pivot_aliases(O.alias_winner(_facts(spark, d), alias_table(spark)), _NAMES)


def _metric_sql(name: str) -> str:
    m = BY_NAME[name]
    if m.instead:
        first, second = (_formula_sql(x).rsplit(" AS ", 1)[0] for x in (m, m.instead))
        return f"CASE WHEN {m.plus[0]} IS NULL THEN {second} ELSE {first} END AS {name}"
    return _formula_sql(m)


def _formula_sql(m: Metric) -> str:
    name = m.name
    of = lambda n: f"coalesce({n}, 0)" if n in m.optional else n
    top = " + ".join(map(of, m.plus)) + "".join(f" - {of(n)}" for n in m.minus)
    return f"({top}) / nullif({' + '.join(map(of, m.over))}, 0) AS {name}" if m.over else f"({top}) AS {name}"


# Which metrics each bundle reports.
_BUNDLES = {
    "ratios_margins": ("gross_margin", "operating_margin", "net_margin", "ebitda_margin"),
    "ratios_returns": ("roe", "roa", "asset_turnover"),
    "ratios_liquidity": ("current_ratio", "quick_ratio", "working_capital"),
    "ratios_leverage": ("debt_to_equity", "debt_to_ebitda", "net_debt"),
    "fcf_family": ("fcf", "fcf_margin", "ebitda", "tangible_book_value"),
    "per_share": ("bvps", "fcf_per_share", "sales_per_share"),
}


def _bundle(name: str, metrics: tuple[str, ...]) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return wide(spark, d).select("cik", *[value(BY_NAME[m]).alias(m) for m in metrics])

    run.__name__ = name
    _query(f"{_BASE_SQL} SELECT cik, {', '.join(map(_metric_sql, metrics))} FROM v")(run)


for _name, _metrics in _BUNDLES.items():
    _bundle(_name, _metrics)


def _lacks_sql(m: Metric) -> str:
    return " || ".join(f"CASE WHEN {n} IS NULL THEN '{n},' ELSE '' END" for n in m.inputs if n not in m.optional)


_MISSING_SQL = " UNION ALL ".join(
    f"SELECT cik, '{m.name}' AS metric, {_metric_sql(m.name).rsplit(' AS ', 1)[0]} AS value, "
    + (f"CASE WHEN {m.plus[0]} IS NULL THEN {_lacks_sql(m.instead)} ELSE {_lacks_sql(m)} END" if m.instead else _lacks_sql(m))
    + " AS missing FROM v"
    for m in METRICS
)


@_query(f"{_BASE_SQL} SELECT cik, metric, value, rtrim(missing, ',') AS missing FROM ({_MISSING_SQL})")
def metric_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """All metrics of all filers in long form, with what each one lacks."""
    every = F.explode(F.array(*[envelope(m).cast("struct<metric:string,value:double,formula:string,inputs:array<struct<name:string,value:double>>,caveats:array<string>,missing_inputs:array<string>>") for m in METRICS]))
    return wide(spark, d).select("cik", every.alias("e")).select("cik", "e.metric", "e.value", F.array_join("e.missing_inputs", ",").alias("missing"))


@_query(f"""{_BASE_SQL} SELECT cik, (net_income - operating_cash_flow) / nullif(assets, 0) AS accruals, abs((net_income - operating_cash_flow) / nullif(assets, 0)) > 0.10 AS accruals_flag,
operating_cash_flow / nullif(net_income, 0) AS ocf_to_ni, operating_cash_flow / nullif(net_income, 0) < 0.80 AS ocf_to_ni_flag FROM v""")
def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    accruals = F.try_divide(F.col("net_income") - F.col("operating_cash_flow"), F.col("assets"))
    cover = F.try_divide("operating_cash_flow", "net_income")
    return wide(spark, d).select("cik", accruals.alias("accruals"), (F.abs(accruals) > 0.10).alias("accruals_flag"), cover.alias("ocf_to_ni"), (cover < 0.80).alias("ocf_to_ni_flag"))


@_query(f"""{_BASE_SQL}, z AS (SELECT cik, unnest(['assets', 'cash', 'debt', 'equity']) AS line, unnest([assets, cash, debt, equity]) AS val FROM v)
SELECT cik, count(val) AS filled, round_even(count(val) / 4.0, 2)::DOUBLE AS coverage FROM z GROUP BY cik""")
def statement_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many of a statement's lines each filer reports."""
    filled = sum((F.col(n).isNotNull().cast("bigint") for n in ("assets", "cash", "debt", "equity")), F.lit(0).cast("bigint"))
    return wide(spark, d).select("cik", filled.alias("filled"), F.bround(filled / 4, 2).alias("coverage"))
