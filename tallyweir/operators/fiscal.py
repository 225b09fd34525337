"""Fiscal calendars, statements and checks between reported numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweir.functions.periods import aligned


def year_ends(filers: DataFrame, since: int, until: int) -> DataFrame:
    """``cik, fy, start, end`` from a month and day (MMDD); a day the month lacks is
    its last, and the 29th of February counts as the 28th."""
    month, day = F.substring("fiscal_year_end", 1, 2).try_cast("int"), F.substring("fiscal_year_end", 3, 2).try_cast("int")
    rows = filers.select("cik", month.alias("m"), day.alias("d"), F.explode(F.sequence(F.lit(since), F.lit(until))).alias("fy")).where("m between 1 and 12 and d between 1 and 31")

    def at(year: Column) -> Column:
        first = F.make_date(year, F.col("m"), F.lit(1))
        last = F.when(F.col("m") == 2, F.make_date(year, F.lit(2), F.lit(28))).otherwise(F.last_day(first))
        return F.least(F.date_add(first, F.col("d") - 1), last)

    return rows.select("cik", "fy", F.date_add(at(F.col("fy") - 1), 1).alias("start"), at(F.col("fy")).alias("end"))


def fiscal_periods(facts: DataFrame, grid: DataFrame) -> DataFrame:
    """``fact_id, fy, quarter``: the fiscal year whose span holds a fact's end, and
    the quarter it ends, by quarters of the span rounded half to even.

    Each filer's years don't overlap, so an end falls into one of them; the join
    goes by filer and calendar year, of which a span touches two.
    """
    years = grid.select("cik", "fy", F.col("start").alias("fy_start"), F.col("end").alias("fy_end"), F.explode(F.array_distinct(F.array(F.year("start"), F.year("end")))).alias("y"))
    joined = facts.select("fact_id", "cik", "end", F.year("end").alias("y")).join(years, ["cik", "y"]).where(F.col("end").between(F.col("fy_start"), F.col("fy_end")))
    quarter = F.bround((F.date_diff("end", "fy_start") + 1) * 4 / (F.date_diff("fy_end", "fy_start") + 1), 0).cast("int")
    return joined.select("fact_id", "fy", F.greatest(F.lit(1), quarter).alias("quarter"))


def tied(stated: Column, derived: Column, tolerance: float) -> Column:
    """Whether two numbers agree within a share of the larger; NULL if one lacks."""
    return F.abs(stated - derived) <= tolerance * F.greatest(F.abs(stated), F.abs(derived))


def statement(winners: DataFrame, lines: list[str], anchor: str) -> DataFrame:
    """``cik, line, position, val, aligned``: a statement's lines in order. The anchor
    line sets the period; a flow that ends more than a week off, or an instant on
    another day, is shown as missing."""
    ends = winners.where(F.col("alias") == anchor).select("cik", F.col("end").alias("anchor_end"))
    place = F.array_position(F.array(*[F.lit(x) for x in lines]), F.col("alias")).cast("int")
    rows = winners.where(F.col("alias").isin(*lines)).join(ends, "cik").withColumn("aligned", aligned(F.col("start"), F.col("end"), F.col("anchor_end")))
    return rows.select("cik", F.col("alias").alias("line"), place.alias("position"), F.when(F.col("aligned"), F.col("val")).alias("val"), "aligned")


def diverges(first: Column, second: Column) -> Column:
    """Whether two share counts differ by more than a factor of three."""
    ratio = F.try_divide(first, second)
    return (ratio > 3) | (ratio < 0.33)


def baseline_shares(statements: DataFrame) -> DataFrame:
    """Per filing the best statement of shares outstanding (before an offering,
    dated, issued and outstanding, latest as-of day), then per filer the latest.

    ``statements(cik, accession, filed, as_of, before_offering, issued, after_offering, shares)``.
    """
    usable = statements.where("not coalesce(after_offering, false) and shares is not null")
    order = F.struct(F.coalesce("before_offering", F.lit(False)), F.col("as_of").isNotNull(), F.coalesce("issued", F.lit(False)), F.col("as_of"), F.col("shares"))
    per_filing = usable.groupBy("cik", "accession", "filed").agg(F.max_by(F.struct("shares", "as_of"), order).alias("s"))
    last = F.max_by(F.struct("accession", "filed", "s.shares", "s.as_of"), F.struct(F.coalesce("s.as_of", "filed"), "filed", "accession"))
    return per_filing.groupBy("cik").agg(last.alias("r")).select("cik", "r.*")


def of_quarter(filings: DataFrame, quarter_end: Column) -> DataFrame:
    """Per filer the filing for a quarter: reported on its last day, else in its last
    month; the latest filed of equals."""
    exact = F.col("report_date") == quarter_end
    near = F.trunc("report_date", "month") == F.trunc(quarter_end, "month")
    order = F.struct(exact, F.col("filed"), F.col("filing_id"))
    return filings.where(near).groupBy("cik").agg(F.max_by(F.struct("accession", "report_date", "filed"), order).alias("r")).select("cik", "r.*")


def runway(winners: DataFrame) -> DataFrame:
    """``cik, end, monthly_burn, months``: how long cash lasts at the rate of the last
    operating flow. All inputs must share the latest end and be in one currency;
    a flow that is not negative has no runway, not an endless one."""
    flow = winners.where("alias = 'operating_cash_flow' and start is not null").select("cik", "unit", "end", F.date_diff("end", "start").alias("days"), F.col("val").alias("flow"))
    cash = winners.where("alias = 'cash'").select("cik", "unit", "end", F.col("val").alias("cash"))
    both = flow.join(cash, ["cik", "unit", "end"]).where("days > 0")
    burn = F.when(F.col("flow") < 0, -F.col("flow") / (F.col("days") / F.lit(30.4375)))
    return both.select("cik", "end", burn.alias("monthly_burn"), F.try_divide(F.col("cash"), burn).alias("months"))


def latest_unless_tied(rows: DataFrame, keys: list[str], series: str, at: str) -> DataFrame:
    """Per key the series with the latest row; keys whose latest rows belong to more
    than one series are left out, as either could be meant. Rows without ``at`` come
    before all others."""
    last = rows.groupBy(*keys, series).agg(F.max(at).alias(at))
    top = last.groupBy(*keys).agg(F.max(at).alias("_top"))
    return last.join(top, keys).where(F.col(at).eqNullSafe(F.col("_top"))).groupBy(*keys, at).agg(F.count(F.lit(1)).alias("n"), F.min(series).alias(series)).where("n = 1").drop("n")
