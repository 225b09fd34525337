"""Ordered series of one concept per filer: sums of four quarters, growth, trend.

A series is a DataFrame ``cik, end, val`` (and ``start``, ``filed`` where said)
with one row per filer and period end. Windows are partitioned by filer, whose
series is short; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweir.functions.periods import TOLERANCE_DAYS

#: Gaps in days between quarters, and between a year's or quarter's ends.
QUARTER_GAP, YEAR_GAP = (80, 110), (350, 380)
#: A change point needs so many points, so many on each side, and so
#: large a difference of slopes against the mean size; below STABLE a trend is flat.
LEAST_POINTS, LEAST_SIDE, LEAST_CHANGE, STABLE = 6, 3, 0.05, 0.005


def ttm_quarters(quarters: DataFrame) -> DataFrame:
    """Per filer the newest four quarters that follow one another: their sum, last
    end, first end and whether it is the newest quarter; filers without such four
    have a NULL value and the newest end."""
    order = W.partitionBy("cik").orderBy("end")
    gaps = [F.date_diff(F.lag("end", i).over(order), F.lag("end", i + 1).over(order)) for i in range(3)]
    good = F.coalesce(gaps[0].between(*QUARTER_GAP) & gaps[1].between(*QUARTER_GAP) & gaps[2].between(*QUARTER_GAP), F.lit(False))
    four = F.sum(F.col("val").cast("decimal(38,2)")).over(order.rowsBetween(-3, 0))
    rows = quarters.withColumns({"good": good, "four": four, "begin": F.lag("end", 3).over(order)})
    return rows.groupBy("cik").agg(
        F.max_by("four", F.when(F.col("good"), F.col("end"))).cast("double").alias("ttm"),
        F.max(F.when(F.col("good"), F.col("end"))).alias("period_end"),
        F.max_by("begin", F.when(F.col("good"), F.col("end"))).alias("first_end"),
        F.max("end").alias("latest_end"),
    )


def ttm_stub(annual: DataFrame, to_date: DataFrame) -> DataFrame:
    """Full year plus year-to-date less the year-to-date a year before.

    ``annual(cik, end, val)``, ``to_date(cik, start, end, val)``. The newest
    year-to-date after the newest year counts; the earlier one must end 350 to 380
    days before and be as long within 7 days (the closest wins). Without a later
    year-to-date the year stands; without a match the value is NULL.
    """
    year = annual.groupBy("cik").agg(F.max("end").alias("fy_end"), F.max_by("val", "end").alias("fy_val"))
    newest = to_date.join(year, "cik").where("`end` > fy_end").groupBy("cik").agg(
        F.max_by(F.struct("start", "end", "val"), F.struct("end", "start")).alias("now")
    )
    length = lambda c: F.date_diff(F.col(f"{c}.end"), F.col(f"{c}.start"))
    before = to_date.select("cik", F.struct("start", "end", "val").alias("was"))
    paired = (
        newest.join(before, "cik")
        .where(F.date_diff("now.end", "was.end").between(*YEAR_GAP) & (F.abs(length("now") - length("was")) <= TOLERANCE_DAYS))
        .groupBy("cik").agg(F.min_by("was", F.struct(F.abs(length("now") - length("was")), F.date_diff("now.end", "was.end"))).alias("was"))
    )
    out = year.join(newest, "cik", "left").join(paired, "cik", "left")
    value = F.when(F.col("now").isNull(), F.col("fy_val")).otherwise(F.col("fy_val") + F.col("now.val") - F.col("was.val"))
    return out.select("cik", value.alias("ttm"), F.coalesce("now.end", "fy_end").alias("period_end"), F.when(F.col("now").isNull(), "fy").otherwise("stub").alias("basis"))


def ttm(quarters: DataFrame, annual: DataFrame, to_date: DataFrame) -> DataFrame:
    """``cik, ttm, period_end, basis``: the sum of four quarters where there are such,
    else the full year with its stubs; series with neither are left out."""
    four = ttm_quarters(quarters).select("cik", F.col("ttm").alias("four"), F.col("period_end").alias("four_end"))
    both = four.join(ttm_stub(annual.select("cik", "end", "val"), to_date), "cik", "full")
    has = F.col("four").isNotNull()
    return both.select(
        "cik", F.coalesce("four", "ttm").alias("ttm"), F.when(has, F.col("four_end")).otherwise(F.col("period_end")).alias("period_end"),
        F.when(has, "quarters").otherwise(F.col("basis")).alias("basis"),
    ).where("ttm is not null")


def growth(series: DataFrame, gap: tuple[int, int] = YEAR_GAP) -> DataFrame:
    """Each value against the nearest earlier one whose end lies ``gap`` days back;
    values without such a one, or against zero, are left out."""
    a, b = series.alias("a"), series.select("cik", F.col("end").alias("prior_end"), F.col("val").alias("prior_val")).alias("b")
    near = F.date_diff("a.end", "prior_end").between(*gap)
    return (
        a.join(b, "cik").where(near).groupBy("cik", "end").agg(F.first("val").alias("val"), F.max("prior_end").alias("prior_end"), F.max_by("prior_val", "prior_end").alias("prior_val"))
        .where("prior_val <> 0").withColumn("rate", (F.col("val") - F.col("prior_val")) / F.abs("prior_val"))
    )


def deltas(series: DataFrame) -> DataFrame:
    """Change against the period shown before, unless their lengths differ by more
    than 7 days or that value is zero. Needs ``start``."""
    order = W.partitionBy("cik").orderBy("end")
    length = F.date_diff("end", "start")
    prior, prior_length = F.lag("val").over(order), F.lag(length).over(order)
    same = F.abs(length - prior_length) <= TOLERANCE_DAYS
    return series.withColumn("delta", F.when(same & (prior != 0), (F.col("val") - prior) / F.abs(prior)))


def cagr(series: DataFrame, years: int, per_year: int) -> DataFrame:
    """Compound yearly rate over the last ``years * per_year + 1`` values (all if
    there are fewer); NULL where an end is not positive or there is one value."""
    order = W.partitionBy("cik").orderBy(F.desc("end"))
    kept = series.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= years * per_year + 1)
    ends = kept.groupBy("cik").agg(F.max_by("val", "end").alias("last"), F.min_by("val", "end").alias("first"), F.count(F.lit(1)).alias("n"))
    rate = F.pow(F.col("last") / F.col("first"), per_year / (F.col("n") - 1)) - 1
    return ends.withColumn("cagr", F.when((F.col("first") > 0) & (F.col("last") > 0) & (F.col("n") > 1), rate))


def numbered(series: DataFrame) -> DataFrame:
    """With ``i``, counting from 0 in order of end, and ``n`` of the series."""
    w = W.partitionBy("cik")
    return series.where("val is not null").withColumns({"i": F.row_number().over(w.orderBy("end")) - 1, "n": F.count(F.lit(1)).over(w)})


def slopes(series: DataFrame) -> DataFrame:
    """Least-squares slope over the positions, with mean size, ends and number."""
    return numbered(series).groupBy("cik").agg(
        F.regr_slope("val", "i").alias("slope"), F.avg(F.abs("val")).alias("mean_size"), F.count(F.lit(1)).alias("n"),
        F.min_by("val", "end").alias("first"), F.max_by("val", "end").alias("last"),
    )


def change_points(series: DataFrame) -> DataFrame:
    """Where the slope changes most: the split with the largest difference of the
    two slopes, if it is at least 5 % of the mean size."""
    rows = numbered(series).where(F.col("n") >= LEAST_POINTS)
    split = F.explode(F.sequence(F.lit(LEAST_SIDE), F.col("n").cast("int") - LEAST_SIDE)).alias("split")
    parts = rows.select("*", split).groupBy("cik", "split").agg(
        F.regr_slope(F.when(F.col("i") < F.col("split"), F.col("val")), F.col("i")).alias("left_slope"),
        F.regr_slope(F.when(F.col("i") >= F.col("split"), F.col("val")), F.col("i")).alias("right_slope"),
        F.avg(F.abs("val")).alias("mean_size"), F.min(F.when(F.col("i") == F.col("split"), F.col("end"))).alias("split_end"),
    )
    change = F.round(F.abs(F.col("right_slope") - F.col("left_slope")), 4)
    best = parts.withColumn("change", change).groupBy("cik").agg(F.max_by(F.struct("split", "split_end", "left_slope", "right_slope", "change", "mean_size"), F.struct("change", -F.col("split"))).alias("b"))
    return best.select("cik", "b.*").where((F.col("mean_size") > 0) & (F.col("change") / F.col("mean_size") >= LEAST_CHANGE))


def trend_label(slope: Column, mean_size: Column, left: Column, right: Column) -> Column:
    """stable, expanding, contracting, accelerating, decelerating or inflecting."""
    flat = F.abs(slope) < STABLE * mean_size
    changed = (
        F.when((left < 0) != (right < 0), "inflecting")
        .when((right > 0) & (right > left), "accelerating").when((right > 0), "decelerating")
        .when(right < left, "re-decelerating").otherwise("contracting")
    )
    return (
        F.when(slope.isNull(), "unknown").when(left.isNotNull(), changed).when(flat, "stable").when(slope > 0, "expanding").otherwise("contracting")
    )
