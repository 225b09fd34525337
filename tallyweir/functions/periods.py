"""Period classes and labels of tagged facts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths in days that make a period annual, quarterly or year-to-date.
ANNUAL, QUARTERLY, YEAR_TO_DATE = (300, 380), (70, 110), (111, 299)
#: Days by which two periods may differ and still be the same.
TOLERANCE_DAYS = 7
STALE_DAYS = 548


def period_length(start: Column, end: Column) -> Column:
    """Days from start to end; 0 for an instant."""
    return F.coalesce(F.date_diff(end, start), F.lit(0))


def period_type(start: Column, end: Column) -> Column:
    days = F.date_diff(end, start)
    return (
        F.when(start.isNull(), "instant")
        .when(days.between(*ANNUAL), "annual")
        .when(days.between(*QUARTERLY), "quarterly")
        .when(days.between(*YEAR_TO_DATE), "ytd")
        .otherwise("other")
    )


def calendar_period(start: Column, end: Column, frame: Column) -> Column:
    """The frame where one is given; else CYyyyy, CYyyyyQn or CYyyyyQnI by the end."""
    year = F.concat(F.lit("CY"), F.year(end).cast("string"))
    quarter = F.concat(year, F.lit("Q"), F.quarter(end).cast("string"))
    kind = period_type(start, end)
    own = F.when(kind == "instant", F.concat(quarter, F.lit("I"))).when(kind == "annual", year).when(kind == "quarterly", quarter)
    return F.coalesce(frame, own)


def fiscal_label(fy: Column, fp: Column) -> Column:
    """FYyyyy for a full year, yyyy-Qn otherwise; NULL without year or period."""
    return F.when(fp == "FY", F.concat(F.lit("FY"), fy.cast("string"))).otherwise(F.concat(fy.cast("string"), F.lit("-"), fp))


def is_cumulative(fp: Column, start: Column, end: Column) -> Column:
    """A second- or third-quarter value that runs from the start of the year."""
    return F.coalesce(fp.isin("Q2", "Q3") & (F.date_diff(end, start) > QUARTERLY[1]), F.lit(False))


def quarter_end(year: Column, quarter: Column) -> Column:
    return F.last_day(F.make_date(year, quarter * 3, F.lit(1)))


def strict_date(text: Column) -> Column:
    """yyyy-MM-dd as a date; NULL for anything else, impossible days included."""
    return F.try_to_date(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text), "yyyy-MM-dd")


def long_date(text: Column) -> Column:
    """'July 1, 2026' as a date; NULL for anything else."""
    return F.try_to_date(F.when(text.rlike(r"^[A-Z][a-z]+ \d{1,2}, \d{4}$"), text), "MMMM d, yyyy")


def reported_date(text: Column) -> Column:
    """m/d/yyyy or yyyy-MM-dd in ISO form; other text as it is."""
    slashed = F.try_to_date(F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), text), "M/d/yyyy")
    return F.coalesce(slashed.cast("string"), strict_date(text).cast("string"), text)


def aligned(start: Column, end: Column, anchor: Column) -> Column:
    """Whether a flow ends within a week of the anchor, or an instant on it."""
    off = F.abs(F.date_diff(end, anchor))
    return F.when(start.isNull(), off == 0).otherwise(off <= TOLERANCE_DAYS)
