"""Tagged facts: cleaning, selection, restatements, point in time.

All operators take facts of all filers at once; the filer is part of every key.
Selections are maxima of structs or ranked windows on the filer's own keys, and
every order ends in ``fact_id`` so that ties are decided the same way each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweir.functions.keys import accession_18, cik_number, tag_key, unit_key
from tallyweir.functions.periods import STALE_DAYS, TOLERANCE_DAYS, calendar_period, fiscal_label, is_cumulative, period_length, period_type

CONCEPT = ("cik", "tag", "unit")
PERIOD = ("cik", "tag", "unit", "start", "end")


def canonical(facts: DataFrame) -> DataFrame:
    """Facts with keys in one notation. Rows without filer, tag, unit, period end,
    filing day or finite value are left out."""
    val = F.col("val").cast("double")
    return (
        facts.select(
            F.col("fact_id").cast("bigint").alias("fact_id"), F.lpad(cik_number("cik"), 10, "0").alias("cik"), "entity_name",
            F.lower(F.trim("taxonomy")).alias("taxonomy"), tag_key("tag").alias("tag"), unit_key("unit").alias("unit"),
            F.col("start_date").alias("start"), F.col("end_date").alias("end"), F.when(~F.isnan(val), val).alias("val"), "filed",
            accession_18("accession").alias("accession"), "fy", "fp", "form", "frame",
        )
        .where("cik is not null and tag is not null and unit is not null and `end` is not null and val is not null and filed is not null")
    )


def enriched(facts: DataFrame) -> DataFrame:
    """With length, class and labels of the period."""
    start, end = F.col("start"), F.col("end")
    return facts.withColumns(
        {
            "period_length_days": period_length(start, end), "period_type": period_type(start, end),
            "calendar_period": calendar_period(start, end, F.col("frame")), "fiscal_period": fiscal_label(F.col("fy"), F.col("fp")),
            "is_cumulative": is_cumulative(F.col("fp"), start, end),
        }
    )


def _first(df: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def freshest(facts: DataFrame, keys: tuple[str, ...] = CONCEPT) -> DataFrame:
    """One fact per key: not dated after its filing if any is not; then latest end,
    framed before unframed, longest, latest filed."""
    return _first(
        facts, keys, (F.col("end") > F.col("filed")).cast("int"), F.desc("end"), F.desc(F.col("frame").isNotNull()),
        F.desc(period_length(F.col("start"), F.col("end"))), F.desc("filed"), F.desc("fact_id"),
    )


def one_per_period(facts: DataFrame) -> DataFrame:
    """The latest filed value of each concept and period."""
    return _first(facts, PERIOD, F.desc("filed"), F.desc("fact_id"))


def with_alias(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Facts of aliased concepts; an alias without unit takes any."""
    a = F.broadcast(aliases.withColumnRenamed("unit", "alias_unit"))  # fixed size
    return facts.join(a, ["taxonomy", "tag"]).where((F.col("alias_unit") == "") | (F.col("alias_unit") == F.col("unit"))).drop("alias_unit")


def alias_winner(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per filer and alias the freshest fact of the concept with the latest end,
    then latest filing, then first precedence."""
    best = freshest(with_alias(facts, aliases), ("cik", "alias", "precedence", "unit"))
    return _first(best, ("cik", "alias"), F.desc("end"), F.desc("filed"), F.col("precedence"), F.col("unit"))


def canonical_union(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """All concepts of an alias in one series: per period, accession and unit the
    first concept in precedence."""
    return _first(with_alias(facts, aliases), ("cik", "alias", "start", "end", "accession", "unit"), F.col("precedence"), F.desc("fact_id"))


def _period_key(df: DataFrame) -> DataFrame:
    """With ``_start``, which is never null, so that periods can be joined by equality."""
    return df.withColumn("_start", F.coalesce("start", F.lit("0001-01-01").cast("date")))


_KEY = ("cik", "tag", "unit", "_start", "end")


def lineage(facts: DataFrame) -> DataFrame:
    """Each fact with what became of its value: the latest known value of the period,
    and the accession that superseded it.

    The latest is aggregated and joined back, so a period that holds very many facts
    is split like any skewed join key.
    """
    rows = _period_key(facts)
    last = rows.groupBy(*_KEY).agg(F.max_by(F.struct("val", "accession"), F.struct("filed", "fact_id")).alias("_last"))
    changed = F.col("val") != F.col("_last.val")
    return rows.join(last, list(_KEY)).withColumns(
        {"latest_known_value": F.col("_last.val"), "is_restated": changed, "superseded_by": F.when(changed, F.col("_last.accession"))}
    ).drop("_last", "_start")


def prior_values(facts: DataFrame) -> DataFrame:
    """The distinct values of a period before its latest, one row each, with the
    filing that first had it."""
    rows = _period_key(facts)
    first = F.min_by(F.struct("filed", "fact_id", "accession"), F.struct("filed", "fact_id")).alias("first")
    per_value = rows.groupBy(*_KEY, "val").agg(first)
    last = rows.groupBy(*_KEY).agg(F.max_by("val", F.struct("filed", "fact_id")).alias("latest_val"))
    start = F.when(F.col("_start") != F.lit("0001-01-01").cast("date"), F.col("_start")).alias("start")
    return per_value.join(last, list(_KEY)).where("val <> latest_val").select("cik", "tag", "unit", start, "end", "latest_val", "val", "first.filed", "first.fact_id", "first.accession")


def audit_trail(facts: DataFrame) -> DataFrame:
    """Periods for which two or more values were filed."""
    return (
        facts.groupBy(*PERIOD)
        .agg(F.count_distinct("val").alias("n_values"), F.count(F.lit(1)).alias("n_filings"), F.min("filed").alias("first_filed"), F.max("filed").alias("last_filed"))
        .where("n_values > 1")
    )


def fiscal_grid(facts: DataFrame) -> DataFrame:
    """Per filer and annual period the earliest filed full-year label."""
    annual = facts.where((F.col("fp") == "FY") & (period_type(F.col("start"), F.col("end")) == "annual") & F.col("fy").isNotNull())
    return _first(annual, ("cik", "start", "end"), F.col("filed"), F.col("fact_id")).select("cik", "start", "end", "fy", "filed")


def concept_summary(facts: DataFrame) -> DataFrame:
    """Per filer and concept: units, number of facts, latest filing."""
    return facts.groupBy("cik", "taxonomy", "tag").agg(
        F.array_join(F.array_sort(F.collect_set("unit")), ",").alias("units"), F.count(F.lit(1)).alias("fact_count"), F.max("filed").alias("latest_filed")
    )


def available(filed: Column, acceptance: Column, cutoff: Column, intraday: bool) -> Column:
    """Whether a row was public at the cutoff: by acceptance if it is known; else
    by day, with two days' margin for a cutoff within a day."""
    day = F.to_date(cutoff)
    by_day = filed < F.date_sub(day, 1) if intraday else filed <= day
    return F.coalesce(F.when(acceptance.isNotNull(), acceptance <= cutoff).otherwise(by_day), F.lit(False))


def as_of(facts: DataFrame, acceptances: DataFrame, cutoff: str, intraday: bool = False) -> DataFrame:
    """Facts that were public at the cutoff (UTC).

    ``acceptances(accession, acceptance_ts)`` has one row per accession.
    """
    joined = facts.join(acceptances, "accession", "left")
    return joined.where(available(F.col("filed"), F.col("acceptance_ts"), F.lit(cutoff).cast("timestamp"), intraday))


def staleness(winners: DataFrame, reports: DataFrame, reference: Column) -> DataFrame:
    """``stale_reason`` of each winner: superseded where the latest periodic report
    covers a later period, old where its end is long past."""
    joined = winners.join(reports, "cik", "left")
    later = F.date_diff("report_end", "end") > TOLERANCE_DAYS
    return joined.withColumn("stale_reason", F.when(later, "superseded").when(F.date_diff(reference, F.col("end")) > STALE_DAYS, "old"))


def comparable(facts: DataFrame, periods: int) -> DataFrame:
    """Per concept: framed facts if there are any, newest first, one per
    (start, end, frame), at most ``periods``."""
    framed = facts.groupBy(*CONCEPT).agg(F.max(F.col("frame").isNotNull()).alias("_framed"))
    kept = facts.join(framed, list(CONCEPT)).where("not _framed or frame is not null").drop("_framed")
    single = _first(kept, (*PERIOD, "frame"), F.desc("filed"), F.desc("fact_id"))
    order = W.partitionBy(*CONCEPT).orderBy(F.desc("end"), F.desc("filed"), F.desc("fact_id"))
    return single.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= periods)


def newest(facts: DataFrame, limit: int) -> DataFrame:
    """The newest facts of each filer, at most ``limit``, with ``truncated`` where the
    filer has more. Spark cuts each task's rows to the limit before the shuffle."""
    order = W.partitionBy("cik").orderBy(F.desc("filed"), F.desc("fact_id"))
    total = facts.groupBy("cik").agg((F.count(F.lit(1)) > limit).alias("truncated"))
    return facts.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit).join(total, "cik")
