"""Joins across filers, periods and filings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweir.operators.asof_attributes import carry_forward


def diff_filers(series: DataFrame, a: str, b: str) -> DataFrame:
    """Two filers side by side by ``period``: values, difference and ratio (NULL
    where the second is missing or zero)."""
    side = lambda cik, name: series.where(F.col("cik") == cik).groupBy("period").agg(F.max_by("val", "end").alias(name))
    both = side(a, "val_a").join(side(b, "val_b"), "period", "full_outer")
    ratio = F.try_divide(F.col("val_a"), F.when(F.col("val_b") != 0, F.col("val_b")))
    return both.select("period", "val_a", "val_b", (F.col("val_a") - F.col("val_b")).alias("delta"), ratio.alias("ratio"))


def shared_frames(facts: DataFrame, ciks: list[str], periods: int) -> DataFrame:
    """Values of the newest ``periods`` frames that all given filers have, kept to
    the kind of period (annual, quarterly, instant) of the newest one."""
    rows = facts.where(F.col("cik").isin(*ciks) & F.col("frame").isNotNull())
    kind = F.when(F.col("frame").endswith("I"), "instant").when(F.col("frame").contains("Q"), "quarterly").otherwise("annual")
    frames = (
        rows.groupBy("frame").agg(F.count_distinct("cik").alias("n"), F.max("end").alias("frame_end")).where(F.col("n") == len(ciks))
        .withColumn("kind", kind)
        .withColumn("newest_kind", F.first("kind").over(W.orderBy(F.desc("frame_end"), F.desc("frame"))))  # one row per calendar period
        .where("kind = newest_kind")
        .withColumn("pos", F.row_number().over(W.orderBy(F.desc("frame_end"), F.desc("frame")))).where(F.col("pos") <= periods)
    )
    best = rows.groupBy("cik", "frame").agg(F.max_by("val", F.struct("filed", "fact_id")).alias("val"))
    return best.join(F.broadcast(frames.select("frame", "pos")), "frame")  # at most `periods` rows


def nearest_instant(targets: DataFrame, instants: DataFrame, bucket_days: int) -> DataFrame:
    """Each target with the instant closest to its end; one after the end counts
    three times its distance.

    Both sides are cut into buckets of ``bucket_days``, so that a filer of very many
    periods is spread. Targets with no instant in the buckets around them, of which
    there are few, are looked for in a sorted pass over their filer's instants: the
    last one before and the first one after are the only candidates.

    ``targets(cik, end, val)``, ``instants(cik, at, instant_val)``.
    """
    bucket = lambda c: F.floor(F.unix_date(c) / bucket_days)
    near = instants.withColumn("bucket", F.explode(F.array(*[bucket(F.col("at")) + i for i in range(-3, 2)])))
    days = F.date_diff("end", "at")
    score = F.when(days >= 0, days).otherwise(-3 * days)
    # Within three buckets before and one after, nothing farther off can score less than a bucket's length.
    pairs = targets.withColumn("bucket", bucket(F.col("end"))).join(near, ["cik", "bucket"]).where(score <= bucket_days)
    best = pairs.groupBy("cik", "end").agg(F.min_by(F.struct("at", "instant_val"), F.struct(score, "at")).alias("b"), F.min(score).alias("score"))
    lone = targets.join(best, ["cik", "end"], "left_anti").select("cik", "end")
    none = F.lit(None)
    mark = F.struct(F.col("at"), F.col("instant_val"))
    kinds = instants.schema["instant_val"].dataType
    line = lone.select("cik", F.col("end").alias("day"), "end", none.cast("date").alias("at"), none.cast(kinds).alias("instant_val")).unionByName(
        instants.join(lone.select("cik").distinct(), "cik", "left_semi").select("cik", F.col("at").alias("day"), none.cast("date").alias("end"), "at", "instant_val")
    )
    order = W.partitionBy("cik").orderBy("day")
    at = F.when(F.col("at").isNotNull(), mark)
    sides = line.withColumns({"was": F.last(at, True).over(order), "will": F.first(at, True).over(order.rangeBetween(W.currentRow, W.unboundedFollowing))}).where("`end` is not null and at is null")
    either = sides.select("cik", "end", F.explode(F.array_compact(F.array("was", "will"))).alias("b")).withColumns({"at": F.col("b.at")})
    far = either.groupBy("cik", "end").agg(F.min_by("b", F.struct(score, "at")).alias("b"), F.min(score).alias("score"))
    found = best.unionByName(far)
    return targets.join(found, ["cik", "end"], "left").select("cik", "end", "val", F.col("b.at").alias("at"), F.col("b.instant_val").alias("instant_val"), "score")


def amendment_pairs(filings: DataFrame) -> DataFrame:
    """Each amendment ``X/A`` with the last ``X`` of the filer filed before it; one
    without a day has no original.

    Originals are changes that are available from the day after they were filed,
    amendments are events: the last known one is carried forward in one sorted pass,
    split by time and salt like any other as-of join.
    """
    base = F.concat_ws("\u0001", F.col("cik"), F.regexp_replace("form", r"/A$", ""))
    amends = F.col("form").endswith("/A")
    day = lambda n: F.expr(f"timestamp_seconds((unix_date(filed) + {n}) * 86400L)")
    events = filings.where(amends).select(base.alias("entity"), F.col("filing_id").alias("event_id"), day(0).alias("at"))
    changes = filings.where(~amends).select(base.alias("entity"), F.col("filing_id").alias("version_id"), day(1).alias("valid_from"), day(1).alias("known_at"))
    paired = carry_forward(events, changes, bucket_days=365).select(F.col("event_id").alias("filing_id"), "version_id")
    originals = filings.select(F.col("filing_id").alias("version_id"), F.col("accession").alias("original_accession"), F.col("filed").alias("original_filed"))
    out = filings.where(amends).join(paired, "filing_id", "left").join(originals, "version_id", "left")
    return out.select("cik", "form", "accession", "filed", "original_accession", "original_filed")


def peers(filers: DataFrame, limit: int) -> DataFrame:
    """Filers with the same industry code, by name, at most ``limit`` each.

    Only the head of each industry is ranked (tasks cut their rows to it before the
    shuffle); every filer takes the first names beside itself from that head, so no
    industry is paired with itself.
    """
    order = W.partitionBy("sic").orderBy("filer_name", "cik")
    head = filers.where("sic is not null").withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit + 1)
    named = head.select("sic", F.col("cik").alias("peer_cik"), F.col("filer_name").alias("peer_name"), F.col("pos").alias("peer_pos"))
    own = filers.where("sic is not null").select("cik", "sic").join(head.select("cik", F.col("pos").alias("own_pos")), "cik", "left")
    place = F.col("peer_pos") - F.coalesce((F.col("peer_pos") > F.col("own_pos")).cast("int"), F.lit(0))
    return own.join(named, "sic").where("cik <> peer_cik").select("cik", "peer_cik", "peer_name", place.alias("place")).where(F.col("place") <= limit)


def listings(rows: DataFrame, tickers: DataFrame) -> DataFrame:
    """Rows with all tickers of their filer, and the ticker where there is one."""
    every = tickers.groupBy("cik").agg(F.array_sort(F.collect_set("ticker")).alias("tickers"))
    single = F.when(F.size("tickers") == 1, F.get("tickers", F.lit(0)))
    return rows.join(every, "cik", "left").withColumns({"ticker": single, "tickers": F.array_join("tickers", ",")})


def nearest_instants(instants: DataFrame, anchors: DataFrame) -> DataFrame:
    """``cik, alias, val, off``: of each filer and alias the instant nearest to the
    filer's ``period_end``; days behind it count threefold. Ties: first precedence,
    latest filed, largest ``fact_id``. Kept however far off it is."""
    days = F.date_diff("end", "period_end")
    off = F.abs(days) * F.when(days > 0, 3).otherwise(1)
    joined = instants.join(anchors.select("cik", "period_end"), "cik").withColumn("off", off)
    best = F.min_by(F.struct("val", "off"), F.struct("off", "precedence", -F.unix_date("filed"), -F.col("fact_id"))).alias("b")
    return joined.groupBy("cik", "alias").agg(best).select("cik", "alias", "b.*")


def pivot_aliases(winners: DataFrame, names: list[str]) -> DataFrame:
    """One row per filer with a column per alias."""
    return winners.groupBy("cik").agg(*[F.max(F.when(F.col("alias") == n, F.col("val"))).alias(n) for n in names])


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
