"""Attributes as known at event time: one sorted pass over events and changes.

Events and attribute changes are united, sorted by entity and availability, and
the best version so far is carried forward. An entity that holds a third of all
rows is cut into time buckets (and events of one bucket into salts), each of
which starts from the version carried in from the buckets before. Only buckets
that hold something are there, one row each from a pre-aggregation, so no task
holds an entity's whole past and no far-off date makes buckets of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweir.functions.instants import parse_instant
from tallyweir.functions.keys import accession_18, cik_number
from tallyweir.session import written

BUCKET_DAYS = 60
SALTS = 4
_DAY_US = 86_400_000_000


def carry_forward(events: DataFrame, changes: DataFrame, bucket_days: int = BUCKET_DAYS, salts: int = SALTS) -> DataFrame:
    """``entity, event_id, version_id`` of each event with the version that held
    and was known at its time.

    ``events(entity, event_id bigint, at timestamp)``;
    ``changes(entity, version_id bigint, valid_from timestamp, known_at timestamp)``.
    A version is available from the later of its two instants. Of the available
    ones the latest ``valid_from`` wins, then the latest ``known_at``, then the
    largest ``version_id``. At equal instants changes come before events.

    Defined results: events or changes with a null entity or instant are no
    input; changes without version_id likewise; events before the first
    available version come out with NULL; repeated rows give repeated rows; an
    empty side gives no rows, or only NULL versions.
    """
    bucket_us = bucket_days * _DAY_US
    bucket = F.expr(f"(at - pmod(at, {bucket_us}L)) div {bucket_us}L")
    rank = F.struct(F.unix_micros("valid_from").alias("v"), F.unix_micros("known_at").alias("k"), F.col("version_id").alias("id"))
    known = (
        changes.where("entity is not null and valid_from is not null and known_at is not null and version_id is not null")
        .select("entity", F.greatest(F.unix_micros("valid_from"), F.unix_micros("known_at")).alias("at"), rank.alias("best"))
        .withColumn("bucket", bucket)
    )
    seen = events.where("entity is not null and at is not null").select("entity", F.unix_micros("at").alias("at"), "event_id").withColumn("bucket", bucket)
    # One row per entity and bucket that holds an event or a change; each takes the best of all before it.
    none = F.lit(None)
    best = known.schema["best"].dataType
    held = known.select("entity", "bucket", "best").unionByName(seen.select("entity", "bucket", none.cast(best).alias("best")).distinct())
    first = held.groupBy("entity", "bucket").agg(F.max("best").alias("best"))
    before = F.max("best").over(W.partitionBy("entity").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    carried = first.withColumn("best", before).where("best is not null")
    marks = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    moved = known.select("entity", "bucket", "at", F.lit(0).alias("turn"), none.cast("bigint").alias("event_id"), "best", marks).unionByName(
        carried.select("entity", "bucket", (F.col("bucket") * bucket_us).alias("at"), F.lit(-1).alias("turn"), none.cast("bigint").alias("event_id"), "best", marks)
    )
    salted = seen.select(
        "entity", "bucket", "at", F.lit(1).alias("turn"), "event_id", none.cast(best).alias("best"), F.pmod(F.xxhash64("event_id", "at"), F.lit(salts)).cast("int").alias("salt")
    )
    forward = W.partitionBy("entity", "bucket", "salt").orderBy("at", "turn").rowsBetween(W.unboundedPreceding, 0)
    return (
        moved.unionByName(salted)
        .withColumn("best", F.max("best").over(forward))
        .where("turn = 1")
        .select("entity", "event_id", F.col("best.id").alias("version_id"))
    )


def acceptances(submissions: DataFrame) -> DataFrame:
    """``acc, accepted``: the earliest instant of the submissions with the same 18
    accession digits, where one is readable."""
    return (
        submissions.select(accession_18("accessionnumber").alias("acc"), parse_instant(F.col("acceptancedatetime").cast("string")).alias("at"))
        .where("acc is not null and at is not null")
        .groupBy("acc").agg(F.min("at").alias("accepted"))
    )


def fact_events(facts: DataFrame, submissions: DataFrame) -> DataFrame:
    """``entity, event_id, at`` of each fact: when its filing was accepted.

    The earliest instant of the submissions with the same 18 accession digits;
    failing that, midnight UTC of ``filed``. Facts with neither are no event.
    Facts without an accession get a key of their own, so that they do not meet
    in one task.
    """
    acc = F.coalesce(accession_18("accession"), F.concat(F.lit("~"), F.col("fact_id").cast("string")), F.lit("~"))
    return (
        facts.select(acc.alias("acc"), cik_number("cik").alias("entity"), F.col("fact_id").cast("bigint").alias("event_id"), F.col("filed").cast("date").alias("filed"))
        .join(acceptances(submissions), "acc", "left")
        .select("entity", "event_id", F.coalesce("accepted", F.expr("timestamp_seconds(unix_date(filed) * 86400L)")).alias("at"))
    )


def facts_with_versions(facts: DataFrame, submissions: DataFrame, history: DataFrame) -> DataFrame:
    """``fact_id, version_id`` of each fact whose filer had a version that held
    and was known when the filing was accepted; other facts are left out."""
    changes = history.select(
        cik_number("cik").alias("entity"), F.col("version_id").cast("bigint").alias("version_id"), F.col("valid_from").cast("timestamp").alias("valid_from"), F.col("known_at").cast("timestamp").alias("known_at")
    )
    events = written(fact_events(facts, submissions), "fact-events")  # read twice: for the buckets and for the pass
    return (
        carry_forward(events, changes)
        .where("version_id is not null and event_id is not null")
        .select(F.col("event_id").alias("fact_id"), "version_id")
    )
