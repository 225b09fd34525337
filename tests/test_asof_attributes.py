import datetime as dt
import random

from tallyweir.operators.asof_attributes import carry_forward, facts_with_versions

from .conftest import rows

T0 = dt.datetime(2010, 1, 1)
EVENTS, CHANGES = "entity string, event_id bigint, at timestamp", "entity string, version_id bigint, valid_from timestamp, known_at timestamp"


def brute(events, changes):
    out = []
    for e, i, at in events:
        if e is None or at is None:
            continue
        best = max(((v, k, n) for x, n, v, k in changes if x == e and v is not None and k is not None and n is not None and v <= at and k <= at), default=None)
        out.append((e, i, best[2] if best else None))
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_against_brute_force(spark):
    rng = random.Random(3)
    moment = lambda: T0 + dt.timedelta(days=rng.randrange(0, 900, 7), hours=rng.choice([0, 0, 5]))
    changes = [(rng.choice("abc"), i, rng.choice([moment(), moment(), None]), moment()) for i in range(120)] + [("d", 999, T0, T0), (None, 1, T0, T0)]
    changes += changes[:5]  # repeated rows
    events = [(rng.choice("aaaaabcx"), i, moment()) for i in range(400)] + [("d", 1, T0), ("d", 2, T0 - dt.timedelta(microseconds=1)), (None, 3, T0), ("a", 4, None)]
    events += [("a", 5, dt.datetime(1960, 5, 5)), ("d", 6, dt.datetime(2099, 1, 1))]
    df = carry_forward(spark.createDataFrame(events, EVENTS), spark.createDataFrame(changes, CHANGES), bucket_days=30, salts=3)
    got = sorted(map(tuple, df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))
    assert got == brute(events, changes)


def test_empty_sides(spark):
    events, changes = spark.createDataFrame([("a", 1, T0)], EVENTS), spark.createDataFrame([], CHANGES)
    assert rows(carry_forward(events, changes)) == [("a", 1, None)]
    assert carry_forward(events.limit(0), changes).count() == 0


def test_event_time_of_facts(spark):
    facts = spark.createDataFrame(
        [(1, "CIK0000000007", "000000000120000001", dt.date(2020, 1, 5), "x"), (2, "7", None, dt.date(2020, 1, 1), "x"), (3, "7", "junk", None, "x"), (4, None, None, dt.date(2020, 1, 1), "x")],
        "fact_id bigint, cik string, accession string, filed date, at string",
    )
    subs = spark.createDataFrame(
        [("0000000001-20-000001", "2020-01-03T00:00:00Z"), ("0000000001-20-000001", "2020-01-02 10:00:00 ET"), ("0000000001-20-000001", "junk"), (None, None)], "accessionnumber string, acceptancedatetime string"
    )
    day = lambda d, h=0: dt.datetime(2020, 1, d, h)
    history = spark.createDataFrame([("0000000007", 10, day(1), day(1)), ("7", 11, day(2, 15), day(2, 15)), ("7", 12, day(2, 16), day(4)), (None, 13, day(1), day(1))], "cik string, version_id bigint, valid_from timestamp, known_at timestamp")
    assert rows(facts_with_versions(facts, subs, history)) == [(1, 11), (2, 10)]


def test_far_dates_make_no_buckets(spark):
    """Instants thousands of years apart cost a row each."""
    at = lambda y: dt.datetime(y, 1, 1)
    events = spark.createDataFrame([("a", 1, at(2020)), ("a", 2, at(9998)), ("a", 3, at(1970))], "entity string, event_id bigint, at timestamp")
    changes = spark.createDataFrame([("a", 1, at(1975), at(1975)), ("a", 2, at(9997), at(2000))], "entity string, version_id bigint, valid_from timestamp, known_at timestamp")
    assert sorted((r.event_id, r.version_id) for r in carry_forward(events, changes).collect()) == [(1, 1), (2, 2), (3, None)]
