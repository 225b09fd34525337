import pytest
from pyspark.sql import functions as F

from tallyweir.functions.instants import instant_text, parse_day, parse_instant
from tallyweir.operators.instant_dictionary import InstantDictionary, normalised_cells

INSTANTS = {
    "2024-01-04T14:53:51.000-0500": "2024-01-04T19:53:51.000000Z",
    "20131128211922": "2013-11-28T21:19:22.000000Z",
    "Fri, 11 Oct 2024 13:24:25 +0000": "2024-10-11T13:24:25.000000Z",
    "1359146221": "2013-01-25T20:37:01.000000Z",
    "1360319141138": "2013-02-08T10:25:41.138000Z",
    "01/02/2023 06:02 PM ET": "2023-01-02T23:02:00.000000Z",
    "Apr 10, 2015 8:47:36 PM EDT": "2015-04-11T00:47:36.000000Z",
    "Sept. 9, 2015 12:05 AM EST": "2015-09-09T05:05:00.000000Z",
    "01-Aug-2014 21:26:11 UTC": "2014-08-01T21:26:11.000000Z",
    "2013-01-25 16:50:35 America/New_York": "2013-01-25T21:50:35.000000Z",
    "2013-02-19T20:29:31[America/New_York]": "2013-02-20T01:29:31.000000Z",
    "2013/03/15 14:35:25 US/Eastern": "2013-03-15T18:35:25.000000Z",
    "1/13/2017 1:29:24 PM -05:00": "2017-01-13T18:29:24.000000Z",
    " 2013-05-31T23:52:59.000Z\n": "2013-05-31T23:52:59.000000Z",
    "2024-10-22t10:03:06z": "2024-10-22T10:03:06.000000Z",
    "2013-01-17T21:45Z": "2013-01-17T21:45:00.000000Z",
    "2013-01-17T21:45:01.1234567Z": "2013-01-17T21:45:01.123456Z",
    "20130117T214501Z": "2013-01-17T21:45:01.000000Z",
    # a time that occurs twice is the first; one that is skipped takes the offset before
    "2024-11-03 01:30:00 America/New_York": "2024-11-03T05:30:00.000000Z",
    "2024-03-10 02:30:00 America/New_York": "2024-03-10T07:30:00.000000Z",
    "2024-07-01 10:00:00 EST": "2024-07-01T15:00:00.000000Z",
    "2024-01-01T00:00:00+05:30": "2023-12-31T18:30:00.000000Z",
    "2013-01-28": None, "": None, "   ": None, "n/a": None, "pending": None, "-": None, "0000-00-00T00:00:00Z": None,
    "2026-13-04T21:04:37Z": None, "2026-02-30T01:00:00Z": None, "2026-02-20T24:00:00Z": None, "2026-02-20T23:60:00Z": None,
    "2026-02-20 13:00:00 PM ET": None, "2026-02-20 10:00:00 Mars/Base": None, "x" * 5000: None, "2026-01-01 10:00:00 +19:00": None,
}
DAYS = {
    "2024-01-04": "2024-01-04", "07/17/2020": "2020-07-17", "1/2/21": "2021-01-02", "2013-3-11": "2013-03-11", "20130110": "2013-01-10",
    "2013/01/25": "2013-01-25", "May 10, 2017": "2017-05-10", "Jun. 10, 2019": "2019-06-10", "01-MAY-2023": "2023-05-01", "10 March 2014": "2014-03-10",
    "2013-02-25T00:00:00": "2013-02-25", "2013-01-25 00:00:00.000": "2013-01-25", "2013-03-10T02:33:45Z": "2013-03-09", "2013-02-08T22:15:37+09:00": "2013-02-08",
    "01/04/2019 08:22 PM ET": "2019-01-04", "\t2013-02-25 ": "2013-02-25", "13/45/2026": None, "0000-00-00": None, "TBD": None, "": None, "2023-02-29": None,
}


def test_instants(spark):
    df = spark.createDataFrame([(k,) for k in INSTANTS] + [(None,)], "raw string")
    got = {r.raw: r.t for r in df.select("raw", instant_text(parse_instant(F.col("raw"))).alias("t")).collect()}
    assert got == INSTANTS | {None: None}


def test_days(spark):
    df = spark.createDataFrame([(k,) for k in DAYS] + [(None,)], "raw string")
    got = {r.raw: r.t for r in df.select("raw", parse_day(F.col("raw")).cast("string").alias("t")).collect()}
    assert got == DAYS | {None: None}


def test_dictionary_parses_a_text_once(spark, tmp_path):
    d = InstantDictionary(spark, f"file://{tmp_path}/dict", day_sources=("b",))
    schema = "source string, zone string, raw string"
    d.extend(spark.createDataFrame([("a", "UTC", "2024-01-04T00:00:00Z"), ("a", "UTC", "2024-01-04T00:00:00Z "), ("a", "UTC", None), ("b", "X", "2024-01-04")], schema))
    assert d.read().count() == 2
    d.extend(spark.createDataFrame([("a", "UTC", "2024-01-04T00:00:00Z"), ("a", "UTC", "junk")], schema))
    assert d.read().count() == 3
    rows = spark.createDataFrame([(1, "2024-01-04T00:00:00Z"), (2, "junk"), (3, None), (4, " 2024-01-04T00:00:00Z")], "id int, raw string")
    got = {r.id: r.instant is not None for r in d.attach(rows, "raw", "a", "UTC").collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}


def test_cells_with_empty_repeated_and_clashing_columns(spark):
    subs = spark.createDataFrame(
        [(1, "2024-01-04T00:00:00Z", None, "x"), (1, "2024-01-04T00:00:00Z", "", "x"), (None, None, "01/02/21", None)],
        "sub_id bigint, acceptancedatetime string, filingdate string, source string",
    )
    filings = spark.createDataFrame([], "filing_id bigint, filed string, raw string, zone string")
    got = sorted(map(tuple, normalised_cells(subs, filings).collect()), key=str)
    one = ("submissions", 1, "acceptancedatetime", "2024-01-04T00:00:00.000000Z")
    assert got == sorted([one, one, ("submissions", None, "filingdate", "2021-01-02")], key=str)
    assert normalised_cells(subs.limit(0), filings).count() == 0


def test_other_session_zone_is_refused(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(ValueError):
            InstantDictionary(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_dictionary_honours_the_zone(spark):
    text, day = "2024-07-01T12:00:00", "2024-07-02T03:00:00Z"
    cells = [("s", "Europe/London", text), ("s", "America/New_York", text), ("s", None, text), ("s", "Nowhere/At_All", text), (None, "UTC", text), ("d", "America/New_York", day), ("d", "Asia/Tokyo", day), ("d", None, day)]
    df = spark.createDataFrame(cells, "source string, zone string, raw string")
    kept = InstantDictionary(spark, day_sources=("d",)).extend(df).extend(df)
    got = {(r.source, r.zone): str(r.instant or r.day or "") for r in kept.attach(df, "raw", F.col("source"), F.col("zone")).collect()}
    assert got == {
        ("s", "Europe/London"): "2024-07-01 11:00:00", ("s", "America/New_York"): "2024-07-01 16:00:00", ("s", None): "2024-07-01 12:00:00", ("s", "Nowhere/At_All"): "",
        (None, "UTC"): "2024-07-01 12:00:00", ("d", "America/New_York"): "2024-07-01", ("d", "Asia/Tokyo"): "2024-07-02", ("d", None): "2024-07-01",
    }
    assert kept.read().count() == len(cells)


def test_no_text_is_too_long(spark):
    df = spark.createDataFrame([("July 1,   2024" + " " * 200 + "12:00 UTC",), ("2024-07-01T12:00:00." + "1" * 40 + "Z",), ("x" * 100_000,)], "t string")
    got = [r.x for r in df.select(instant_text(parse_instant(F.col("t"))).alias("x")).collect()]
    assert got == ["2024-07-01T12:00:00.000000Z", "2024-07-01T12:00:00.111111Z", None]
