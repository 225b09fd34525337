"""Queries that once left out part of their rows, on small tables of their own."""

import datetime as dt
from hashlib import md5

import pytest

import __spark_entry__ as entry
from tallyweir.operators import evidence

from .conftest import rows

D = dt.date
FILINGS = (
    "filing_id bigint, cik string, accession string, form string, filed string, report_date date, file_number string, item_list string, "
    "size_bytes bigint, is_xbrl int, is_inline_xbrl int, primary_document string, loaded_at timestamp"
)
FACTS = (
    "fact_id bigint, cik string, entity_name string, taxonomy string, tag string, unit string, start_date date, end_date date, val double, "
    "accession string, fy int, fp string, form string, filed date, frame string"
)


def accession(n):
    return f"{n:010d}-20-{n:06d}"


def filing(n, form, filed):
    return (n, "7", accession(n), form, filed, D(2020, 3, 31), "333-1", None, 1, 1, 0, "a.htm", dt.datetime(2021, 1, 1))


def fact(n, filed=D(2020, 5, 1), of=None):
    return (n, str(n), f"Filer {n}", "us-gaap", "Revenues", "USD", D(2020, 1, 1), D(2020, 3, 31), float(n), accession(of or n), 2020, "Q1", "10-Q", filed, "CY2020Q1")


@pytest.fixture(scope="module")
def filings_dir(spark, tmp_path_factory):
    """One filer: an original, its amendment, and days in every kind of notation."""
    at = str(tmp_path_factory.mktemp("filings"))
    written = [
        filing(1, "10-Q", "2020-04-30"), filing(2, "10-Q", "05/01/2020"), filing(3, "10-Q/A", "20200605"), filing(4, "10-K", "2020/07/01"),
        filing(5, "10-K", "2020-07-03T01:00:00Z"), filing(6, "8-K", "2/3/24"), filing(7, "10-Q/A", None), filing(8, "10-K", "TBD"),
    ]
    spark.createDataFrame(written, FILINGS).write.parquet(f"{at}/filings.parquet")
    return at


def test_filings_keep_every_notation(spark, filings_dir):
    q = entry.queries()
    assert rows(q["filing_urls"](spark, filings_dir), "filing_id") == [(n,) for n in range(1, 9)]
    assert rows(q["form_counts"](spark, filings_dir), "form", "n", "oldest", "newest") == [
        ("10-K", 3, D(2020, 7, 1), D(2020, 7, 2)), ("10-Q", 2, D(2020, 4, 30), D(2020, 5, 1)),
        ("10-Q/A", 2, D(2020, 6, 5), D(2020, 6, 5)), ("8-K", 1, D(2024, 2, 3), D(2024, 2, 3)),
    ]
    assert rows(q["latest_periodic_report"](spark, filings_dir), "report_filed") == [(D(2020, 7, 2),)]
    assert rows(q["subscription_pending"](spark, filings_dir), "filing_id") == [(6,)]
    assert rows(q["registration_history"](spark, filings_dir), "n", "amendments", "last_filed") == [(8, 2, D(2024, 2, 3))]


def test_amendments_find_originals_of_any_notation(spark, filings_dir):
    got = rows(entry.queries()["amendment_pairs"](spark, filings_dir), "accession", "filed", "original_filed")
    digits = lambda n: accession(n).replace("-", "")
    assert got == [(digits(3), D(2020, 6, 5), D(2020, 5, 1)), (digits(7), None, None)]


def test_latest_series_without_a_day(spark, tmp_path):
    """A filer's only series is its latest one; next to a dated one an undated one is not."""
    of = lambda n, cik, filed, series: (n, cik, *filing(n, "S-3", filed)[2:6], series, *filing(n, "S-3", filed)[7:])
    written = [of(1, "1", "TBD", "333-1"), of(2, "2", "1/2/2020", "333-2"), of(3, "2", None, "333-3"), of(4, "3", None, "333-4"), of(5, "3", None, "333-5")]
    spark.createDataFrame(written, FILINGS).write.parquet(f"{tmp_path}/filings.parquet")
    got = rows(entry.queries()["latest_series"](spark, str(tmp_path)), "file_number", "filed")
    assert got == [("333-1", None), ("333-2", D(2020, 1, 2))]


def test_frame_scan_has_every_filer(spark, tmp_path):
    spark.createDataFrame([fact(n) for n in range(1, 251)], FACTS).write.parquet(f"{tmp_path}/facts.parquet")
    got = entry.queries()["frame_scan"](spark, str(tmp_path)).collect()
    assert [r.fact_id for r in got] == list(range(250, 0, -1))


def test_asof_facts_go_by_acceptance(spark, tmp_path):
    """Acceptance counts, in any notation, whenever the filing was loaded; without one the day does."""
    days = {1: D(2020, 6, 29), 2: D(2020, 6, 30), 3: D(2020, 6, 28), 4: D(2020, 6, 29), 5: D(2020, 5, 1)}
    spark.createDataFrame([fact(n, day) for n, day in days.items()], FACTS).write.parquet(f"{tmp_path}/facts.parquet")
    spark.createDataFrame([filing(n, "10-Q", str(day)) for n, day in days.items()], FILINGS).write.parquet(f"{tmp_path}/filings.parquet")
    taken = [(accession(1), "06/30/2020 01:59 PM ET"), (accession(1), "2020-07-09T00:00:00Z"), (accession(2), "2020-06-30T18:00:01Z"), (accession(3), "n/a")]
    spark.createDataFrame(taken, "accessionnumber string, acceptancedatetime string").write.parquet(f"{tmp_path}/submissions.parquet")
    assert rows(entry.queries()["asof_facts"](spark, str(tmp_path)), "fact_id", "accepted_known") == [(1, True), (3, False), (5, False)]


def test_body_rows_cut_long_texts(spark, tmp_path):
    """Texts over 4 MiB stay, without the character that the limit would cut in two."""
    most, texts = 4 << 20, {1: "short", 2: "x" + "é" * (2 << 20), 3: "€" * (2 << 20), 4: "a" * (4 << 20), 5: "𝄞" * (1 << 20) + "z"}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cut = {n: t.encode()[:most].decode(errors="ignore").encode() for n, t in texts.items()}
    want = [(n, len(cut[n]), len(t.encode()) > most, md5(cut[n]).hexdigest()) for n, t in texts.items()]
    assert rows(entry.queries()["body_rows"](spark, str(tmp_path)), "doc_id", "body_length", "truncated", "digest") == want
    assert [r[2] for r in want] == [False, True, True, False, True]


def test_share_statements_are_all_there_once(spark, tmp_path):
    said = [f"Warrants for {i},000 shares are exercisable now." for i in range(1, 13)]
    docs = spark.createDataFrame([(1, " ".join([said[0]] * 9 + said))], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(entry.queries()["share_statements"](spark, str(tmp_path)), "pos", "sentence")
    assert got == [(0, said[0]), *((i + 9, said[i]) for i in range(1, 12))]
    assert rows(evidence.statements(docs), "pos") == [(0,), *((i + 9,) for i in range(1, 8))]


def test_body_rows_sql_cuts_between_characters(spark, tmp_path):
    import duckdb

    texts = [("a" * (4 << 20)), ("a" * ((4 << 20) - 1) + "é"), ("a" * ((4 << 20) - 2) + "€x"), ("a" * ((4 << 20) - 3) + "😀"), "short", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["body_rows"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"select doc_id, body_length, truncated, digest from ({entry.oracle_sql()['body_rows']}) order by doc_id").fetchall()
    assert rows(got, "doc_id", "body_length", "truncated", "digest") == want
    assert [w[2] for w in want] == [False, True, True, True, False]
