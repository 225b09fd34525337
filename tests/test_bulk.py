import datetime as dt
import json

from pyspark.sql import functions as F

from tallyweir.operators import fiscal
from tallyweir.sources import bulk

from .conftest import rows

D = dt.date


def put(folder, name, value):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value))


def test_companies(spark, tmp_path):
    put(tmp_path, "c.json", {"fields": ["cik", "name", "ticker", "exchange"], "data": [[7, "Seven", "svn", "X"], [320193, "Pear", "PEAR", None]]})
    assert rows(bulk.companies(spark, f"{tmp_path}/c.json")) == [("0000000007", "Seven", "SVN", "X"), ("0000320193", "Pear", "PEAR", None)]


def test_filings_are_transposed_and_united(spark, tmp_path):
    recent = {"accessionNumber": ["a", "b"], "filingDate": ["2020-01-02", "2020-02-30"], "reportDate": ["", "2019-12-31"], "acceptanceDateTime": ["2020-01-02T16:00:00.000Z"], "form": ["8-K", "10-K"], "size": [5, 6], "isXBRL": [1]}
    put(tmp_path / "s", "CIK0000000007.json", {"cik": "7", "name": "N", "tickers": ["T"], "sic": "1", "fiscalYearEnd": "1231", "filings": {"recent": recent, "files": [{"name": "x"}]}, "more": {"unknown": 1}})
    put(tmp_path / "h", "CIK0000000007-submissions-001.json", {"accessionNumber": ["b", "c"], "filingDate": ["2018-01-01", "2018-01-01"], "form": ["OLD", "4"]})
    f = bulk.filings(spark, f"{tmp_path}/s/*.json", f"{tmp_path}/h/*.json")
    got = rows(f, "cik", "accession_number", "filing_date", "report_date", "form", "size", "is_xbrl")
    assert got == [("0000000007", "a", D(2020, 1, 2), None, "8-K", 5, 1), ("0000000007", "b", None, D(2019, 12, 31), "10-K", 6, None), ("0000000007", "c", D(2018, 1, 1), None, "4", None, None)]
    assert rows(f.where("acceptance_ts is not null"), "accession_number") == [("a",)]
    assert rows(bulk.filers(spark, f"{tmp_path}/s/*.json"), "cik", "ticker", "fiscal_year_end") == [("0000000007", "T", "1231")]


def test_company_facts_files(spark, tmp_path):
    put(tmp_path, "f.json", {"cik": 7, "entityName": "N", "facts": {"us-gaap": {"Assets": {"label": "A", "units": {"USD": [{"end": "2020-12-31", "val": 5}]}}}}})
    put(tmp_path, "bad.json", "{broken")
    t = bulk.company_facts(spark, f"{tmp_path}/*.json")
    assert rows(t["facts"], "taxonomy", "tag", "unit", "end", "val") == [("us-gaap", "Assets", "USD", "2020-12-31", "5")]
    assert t["filers"].where("cik = '7'").count() == 1


def test_feed_pages(spark):
    entry = lambda body: f"<entry>{body}</entry>"
    good = entry("<title>8-K - N (0000000007)</title><id>urn:0000000001-20-000001</id><updated>2020-01-02T10:00:00-05:00</updated><link href='https://x/data/7/1.htm'/><category term='8-K'/>")
    bad = entry("<title>no ids</title><updated>2020-01-02T10:00:00Z</updated>") + entry("<id>0000000001-20-000002</id><title>(7)</title><updated>2020-01-02T10:00:00</updated>")
    page = f"<feed xmlns='http://www.w3.org/2005/Atom'>{good}{bad}</feed>"
    got = rows(bulk.feed_pages(spark.createDataFrame([(page,), ("<oops",), (None,)], "value string")), "accession", "cik", "form", "error")
    assert ("0000000001-20-000001", "0000000007", "8-K", None) in got
    assert sorted(r[3].split(":")[0] for r in got if r[3]) == ["no accession", "no offset", "page", "page"]


def test_flat_sinks(spark):
    df = spark.createDataFrame([(1, ["a"], ""), (2, None, "x")], "k int, v array<string>, t string")
    assert rows(bulk.csv_ready(df)) == [(1, '["a"]', ""), (2, None, "x")]
    assert rows(df.select(bulk.compact_json(df))) == [('{"k":1,"v":["a"]}',), ('{"k":2,"t":"x"}',)]


def test_year_ends(spark):
    df = spark.createDataFrame([("1", "0229"), ("2", "0931"), ("3", "1231"), ("4", "1340"), ("5", None), ("6", "")], "cik string, fiscal_year_end string")
    assert rows(fiscal.year_ends(df, 2020, 2020)) == [("1", 2020, D(2019, 3, 1), D(2020, 2, 28)), ("2", 2020, D(2019, 10, 1), D(2020, 9, 30)), ("3", 2020, D(2020, 1, 1), D(2020, 12, 31))]


def test_baseline_shares(spark):
    schema = "cik string, accession string, filed date, as_of date, before_offering boolean, issued boolean, after_offering boolean, shares double"
    df = spark.createDataFrame(
        [("1", "a", D(2020, 1, 1), D(2019, 12, 31), True, None, None, 10.0), ("1", "a", D(2020, 1, 1), D(2019, 12, 30), None, True, None, 11.0), ("1", "b", D(2020, 2, 1), None, None, None, True, 99.0), ("1", "c", D(2020, 3, 1), D(2020, 2, 1), None, None, None, 12.0)],
        schema,
    )
    assert rows(fiscal.baseline_shares(df), "cik", "accession", "shares") == [("1", "c", 12.0)]


def test_ties(spark):
    got = spark.createDataFrame([(100.0, 104.0), (100.0, 106.0), (None, 1.0)], "a double, b double").select(fiscal.tied(F.col("a"), F.col("b"), 0.05).alias("x")).collect()
    assert [r.x for r in got] == [True, False, None]
