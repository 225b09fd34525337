"""The written index, instants however far, aligned ratios and gross margin."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyweir.functions.metrics import BY_NAME, envelope, value
from tallyweir.operators import compare, documents, ownership, series

from .conftest import rows

D = dt.date


def test_written_index(spark, tmp_path):
    texts = [(1, "10-K", D(2020, 1, 1), "A red fox. Red-fox tails."), (2, "8-K", D(2021, 1, 1), "the red fox"), (3, "8-K", None, "fox red"), (4, "8-K", D(2022, 1, 1), None), (5, "8-K", D(2022, 1, 1), "")]
    docs = spark.createDataFrame(texts, "doc_id bigint, form string, filed date, text string")
    path = f"file://{tmp_path}/index"
    documents.write_index(docs, path)
    found = documents.search(documents.read_index(spark, path, "Red fox"), docs, "red fox").collect()
    assert [(r.doc_id, r.hits) for r in found] == [(2, 1), (1, 2)] and found[0].snippet == "the red fox"
    assert rows(documents.search(documents.read_index(spark, path, "red fox"), docs, "red fox", forms=("10-K",), until="2020-12-31"), "doc_id") == [(1,)]
    assert documents.read_index(spark, path, "unseen word").count() == 0
    with pytest.raises(ValueError):
        documents.read_index(spark, path, " - ")


def test_nearest_instants_have_no_limit(spark):
    targets = spark.createDataFrame([("a", D(2020, 1, 1), 1.0), ("a", D(2000, 1, 1), 2.0), ("b", D(2020, 1, 1), 3.0), ("c", D(2020, 1, 1), 4.0)], "cik string, end date, val double")
    instants = spark.createDataFrame([("a", D(2019, 12, 1), 10.0), ("a", D(2020, 1, 5), 11.0), ("a", D(1980, 1, 1), 12.0), ("b", D(2030, 1, 1), 13.0)], "cik string, at date, instant_val double")
    got = rows(compare.nearest_instant(targets, instants, 400), "cik", "val", "instant_val")
    assert got == [("a", 1.0, 11.0), ("a", 2.0, 12.0), ("b", 3.0, 13.0), ("c", 4.0, None)]


def test_instants_near_an_anchor(spark):
    schema = "cik string, alias string, end date, val double, precedence int, filed date, fact_id bigint"
    x = spark.createDataFrame([("a", "assets", D(2020, 12, 20), 1.0, 0, D(2021, 1, 1), 1), ("a", "assets", D(2021, 1, 2), 2.0, 0, D(2021, 1, 1), 2), ("a", "cash", D(2021, 6, 30), 3.0, 0, D(2021, 7, 1), 3)], schema)
    anchors = spark.createDataFrame([("a", D(2020, 12, 31))], "cik string, period_end date")
    assert rows(compare.nearest_instants(x, anchors), "alias", "val", "off") == [("assets", 2.0, 6), ("cash", 3.0, 543)]


def test_gross_margin_without_gross_profit(spark):
    df = spark.createDataFrame([(4.0, 10.0, 5.0), (None, 10.0, 5.0), (None, 10.0, None), (None, 0.0, 1.0)], "gross_profit double, revenue double, cogs double")
    m = BY_NAME["gross_margin"]
    assert [r.x for r in df.select(value(m).alias("x")).collect()] == [0.4, 0.5, None, None]
    got = [r.e for r in df.select(envelope(m).alias("e")).collect()]
    assert [(e.formula, e.missing_inputs) for e in got][:3] == [("gross_profit / revenue", []), ("(revenue - cogs) / revenue", []), ("(revenue - cogs) / revenue", ["cogs"])]


def test_twelve_months_choose_quarters_first(spark):
    q = spark.createDataFrame([("a", D(2020, 3, 31), 1.0), ("a", D(2020, 6, 30), 2.0), ("a", D(2020, 9, 30), 3.0), ("a", D(2020, 12, 31), 4.0), ("b", D(2020, 3, 31), 1.0)], "cik string, end date, val double")
    y = spark.createDataFrame([("a", D(2020, 12, 31), 99.0), ("b", D(2019, 12, 31), 8.0)], "cik string, end date, val double")
    h = spark.createDataFrame([("b", D(2020, 1, 1), D(2020, 6, 30), 5.0), ("b", D(2019, 1, 1), D(2019, 6, 30), 3.0)], "cik string, start date, end date, val double")
    assert rows(series.ttm(q, y, h), "cik", "ttm", "basis") == [("a", 10.0, "quarters"), ("b", 10.0, "stub")]


def test_roll_up_per_filer(spark):
    h = spark.createDataFrame([("x", "s1", 10.0, 1.0, "call"), ("x", "s1", 5.0, 2.0, "share"), ("x", "s2", 1.0, None, None), ("y", "s1", None, 1.0, "put")], "filer string, cusip string, value double, shares double, put_call string")
    got = {r.filer: (r.positions, r.securities, r.value, r.shares, r.call_value, r.put_value, r.share_value) for r in ownership.filer_rollup(h).collect()}
    assert got == {"x": (3, 2, 16.0, 3.0, 10.0, None, 5.0), "y": (1, 1, None, 1.0, None, None, None)}


def test_markup_late_in_a_text(spark):
    text = "x " * 5000 + "<p>one</p><p>two</p>"
    got = spark.createDataFrame([(text,)], "t string").select(documents.document_text(F.col("t")).alias("x")).first().x
    assert got.endswith("one\n\ntwo")
