"""Queries that join filers, periods, filings and holdings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.functions.aliases import FORM_CLASSES
from tallyweir.functions.keys import cik_number
from tallyweir.operators import compare as C
from tallyweir.operators import ownership as H
from tallyweir.plans.facts import FACTS_SQL, FILINGS_SQL, _facts, filings
from tallyweir.plans.series import Q_SQL, quarterly
from tallyweir.sources.tables import table

QUERIES, SQL = {}, {}
_MAJOR = ", ".join(f"'{x}'" for x in FORM_CLASSES["major"])


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


@_query(f"""WITH {Q_SQL}, a AS (SELECT year("end") || 'Q' || quarter("end") AS period, val FROM q WHERE cik = 3), b AS (SELECT year("end") || 'Q' || quarter("end") AS period, val FROM q WHERE cik = 7)
SELECT period, a.val AS val_a, b.val AS val_b, a.val - b.val AS delta, a.val / nullif(b.val, 0) AS ratio FROM a FULL JOIN b USING (period)""")
def diff_two_filers(spark: SparkSession, d: str) -> DataFrame:
    q = quarterly(spark, d)
    period = F.concat(F.year("end").cast("string"), F.lit("Q"), F.quarter("end").cast("string"))
    return C.diff_filers(q.withColumns({"period": period, "cik": F.col("cik").cast("string")}), "3", "7")


@_query(f"""WITH {Q_SQL}, r AS (SELECT cik, 'CY' || year("end") || 'Q' || quarter("end") AS frame, "end", val FROM q WHERE cik IN (1, 4, 9)),
k AS (SELECT frame, max("end") AS frame_end FROM r GROUP BY frame HAVING count(DISTINCT cik) = 3 ORDER BY frame_end DESC, frame DESC LIMIT 8),
n AS (SELECT frame, row_number() OVER (ORDER BY frame_end DESC, frame DESC)::INT AS pos FROM k) SELECT frame, r.cik::VARCHAR AS cik, val, pos FROM r JOIN n USING (frame)""")
def compare_frames(spark: SparkSession, d: str) -> DataFrame:
    q = quarterly(spark, d)
    frame = F.concat(F.lit("CY"), F.year("end").cast("string"), F.lit("Q"), F.quarter("end").cast("string"))
    facts = q.select(F.col("cik").cast("string").alias("cik"), frame.alias("frame"), "end", "val", F.col("end").alias("filed"), F.lit(0).alias("fact_id"))
    return C.shared_frames(facts, ["1", "4", "9"], 8)


@_query(f"""WITH {FACTS_SQL}, t AS (SELECT cik, "end", arg_max(val, (filed, fact_id)) AS val FROM f WHERE tag = 'netincomeloss' AND unit = 'usd' AND start IS NOT NULL GROUP BY cik, "end"),
i AS (SELECT cik, "end" AS day, arg_max(val, (filed, fact_id)) AS instant_val FROM f WHERE tag = 'assets' AND unit = 'usd' GROUP BY cik, "end"),
p AS (SELECT t.cik, t."end", t.val, i.day, i.instant_val, CASE WHEN date_diff('day', day, t."end") >= 0 THEN date_diff('day', day, t."end") ELSE -3 * date_diff('day', day, t."end") END AS score
  FROM t LEFT JOIN i ON t.cik = i.cik)
SELECT cik, "end", val, day AS "at", instant_val, score::INT AS score FROM p QUALIFY row_number() OVER (PARTITION BY cik, "end" ORDER BY score, day) = 1""")
def nearest_instant(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark, d).where("unit = 'usd'")
    last = F.max_by("val", F.struct("filed", "fact_id"))
    targets = f.where("tag = 'netincomeloss' and start is not null").groupBy("cik", "end").agg(last.alias("val"))
    instants = f.where("tag = 'assets'").groupBy("cik", F.col("end").alias("at")).agg(last.alias("instant_val"))
    return C.nearest_instant(targets, instants, 400)


@_query(f"""WITH {FILINGS_SQL}, h AS (SELECT *, regexp_replace(form, '/A$', '') AS base FROM g), a AS (SELECT * FROM h WHERE form LIKE '%/A'), o AS (SELECT * FROM h WHERE form NOT LIKE '%/A'),
p AS (SELECT a.cik, a.form, a.accession, a.filed, a.filing_id, o.accession AS original_accession, o.filed AS original_filed FROM a LEFT JOIN o ON o.cik = a.cik AND o.base = a.base AND o.filed < a.filed
  QUALIFY row_number() OVER (PARTITION BY a.filing_id ORDER BY o.filed DESC NULLS LAST, o.filing_id DESC) = 1)
SELECT cik, form, accession, filed, original_accession, original_filed FROM p""")
def amendment_pairs(spark: SparkSession, d: str) -> DataFrame:
    return C.amendment_pairs(filings(spark, d))


_FILERS_SQL = """
v AS (SELECT lpad(regexp_replace(regexp_extract(cik, '([0-9]+)', 1), '^0+([0-9])', '\\1'), 10, '0') AS cik, ticker, filer_name, sic, version_id, valid_from, known_at FROM filer_history),
l AS (SELECT cik, arg_max({'t': ticker, 'n': filer_name, 's': sic}, (valid_from, known_at, version_id)) AS r FROM v WHERE valid_from IS NOT NULL AND known_at IS NOT NULL GROUP BY cik),
fl AS (SELECT cik, r.t AS ticker, r.n AS filer_name, r.s AS sic FROM l)
"""


def filers(spark: SparkSession, d: str) -> DataFrame:
    """The last version of each filer."""
    v = table(spark, d, "filer_history").where("valid_from is not null and known_at is not null")
    last = F.max_by(F.struct("ticker", "filer_name", "sic"), F.struct("valid_from", "known_at", "version_id"))
    return v.groupBy(F.lpad(cik_number("cik"), 10, "0").alias("cik")).agg(last.alias("r")).select("cik", "r.*")


@_query(f"""WITH {_FILERS_SQL}, p AS (SELECT a.cik, b.cik AS peer_cik, b.filer_name AS peer_name, row_number() OVER (PARTITION BY a.cik ORDER BY b.filer_name NULLS FIRST, b.cik)::INT AS place
FROM fl a JOIN fl b ON a.sic = b.sic AND a.cik <> b.cik) SELECT * FROM p WHERE place <= 10""")
def peers(spark: SparkSession, d: str) -> DataFrame:
    return C.peers(filers(spark, d), 10)


@_query(f"""WITH {FILINGS_SQL}, {_FILERS_SQL}, t AS (SELECT cik, list_sort(list(DISTINCT ticker)) AS ts FROM v WHERE ticker IS NOT NULL GROUP BY cik)
SELECT filing_id, array_to_string(ts, ',') AS tickers, CASE WHEN len(ts) = 1 THEN ts[1] END AS ticker FROM g LEFT JOIN t USING (cik)""")
def listings_enrich(spark: SparkSession, d: str) -> DataFrame:
    tickers = table(spark, d, "filer_history").where("ticker is not null").select(F.lpad(cik_number("cik"), 10, "0").alias("cik"), "ticker")
    return C.listings(filings(spark, d).select("cik", "filing_id"), tickers).select("filing_id", "tickers", "ticker")


@_query(f"""WITH {FILINGS_SQL}, b AS (SELECT replace(trim(accession), '-', '') AS accession FROM documents WHERE accession IS NOT NULL AND text IS NOT NULL AND text <> '')
SELECT filing_id, cik, accession, filed FROM g ANTI JOIN b USING (accession) WHERE primary_document IS NOT NULL AND primary_document <> ''""")
def filings_without_bodies(spark: SparkSession, d: str) -> DataFrame:
    bodies = table(spark, d, "documents").where("accession is not null and text is not null and text <> ''").select(F.regexp_replace(F.trim("accession"), "-", "").alias("accession"))
    wanted = filings(spark, d).where("primary_document is not null and primary_document <> ''")
    return wanted.join(bodies, "accession", "left_anti").select("filing_id", "cik", "accession", "filed")


@_query(f"WITH {FILINGS_SQL} SELECT cik, form, count(*) AS n, min(filed) AS oldest, max(filed) AS newest FROM g GROUP BY cik, form")
def form_counts(spark: SparkSession, d: str) -> DataFrame:
    return filings(spark, d).groupBy("cik", "form").agg(F.count(F.lit(1)).alias("n"), F.min("filed").alias("oldest"), F.max("filed").alias("newest"))


@_query(f"WITH {FILINGS_SQL} SELECT filing_id, cik, form, filed FROM g WHERE form IN ({_MAJOR}) AND filed BETWEEN DATE '2018-01-01' AND DATE '2022-12-31'")
def form_class_filter(spark: SparkSession, d: str) -> DataFrame:
    f = filings(spark, d)
    return f.where(F.col("form").isin(*FORM_CLASSES["major"]) & F.col("filed").between("2018-01-01", "2022-12-31")).select("filing_id", "cik", "form", "filed")


@_query(f"""WITH {FILINGS_SQL} SELECT filing_id, cik, form, filed, accession FROM g WHERE date_diff('day', filed, (SELECT max(filed) FROM g h WHERE h.cik = g.cik)) <= 365""")
def last_year_filings(spark: SparkSession, d: str) -> DataFrame:
    """Filings of the year before each filer's latest one."""
    f = filings(spark, d)
    last = f.groupBy("cik").agg(F.max("filed").alias("latest"))
    return f.join(last, "cik").where(F.date_diff("latest", "filed") <= 365).select("filing_id", "cik", "form", "filed", "accession")


def _holdings(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "call").when(F.col("l_returnflag") == "R", "put").otherwise("share")
    return li.select(F.col("l_suppkey").alias("filer"), F.col("l_partkey").alias("cusip"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("shares"), kind.alias("put_call"), F.col("l_orderkey").alias("accession"))


_H_SQL = "h AS (SELECT l_suppkey AS filer, l_partkey AS cusip, l_extendedprice AS value, l_quantity AS shares, CASE l_returnflag WHEN 'A' THEN 'call' WHEN 'R' THEN 'put' ELSE 'share' END AS put_call, l_orderkey AS accession FROM lineitem)"


@_query(f"""WITH {_H_SQL}, p AS (SELECT filer, cusip, sum(value::DECIMAL(38,2)) AS value FROM h GROUP BY filer, cusip), r AS (SELECT *, row_number() OVER (PARTITION BY filer ORDER BY value DESC, cusip) AS pos FROM p)
SELECT filer, sum(value)::DOUBLE AS total, count(*) AS positions, sum(value) FILTER (WHERE pos <= 10)::DOUBLE AS top_value, round(sum(value) FILTER (WHERE pos <= 10)::DOUBLE / sum(value)::DOUBLE, 9) AS concentration
FROM r GROUP BY filer""")
def filer_concentration(spark: SparkSession, d: str) -> DataFrame:
    return H.concentration(_holdings(spark, d), 10).withColumn("concentration", F.round("concentration", 9))


@_query(f"""WITH {_H_SQL}, t AS (SELECT accession, sum(value::DECIMAL(38,2)) < 10000000000 AS k FROM h GROUP BY accession)
SELECT filer, cusip, accession, put_call, shares, CASE WHEN k THEN value * 1000 ELSE value END AS value FROM h JOIN t USING (accession)""")
def holdings_in_dollars(spark: SparkSession, d: str) -> DataFrame:
    return H.in_dollars(_holdings(spark, d)).select("filer", "cusip", "accession", "put_call", "shares", "value")


@_query(f"""WITH {_H_SQL} SELECT cusip, count(DISTINCT filer) AS filers, sum(shares::DECIMAL(38,2))::DOUBLE AS shares, sum(value::DECIMAL(38,2)) FILTER (WHERE put_call = 'call')::DOUBLE AS call_value,
sum(value::DECIMAL(38,2)) FILTER (WHERE put_call = 'put')::DOUBLE AS put_value, sum(value::DECIMAL(38,2)) FILTER (WHERE put_call = 'share')::DOUBLE AS share_value FROM h GROUP BY cusip""")
def holders_rollup(spark: SparkSession, d: str) -> DataFrame:
    return H.holders(_holdings(spark, d))


@_query(f"""WITH {_H_SQL} SELECT filer, count(*) AS positions, count(DISTINCT cusip) AS securities, sum(shares::DECIMAL(38,2))::DOUBLE AS shares, sum(value::DECIMAL(38,2))::DOUBLE AS value,
sum(value::DECIMAL(38,2)) FILTER (WHERE put_call = 'call')::DOUBLE AS call_value, sum(value::DECIMAL(38,2)) FILTER (WHERE put_call = 'put')::DOUBLE AS put_value,
sum(value::DECIMAL(38,2)) FILTER (WHERE put_call = 'share')::DOUBLE AS share_value FROM h GROUP BY filer""")
def filer_rollup(spark: SparkSession, d: str) -> DataFrame:
    return H.filer_rollup(_holdings(spark, d))


@_query(f"""WITH {_H_SQL}, n AS (SELECT DISTINCT p_partkey AS cusip FROM part WHERE contains(lower(p_name), regexp_replace('red widget, inc.', ',?\\s+(inc|corp|co|ltd|llc|plc)\\.?$', '')))
SELECT filer, count(*) AS positions, sum(value::DECIMAL(38,2))::DOUBLE AS value FROM h SEMI JOIN n USING (cusip) GROUP BY filer""")
def holders_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Holders of the securities whose issuer name has the needle, without its suffix."""
    needle = F.regexp_replace(F.lit("red widget, inc."), r",?\s+(inc|corp|co|ltd|llc|plc)\.?$", "")
    named = table(spark, d, "part").where(F.contains(F.lower("p_name"), needle)).select(F.col("p_partkey").alias("cusip"))
    return _holdings(spark, d).join(named, "cusip", "left_semi").groupBy("filer").agg(F.count(F.lit(1)).alias("positions"), F.sum(F.col("value").cast("decimal(38,2)")).cast("double").alias("value"))


def _insiders(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    side = F.when(F.col("event_type").isin("purchase", "signup"), "A").when(F.col("event_type") == "error", "D")
    return e.select(F.col("user_id").alias("owner"), F.col("event_type").alias("code"), F.col("value"), side.alias("direction"), F.col("ts").alias("at"), "event_id")


_I_SQL = "i AS (SELECT user_id AS owner, event_type AS code, value, CASE WHEN event_type IN ('purchase', 'signup') THEN 'A' WHEN event_type = 'error' THEN 'D' END AS direction, ts AS seen_at, event_id FROM events)"


@_query(f"""WITH {_I_SQL}, s AS (SELECT owner, code, count(*) AS n, coalesce(sum(coalesce(value, 0)::DECIMAL(38,4)) FILTER (WHERE direction = 'A'), 0)::DOUBLE AS acquired,
  coalesce(sum(coalesce(value, 0)::DECIMAL(38,4)) FILTER (WHERE direction = 'D'), 0)::DOUBLE AS disposed, grouping(owner, code) AS level FROM i GROUP BY ROLLUP (owner, code))
SELECT owner, code, n, acquired, disposed, acquired - disposed AS net, level::BIGINT AS level FROM s WHERE level < 3""")
def insider_rollup(spark: SparkSession, d: str) -> DataFrame:
    return H.insider_rollup(_insiders(spark, d))


@_query(f"WITH {_I_SQL} SELECT owner, code, event_id, value FROM i QUALIFY row_number() OVER (PARTITION BY owner, code ORDER BY seen_at DESC, event_id DESC) = 1")
def latest_owner(spark: SparkSession, d: str) -> DataFrame:
    rows = _insiders(spark, d).select("owner", "code", "event_id", "value", "at")
    return H.latest_per(rows, ("owner", "code"), "at", "event_id").select("owner", "code", "event_id", "value")


@_query(f"WITH {_I_SQL}, y AS (SELECT owner, code, direction, seen_at::DATE AS day FROM i) SELECT DISTINCT owner, code, direction, day FROM y QUALIFY rank() OVER (PARTITION BY owner ORDER BY day DESC) = 1")
def latest_holdings_ties(spark: SparkSession, d: str) -> DataFrame:
    rows = _insiders(spark, d).select("owner", "code", "direction", F.to_date("at").alias("day"))
    return H.latest_with_ties(rows, ("owner",), "day").select("owner", "code", "direction", "day")


@_query("""WITH o AS (SELECT user_id, event_type, ts FROM events WHERE event_type = 'view'), c AS (SELECT user_id, max(ts) AS closed FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT user_id, count(*) AS offers, sum(CASE WHEN closed >= ts THEN 1 ELSE 0 END)::BIGINT AS closed FROM o LEFT JOIN c USING (user_id) GROUP BY user_id""")
def pending_vs_closed(spark: SparkSession, d: str) -> DataFrame:
    """Offers for which later evidence exists: existence is a comparison with the
    latest evidence, so offers and evidence are never paired."""
    e = table(spark, d, "events")
    closings = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("closed_at"))
    offers = e.where("event_type = 'view'").join(closings, "user_id", "left")
    return offers.groupBy("user_id").agg(F.count(F.lit(1)).alias("offers"), F.sum(F.when(F.col("closed_at") >= F.col("ts"), 1).otherwise(0)).cast("bigint").alias("closed"))
