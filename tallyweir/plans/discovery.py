"""Queries that find filers, concepts, frames and what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.functions.aliases import BUNDLES, alias_key, alias_table, alias_values_sql
from tallyweir.functions.keys import accession_digits, cik_number
from tallyweir.operators import discovery as S
from tallyweir.operators import incremental as I
from tallyweir.operators.facts import alias_winner, audit_trail
from tallyweir.plans.facts import ALIASED_SQL, FACTS_SQL, FILINGS_SQL, WINNER_SQL, _facts, filings
from tallyweir.plans.joins import _FILERS_SQL, filers
from tallyweir.sources.tables import table

QUERIES, SQL = {}, {}
ARCHIVE = "https://archive.example/data"


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _tier_sql(q: str, key: str, label: str) -> str:
    k, n = f"lower({key})", f"lower({label})"
    return f"CASE WHEN {k} = '{q}' THEN 0 WHEN {n} = '{q}' THEN 1 WHEN {k} LIKE '{q}%' THEN 2 WHEN {n} LIKE '{q}%' THEN 3 WHEN contains({n}, '{q}') THEN 4 WHEN contains({k}, '{q}') THEN 5 END"


@_query(f"""WITH {_FILERS_SQL} SELECT cik, ticker, filer_name, {_tier_sql('tor', 'ticker', 'filer_name')}::INT AS tier FROM fl WHERE tier IS NOT NULL
ORDER BY tier, ticker NULLS FIRST, filer_name NULLS FIRST LIMIT 20""")
def search_entities(spark: SparkSession, d: str) -> DataFrame:
    return S.search(filers(spark, d), "tor", "ticker", "filer_name", 20).select("cik", "ticker", "filer_name", "tier")


@_query(f"""WITH {FACTS_SQL}, t AS (SELECT tag, min(taxonomy) AS taxonomy, count(*) AS n FROM f GROUP BY tag)
SELECT tag, taxonomy, n, {_tier_sql('income', 'tag', 'taxonomy')}::INT AS tier FROM t WHERE tier IS NOT NULL ORDER BY tier, tag LIMIT 25""")
def search_tags(spark: SparkSession, d: str) -> DataFrame:
    t = _facts(spark, d).groupBy("tag").agg(F.min("taxonomy").alias("taxonomy"), F.count(F.lit(1)).alias("n"))
    return S.search(t, "income", "tag", "taxonomy", 25).select("tag", "taxonomy", "n", "tier")


@_query()
def suggest_concepts(spark: SparkSession, d: str) -> DataFrame:
    return S.suggestions(table(spark, d, "facts"), "NetIncomLoss")


@_query(f"""WITH {_FILERS_SQL}, w AS (SELECT DISTINCT upper(ticker) AS identifier FROM v WHERE ticker IS NOT NULL),
j AS (SELECT w.identifier, fl.cik FROM w LEFT JOIN fl ON upper(fl.ticker) = w.identifier WHERE NOT regexp_full_match(w.identifier, '(?:CIK)?\\s*[0-9]{{1,10}}'))
SELECT identifier, CASE WHEN count(DISTINCT cik) = 1 THEN min(cik) END AS cik, CASE count(DISTINCT cik) WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status FROM j GROUP BY identifier""")
def resolve_entities(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "filer_history").where("ticker is not null").select(F.upper("ticker").alias("identifier")).distinct()
    return S.resolve(wanted, filers(spark, d))


@_query("""SELECT y::INT AS year, 'CY' || y || k AS frame FROM range(2009, 2027) t(y), (VALUES (''), ('Q1'), ('Q2'), ('Q3'), ('Q4'), ('Q1I'), ('Q2I'), ('Q3I'), ('Q4I')) s(k)""")
def frames_enumerate(spark: SparkSession, d: str) -> DataFrame:
    return S.frames(spark, 2009, 2026)


@_query(f"""WITH {_FILERS_SQL} SELECT cik, ticker, sic FROM fl WHERE sic LIKE '20%'""")
def universe_by_sic(spark: SparkSession, d: str) -> DataFrame:
    """The filers of a group of industries, as an expandable universe."""
    return filers(spark, d).where("sic like '20%'").select("cik", "ticker", "sic")


@_query(f"""WITH {FACTS_SQL}, {ALIASED_SQL}, {WINNER_SQL} SELECT cik, alias, concat_ws(' · ', nullif(tag, ''), nullif(form, ''), nullif(accession, ''), 'filed ' || filed) AS citation FROM w""")
def citations(spark: SparkSession, d: str) -> DataFrame:
    w = alias_winner(_facts(spark, d), alias_table(spark))
    cite = S.citation(F.col("tag"), F.col("form"), F.col("accession"), F.concat(F.lit("filed "), F.col("filed").cast("string")))
    return w.select("cik", "alias", cite.alias("citation"))


@_query(f"""WITH {FILINGS_SQL} SELECT filing_id, '{ARCHIVE}/' || regexp_replace(cik, '^0+([0-9])', '\\1') || '/' || accession AS url FROM g""")
def filing_urls(spark: SparkSession, d: str) -> DataFrame:
    return filings(spark, d).select("filing_id", S.filing_url(F.col("cik"), F.col("accession"), ARCHIVE).alias("url"))


_BUNDLE_ROWS = ", ".join(f"('{b}', '{a}')" for b, names in BUNDLES.items() for a in names)


@_query(f"""WITH b(bundle, alias) AS (VALUES {_BUNDLE_ROWS}), a(alias, precedence, taxonomy, tag, unit) AS (VALUES {alias_values_sql()})
SELECT bundle, b.alias, precedence, tag FROM b LEFT JOIN a ON a.alias = translate(lower(trim(b.alias)), '- ', '__')""")
def bundle_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Bundles expanded to their concepts; an unknown alias keeps a row without one."""
    rows = spark.createDataFrame([(b, a) for b, names in BUNDLES.items() for a in names], "bundle string, wanted string")
    known = alias_table(spark).select("alias", "precedence", "tag")
    return rows.withColumn("alias", alias_key(F.col("wanted"))).join(F.broadcast(known), "alias", "left").select("bundle", F.col("wanted").alias("alias"), "precedence", "tag")  # fixed size


# What is new.


@_query(f"""WITH {FILINGS_SQL}, m AS (SELECT cik, form, max(filed) AS day FROM g WHERE filed < DATE '2022-01-01' GROUP BY cik, form),
s AS (SELECT g.cik, g.form, day, list(DISTINCT accession) AS seen FROM g JOIN m ON g.cik = m.cik AND g.form = m.form AND g.filed = m.day GROUP BY g.cik, g.form, day)
SELECT filing_id FROM g LEFT JOIN s ON s.cik = g.cik AND s.form = g.form WHERE day IS NULL OR filed > day OR (filed = day AND NOT list_contains(seen, accession))""")
def new_since_mark(spark: SparkSession, d: str) -> DataFrame:
    f = filings(spark, d)
    none = spark.createDataFrame([], "cik string, form string, day date, seen array<string>")
    return I.new_since(f, I.advanced(none, f.where("filed < '2022-01-01'"))).select("filing_id")


@_query("""WITH k AS (SELECT regexp_replace(accession, '[^0-9]', '', 'g') AS acc, regexp_replace(regexp_extract(cik, '([0-9]+)', 1), '^0+([0-9])', '\\1') AS cik, delivery_id FROM feed)
SELECT acc, cik, min(delivery_id) AS delivery_id FROM k WHERE acc <> '' AND cik <> '' GROUP BY acc, cik""")
def feed_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The batch form: one delivery per identifier, by an aggregation."""
    k = table(spark, d, "feed").select(accession_digits("accession").alias("acc"), cik_number("cik").alias("cik"), "delivery_id")
    return k.where("acc is not null and cik is not null").groupBy("acc", "cik").agg(F.min("delivery_id").alias("delivery_id"))


@_query(f"""WITH {FILINGS_SQL}, s AS (SELECT DISTINCT cik FROM g WHERE form = '10-K') SELECT filing_id, cik, form, filed FROM g SEMI JOIN s USING (cik) WHERE filed >= DATE '2024-01-01'""")
def subscription_pending(spark: SparkSession, d: str) -> DataFrame:
    """Filings of the subscribed filers since a day."""
    f = filings(spark, d)
    subscribed = f.where("form = '10-K'").select("cik").distinct()
    return f.where("filed >= '2024-01-01'").join(subscribed, "cik", "left_semi").select("filing_id", "cik", "form", "filed")


@_query(f"""WITH {FACTS_SQL}, {FILINGS_SQL}, n AS (SELECT cik, count(*) AS new_filings FROM g WHERE filed >= DATE '2024-01-01' GROUP BY cik),
a AS (SELECT cik, count(*) AS restated FROM (SELECT cik, max(filed) AS last_filed FROM f GROUP BY cik, tag, unit, start, "end" HAVING count(DISTINCT val) > 1) WHERE last_filed >= DATE '2024-01-01' GROUP BY cik)
SELECT cik, coalesce(new_filings, 0) AS new_filings, coalesce(restated, 0) AS restated FROM n FULL JOIN a USING (cik)""")
def delta_report(spark: SparkSession, d: str) -> DataFrame:
    """New filings and restated periods of each filer since a day."""
    new = filings(spark, d).where("filed >= '2024-01-01'").groupBy("cik").agg(F.count(F.lit(1)).alias("new_filings"))
    restated = audit_trail(_facts(spark, d)).where("last_filed >= '2024-01-01'").groupBy("cik").agg(F.count(F.lit(1)).alias("restated"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return new.join(restated, "cik", "full").select("cik", zero("new_filings"), zero("restated"))


@_query(f"""WITH {FACTS_SQL}, o AS (SELECT * FROM f WHERE filed < DATE '2020-01-01'), n AS (SELECT * FROM f WHERE filed >= DATE '2018-01-01'),
x AS (SELECT n.cik, n.tag, n.unit, n.accession, n."end", min(n.fact_id) AS fact_id FROM n ANTI JOIN o ON n.cik = o.cik AND n.tag = o.tag AND n.unit = o.unit AND n.accession = o.accession AND n."end" = o."end"
  WHERE n.accession IS NOT NULL GROUP BY ALL) SELECT * FROM x""")
def mirror_insert_absent(spark: SparkSession, d: str) -> DataFrame:
    """Facts a mirror of the years before lacks: insert if absent."""
    keys = ["cik", "tag", "unit", "accession", "end"]
    f = _facts(spark, d).where("accession is not null").select(*keys, "fact_id", "filed")
    return I.absent(f.where("filed >= '2018-01-01'").drop("filed"), f.where("filed < '2020-01-01'"), keys)


@_query("""SELECT cik, ticker, filer_name, version_id FROM filer_history QUALIFY row_number() OVER (PARTITION BY cik ORDER BY known_at DESC NULLS LAST, version_id DESC) = 1""")
def mirror_upsert_filers(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "filer_history").select("cik", "ticker", "filer_name", "version_id", "known_at")
    return I.upserted(v.where("version_id % 2 = 0"), v.where("version_id % 2 = 1"), ["cik"], ["known_at", "version_id"]).select("cik", "ticker", "filer_name", "version_id")


@_query("""SELECT 'facts' AS name, count(*) AS n, max(loaded_at)::VARCHAR IS NOT NULL AS synced FROM facts UNION ALL SELECT 'filings', count(*), max(loaded_at)::VARCHAR IS NOT NULL FROM filings
UNION ALL SELECT 'documents', count(*), max(filed) IS NOT NULL FROM documents""")
def mirror_stats(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name, col: table(spark, d, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.max(col).isNotNull().alias("synced"))
    return one("facts", "loaded_at").unionByName(one("filings", "loaded_at")).unionByName(one("documents", "filed"))
