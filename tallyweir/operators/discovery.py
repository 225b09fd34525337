"""Finding filers, concepts and frames; resolving identifiers."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.functions.keys import cik_number


def tiers(query: str, key: Column, label: Column) -> Column:
    """How well a row answers a query, 0 the best; NULL where it doesn't."""
    q = query.strip().lower()
    k, n = F.lower(key), F.lower(label)
    return (
        F.when(k == q, 0).when(n == q, 1).when(k.startswith(q), 2).when(n.startswith(q), 3).when(F.contains(n, F.lit(q)), 4).when(F.contains(k, F.lit(q)), 5)
    )


def search(rows: DataFrame, query: str, key: str, label: str, limit: int) -> DataFrame:
    """The ``limit`` best rows for a query, by tier, then key."""
    return rows.withColumn("tier", tiers(query, F.col(key), F.col(label))).where("tier is not null").orderBy("tier", key, label).limit(limit)


def identifiers(lines: DataFrame, text: str) -> DataFrame:
    """``identifier, pos`` of lines of identifiers parted by commas; ``#`` begins a
    comment; of equal ones the first stays. ``line`` numbers the lines."""
    parts = F.posexplode(F.split(F.regexp_replace(F.col(text), r"#.*$", ""), ","))
    rows = lines.select("line", parts.alias("k", "identifier")).withColumn("identifier", F.upper(F.trim("identifier"))).where("identifier <> ''")
    return rows.groupBy("identifier").agg(F.min(F.struct("line", "k")).alias("first")).select("identifier", "first.line", "first.k")


def resolve(wanted: DataFrame, filers: DataFrame) -> DataFrame:
    """``identifier, cik, status``: by ticker, or by number; ``ambiguous`` where
    several filers answer, ``missing`` where none does."""
    number = F.when(F.col("identifier").rlike(r"^(?:CIK)?\s*\d{1,10}$"), F.lpad(cik_number("identifier"), 10, "0"))
    ids = wanted.withColumn("number", number)
    by_ticker = ids.where("number is null").join(filers.select(F.upper("ticker").alias("identifier"), "cik"), "identifier", "left")
    known = filers.select("cik").distinct()
    by_number = ids.where("number is not null").join(known, F.col("number") == F.col("cik"), "left")
    found = by_ticker.select("identifier", "cik").unionByName(by_number.select("identifier", "cik"))
    out = found.groupBy("identifier").agg(F.count_distinct("cik").alias("n"), F.min("cik").alias("cik"))
    status = F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "found").otherwise("ambiguous")
    return out.select("identifier", F.when(F.col("n") == 1, F.col("cik")).alias("cik"), status.alias("status"))


def frames(spark: SparkSession, since: int, until: int) -> DataFrame:
    """All calendar frames: years, quarters and quarter-end instants."""
    years = spark.range(since, until + 1).select(F.col("id").cast("int").alias("year"))
    kinds = F.explode(F.expr("array('', 'Q1', 'Q2', 'Q3', 'Q4', 'Q1I', 'Q2I', 'Q3I', 'Q4I')")).alias("kind")
    return years.select("year", kinds).select("year", F.concat(F.lit("CY"), F.col("year").cast("string"), F.col("kind")).alias("frame"))


def suggestions(concepts: DataFrame, wanted: str, least: float = 0.6) -> DataFrame:
    """``tag, score`` of the distinct concepts that hold the wanted name or resemble
    it by the matching-blocks ratio."""
    goal = wanted.lower()

    @F.pandas_udf("double")
    def ratio(tags: pd.Series) -> pd.Series:
        match = difflib.SequenceMatcher()
        match.set_seq2(goal)
        out = []
        for tag in tags:
            match.set_seq1(tag)
            out.append(1.0 if goal in tag else match.ratio())
        return pd.Series(out, dtype="float64")

    return concepts.select(F.lower("tag").alias("tag")).where("tag is not null").distinct().select("tag", ratio("tag").alias("score")).where(F.col("score") >= least)


def filing_url(cik: Column, accession: Column, root: str) -> Column:
    """The folder of a filing: filer number without zeros, accession without dashes."""
    return F.concat_ws("/", F.lit(root.rstrip("/")), cik_number(cik), F.regexp_replace(accession, "-", ""))


def citation(*parts: Column) -> Column:
    """The parts that are not empty, joined by a middle dot."""
    return F.concat_ws(" · ", *[F.when(p != "", p) for p in parts])
