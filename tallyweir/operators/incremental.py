"""Incremental processing: what is new since a mark, and tables that only grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def new_since(filings: DataFrame, marks: DataFrame) -> DataFrame:
    """Filings after the mark of their filer and form. A mark is a day and the
    accessions seen on it, so late filings of the same day are not lost.

    ``marks(cik, form, day, seen array<string>)``; without a mark all are new.
    """
    joined = filings.join(marks, ["cik", "form"], "left")
    fresh = F.col("day").isNull() | (F.col("filed") > F.col("day")) | ((F.col("filed") == F.col("day")) & ~F.array_contains("seen", F.col("accession")))
    return joined.where(fresh).drop("day", "seen")


def advanced(marks: DataFrame, filings: DataFrame) -> DataFrame:
    """The marks after the filings: never earlier, ids of an equal day united."""
    last = filings.groupBy("cik", "form").agg(F.max("filed").alias("day"))
    ids = filings.join(last, ["cik", "form"]).where("filed = day").groupBy("cik", "form", "day").agg(F.collect_set("accession").alias("seen"))
    both = marks.unionByName(ids)
    top = both.groupBy("cik", "form").agg(F.max("day").alias("top"))
    kept = both.join(top, ["cik", "form"]).where("day = top")
    return kept.groupBy("cik", "form", "day").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("seen"))


def absent(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the table lacks, one per key (the least of repeated rows)."""
    fresh = rows.join(table.select(*keys), keys, "left_anti")
    rest = [c for c in rows.columns if c not in keys]
    return fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")


def upserted(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Table and rows with the latest row of each key."""
    both = table.unionByName(rows, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def append_absent(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Append rows the Parquet table at ``path`` lacks; returns the rows it then
    holds. Running it again appends nothing."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    fresh = absent(rows, spark.read.parquet(path) if exists else rows.limit(0), keys).select(*rows.columns)
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path).count()


#: Bodies are cut at so many bytes of UTF-8.
BODY_BYTES = 4 << 20


def bodies(documents: DataFrame, text: str = "text", most: int = BODY_BYTES) -> DataFrame:
    """With ``body`` of at most ``most`` bytes, ``body_length`` and ``truncated``;
    a character is never cut in two."""
    size, whole = F.octet_length(text), F.col(text)
    body = F.when(size <= most, whole).otherwise(_byte_cut(whole, most))
    return documents.withColumns({"body": body, "body_length": F.octet_length(body), "truncated": size > most})


def _byte_cut(text: Column, most: int) -> Column:
    raw = F.encode(text, "UTF-8")
    byte = lambda n: F.conv(F.hex(F.substring(raw, most + 1 - n, 1)), 16, 10).cast("int")
    # The byte after the cut must begin a character; at most three steps back it does.
    keep = F.lit(most - 3)
    for back in (2, 1, 0):
        keep = F.when(~byte(back).between(128, 191), F.lit(most - back)).otherwise(keep)
    return F.decode(F.substr(raw, F.lit(1), keep), "UTF-8")
