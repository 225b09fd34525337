"""Mixed timestamp notations: a persistent dictionary of distinct texts.

Each distinct (source, zone, text) is parsed once in the life of the
dictionary; a later run parses only what the table lacks, and rows get their
instant by a join. The dictionary is written below the shared folder, so the
join reads a table whose size Spark knows: small ones are broadcast, large ones
shuffled, and a text that holds a third of all rows is split by AQE's skew join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.functions.instants import day_of, instant_of, instant_text, trimmed, zone_id
from tallyweir.session import fresh_path, require_utc

_SCHEMA = "source string, zone string, raw string, instant timestamp, day date"


class InstantDictionary:
    """Distinct timestamp texts with their instant (or day).

    ``path`` names the table; a new one is begun in the shared folder where it
    is None. ``day_sources`` are the sources whose texts denote days.

    The zone of an entry is the one its text is read in where it names none, or,
    of a day source, the one whose day a text with a zone denotes; a null zone is
    UTC, or New York for days. The same text of another zone is another entry.

    Defined results: null, empty and blank texts are not kept and attach NULL; a
    zone that does not exist gives NULL where the text needs it; texts of no known notation are kept
    with NULL so that they are never parsed again; equal texts share one entry.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, day_sources: tuple[str, ...] = ()):
        require_utc(spark)
        self.spark, self.path, self.day_sources = spark, path or fresh_path(spark, "instants"), day_sources

    def _exists(self) -> bool:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def read(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).option("recursiveFileLookup", "true").parquet(self.path)

    def extend(self, cells: DataFrame) -> "InstantDictionary":
        """Add the texts of ``cells(source, zone, raw)`` that are not yet kept.

        The new part is one directory, written whole or not at all.
        """
        fresh = cells.select("source", "zone", trimmed(F.col("raw")).alias("raw")).where("raw is not null").distinct()
        if self._exists():
            a, b = fresh.alias("a"), self.read().select("source", "zone", "raw").alias("b")
            same = F.col("a.source").eqNullSafe(F.col("b.source")) & F.col("a.zone").eqNullSafe(F.col("b.zone")) & (F.col("a.raw") == F.col("b.raw"))
            fresh = a.join(b, same, "left_anti")
        is_day = F.coalesce(F.col("source").isin(*self.day_sources), F.lit(False)) if self.day_sources else F.lit(False)
        home = F.coalesce("zone", F.when(is_day, "America/New_York").otherwise("UTC"))
        parsed = fresh.withColumn("_zone", zone_id(home)).select(
            "source", "zone", "raw",
            F.when(~is_day, instant_of(F.col("raw"), F.col("_zone"))).alias("instant"),
            F.when(is_day, day_of(F.col("raw"), F.col("_zone"))).alias("day"),
        )
        parsed.write.mode("error").parquet(f"{self.path}/part-{uuid.uuid4().hex}")
        return self

    def attach(self, rows: DataFrame, raw: str, source: Column | str, zone: Column | str) -> DataFrame:
        """``rows`` with ``instant`` and ``day`` of the text in column ``raw``.

        Columns of ``rows`` keep their names; ``instant``, ``day`` and names
        beginning with ``_dict_`` must be free.
        """
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        keyed = rows.withColumns({"_dict_source": lit(source), "_dict_zone": lit(zone), "_dict_raw": trimmed(F.col(raw))})
        entries = self.read().select(
            F.col("source").alias("_dict_source"), F.col("zone").alias("_dict_zone"), F.col("raw").alias("_dict_raw"), "instant", "day"
        )
        keys = ["_dict_source", "_dict_zone", "_dict_raw"]
        a, b = keyed.alias("_a"), entries.select(*[F.col(k).alias(f"{k}_") for k in keys], "instant", "day").alias("_b")
        same = F.col("_dict_source").eqNullSafe(F.col("_dict_source_")) & F.col("_dict_zone").eqNullSafe(F.col("_dict_zone_")) & (F.col("_dict_raw") == F.col("_dict_raw_"))
        return a.join(b, same, "left").drop(*keys, *[f"{k}_" for k in keys])


#: The text fields of the filing tables: table, id, field, and whether it denotes a day.
FILING_FIELDS = (
    ("submissions", "sub_id", "acceptancedatetime", False),
    ("submissions", "sub_id", "filingdate", True),
    ("filings", "filing_id", "filed", True),
)


def normalised_cells(submissions: DataFrame, filings: DataFrame, path: str | None = None) -> DataFrame:
    """``tbl, row_id, fld, normal`` of each cell that denotes an instant or day.

    Rows without an id keep a NULL ``row_id``; repeated rows come out as often as
    they occur; other columns of the tables are not read.
    """
    spark, tables = submissions.sparkSession, {"submissions": submissions, "filings": filings}
    days = tuple(f"{t}.{f}" for t, _, f, day in FILING_FIELDS if day)
    kept = InstantDictionary(spark, path, day_sources=days)
    cells = None
    for name, key, field, day in FILING_FIELDS:
        part = tables[name].select(
            F.lit(name).alias("tbl"), F.col(key).cast("bigint").alias("row_id"), F.lit(field).alias("fld"),
            F.col(field).cast("string").alias("raw"), F.lit(f"{name}.{field}").alias("source"), F.lit("America/New_York" if day else "UTC").alias("zone"),
        ).where("raw is not null")
        cells = part if cells is None else cells.unionByName(part)
    kept.extend(cells)
    joined = kept.attach(cells, "raw", F.col("source"), F.col("zone"))
    normal = F.coalesce(instant_text(F.col("instant")), F.date_format("day", "yyyy-MM-dd"))
    return joined.select("tbl", "row_id", "fld", normal.alias("normal")).where("normal is not null")
