"""At-least-once deliveries to exactly one copy, as a streaming job.

Per micro-batch the job looks identifiers up in a keyed state table of those
seen lately; what it does not know it looks up in the archive of identifiers
that the event-time watermark has expired, so a late arrival is recognised
whatever its age. The archive is sorted by a part of the identifier, and only the
parts a batch names are read: the others are skipped by their statistics. A batch writes what it has seen and no more;
every ``COMPACT`` batches the state is rewritten without what has expired. State,
archive and output of a batch lie under its number and count only once its commit
file is there: they become visible together, and a batch that is run again after a
loss overwrites its own part.

Spark's own deduplicating operators drop rows behind the watermark; a late first
delivery would be lost. Hence the state is a table of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.functions.instants import parse_instant
from tallyweir.functions.keys import accession_digits, cik_number
from tallyweir.session import fresh_path, require_utc

#: Identifiers leave the state when the newest event is this much later.
HORIZON_SECONDS = 30 * 86_400
#: Bytes of files in one micro-batch, whatever lies in the folder; a file is never split.
BATCH_BYTES = 4 << 20
#: Batches after which the state is rewritten.
COMPACT = 16

_SEEN = "acc string, cik string, first_id bigint, at timestamp"
_COPIES = "acc string, cik string, first_id bigint, copy_id bigint"
_MET = _SEEN + ", old_id bigint, known boolean"
#: The year digits of an accession of 18, by which the archive is laid out.
_SLOT = "case when length(acc) = 18 then substring(acc, 11, 2) else 'xx' end"


def deliveries(feed: DataFrame) -> DataFrame:
    """``acc, cik, delivery_id, at`` of the rows that have an identifier.

    Rows without accession digits, filer number or delivery_id are no case.
    """
    return feed.select(
        accession_digits("accession").alias("acc"), cik_number("cik").alias("cik"), F.col("delivery_id").cast("bigint").alias("delivery_id"),
        F.coalesce(parse_instant(F.col("acceptance_datetime").cast("string")), F.col("delivered_at").cast("timestamp")).alias("at"),
    ).where("acc is not null and cik is not null and delivery_id is not null")


class DeliveryLog:
    """The tables of one deduplicating job below ``root``.

    ``copies``: each delivery that repeats an identifier, with the first one;
    ``state``/``archive``: identifiers seen, by whether the watermark passed them.
    """

    def __init__(self, spark: SparkSession, root: str, horizon_seconds: int = HORIZON_SECONDS):
        require_utc(spark)
        self.spark, self.root, self.horizon = spark, root, horizon_seconds
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, table: str, batch: int) -> str:
        return f"{self.root}/{table}/{batch:09d}"

    def committed(self) -> list[int]:
        at = self._path(f"{self.root}/commits")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _read(self, table: str, schema: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._at(table, b) for b in batches])

    def _last(self) -> tuple[int | None, int]:
        """Watermark in seconds (the newest event of the committed batches less the
        horizon), and the batch that last rewrote the state."""
        done = self.committed()
        if not done:
            return None, 0
        stream = self._fs.open(self._path(f"{self.root}/commits/{done[-1]:09d}"))
        try:
            mark, base = stream.readUTF().split(" ")
        finally:
            stream.close()
        return int(mark) if mark else None, int(base)

    def _commit(self, batch: int, watermark: int | None, base: int) -> None:
        hidden, final = self._path(f"{self.root}/.{batch:09d}"), self._path(f"{self.root}/commits/{batch:09d}")
        out = self._fs.create(hidden, True)
        out.writeUTF(f"{'' if watermark is None else watermark} {base}")
        out.close()
        self._fs.mkdirs(final.getParent())
        self._fs.rename(hidden, final)

    def process(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch of feed rows. A committed batch is not run again."""
        done = self.committed()
        if batch in done:
            return
        old_mark, base = self._last()
        deliveries(rows).write.mode("overwrite").parquet(self._at("input", batch))
        given = self.spark.read.schema("acc string, cik string, delivery_id bigint, at timestamp").parquet(self._at("input", batch))
        keys = ["acc", "cik"]
        incoming = given.groupBy(*keys).agg(F.min("delivery_id").alias("new_id"), F.max("at").alias("new_at"))
        state = self._read("state", _SEEN, [b for b in done if b >= base]).groupBy(*keys).agg(F.min("first_id").alias("first_id"), F.max("at").alias("at"))
        met = incoming.join(state, keys, "left") if done else incoming.withColumns({"first_id": F.lit(None).cast("bigint"), "at": F.lit(None).cast("timestamp")})
        if done:
            # The archive is asked for the unknown identifiers only, in the parts they can lie in.
            slots = [r[0] for r in given.select(F.expr(_SLOT)).distinct().collect()]  # a hundred and one at most
            archive = self._read("archive", _SEEN + ", slot string", done).where(F.col("slot").isin(*slots)).select(*keys, F.col("first_id").alias("late_id"))
            late = met.where("first_id is null").drop("first_id").join(archive, keys, "left").groupBy(*keys).agg(
                F.first("new_id").alias("new_id"), F.first("new_at").alias("new_at"), F.min("late_id").alias("first_id"), F.first("at").alias("at")
            )
            met = met.where("first_id is not null").withColumn("known", F.lit(True)).unionByName(late.withColumn("known", F.lit(False)))
        else:
            met = met.withColumn("known", F.lit(False))
        first = F.least("first_id", "new_id")
        met.select(*keys, first.alias("first_id"), F.greatest("at", "new_at").alias("at"), F.col("first_id").alias("old_id"), "known").write.mode("overwrite").parquet(self._at("seen", batch))
        seen = self._read("seen", _MET, [batch])
        newest = seen.agg(F.max(F.unix_seconds("at"))).first()[0]
        mark = max([x for x in (old_mark, newest - self.horizon if newest is not None else None) if x is not None], default=None)
        hot = F.col("at").isNull() if mark is None else (F.col("at").isNull() | (F.unix_seconds("at") >= mark))
        # What the state holds stays there until it is rewritten, so that no older entry of it hides the archive.
        hot, kept = hot | F.col("known"), seen.select(*keys, "first_id", "at", "known")
        if batch - base >= COMPACT:
            every = kept.drop("known").unionByName(self._read("state", _SEEN, [b for b in done if b >= base]))
            kept = every.groupBy(*keys).agg(F.min("first_id").alias("first_id"), F.max("at").alias("at")).withColumn("known", F.lit(False))
            base = batch
        kept.where(hot).drop("known").write.mode("overwrite").parquet(self._at("state", batch))
        kept.where(~hot).drop("known").withColumn("slot", F.expr(_SLOT)).repartition("slot").sortWithinPartitions("slot").write.mode("overwrite").parquet(self._at("archive", batch))
        given.join(seen.select(*keys, "first_id"), keys).where("delivery_id <> first_id").select(*keys, "first_id", F.col("delivery_id").alias("copy_id")).write.mode("overwrite").parquet(self._at("copies", batch))
        self._commit(batch, mark, base)

    def copies(self) -> DataFrame:
        """``first_id, copy_id`` of all committed batches.

        Where a smaller delivery came after a larger one had been taken for the
        first, the larger is a copy too and earlier copies point to the smaller.
        """
        done = self.committed()
        copies = self._read("copies", _COPIES, done)
        moved = self._read("seen", _MET, done).where("old_id > first_id").select("acc", "cik", "old_id")
        if moved.isEmpty():
            return copies.select("first_id", "copy_id")
        keys = ["acc", "cik"]
        least = self._read("seen", _SEEN, done).join(moved.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.min("first_id").alias("least_id"))
        every = copies.unionByName(moved.select(*keys, F.col("old_id").alias("first_id"), F.col("old_id").alias("copy_id")))
        return every.join(least, keys, "left").select(F.coalesce("least_id", "first_id").alias("first_id"), "copy_id").distinct()

    def survivors(self) -> DataFrame:
        """``acc, cik, first_id``: the one delivery kept of each identifier."""
        return self._read("seen", _SEEN, self.committed()).groupBy("acc", "cik").agg(F.min("first_id").alias("first_id"))


def run_dedupe(spark: SparkSession, source: str, schema, root: str | None = None, horizon_seconds: int = HORIZON_SECONDS, batch_bytes: int = BATCH_BYTES) -> DeliveryLog:
    """Read all that the feed folder holds now, batch by batch, and return the log.

    Calling it again with the same ``root`` goes on where the last call ended.
    """
    root = root or fresh_path(spark, "feed")
    log = DeliveryLog(spark, root, horizon_seconds)
    at = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes))
    if fs.getFileStatus(at).isFile():  # a stream reads folders
        reader, source = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    stream = reader.parquet(source)
    (
        stream.writeStream.foreachBatch(lambda rows, batch: log.process(rows, batch))
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return log
