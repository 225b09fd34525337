"""Session defaults and the shared folder that cuts lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int | None = None) -> SparkSession:
    """A single-machine session with the settings the engine expects."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyweir")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where the session names none and all runs in one process (tests, a laptop)
    is a temporary folder made and remembered in the session.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("tallyweir.shared.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tallyweir-")
        spark.conf.set("tallyweir.shared.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, so a lost
    executor costs a re-read, not a recomputation. ``forget`` removes the table."""
    path = fresh_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that nothing reads any more, and the shuffle files
    of finished executions: Spark's cleaner takes those whose plans the driver no
    longer holds, which it learns by a collection of the driver's heap."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_at)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    if tables:
        gc.collect()  # handles of plans on this side
        tables[0].sparkSession._jvm.System.gc()


def require_utc(spark: SparkSession) -> None:
    """Clock arithmetic below renders timestamps; it is only defined in UTC."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC, not {zone}")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session; executors that
    join later fetch it from the driver."""
    if spark.conf.get("tallyweir.shipped", "") == "yes":
        return
    at = os.path.join(tempfile.mkdtemp(prefix="tallyweir-code-"), "tallyweir_code.zip")
    root = os.path.dirname(os.path.abspath(__file__))
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(at)
    spark.conf.set("tallyweir.shipped", "yes")


def spread(scan: DataFrame, key: str) -> DataFrame:
    """``scan``, a projection of a scanned table, over all cores where it comes in no
    more than a quarter as many partitions, as a small file of one row group does.
    An input that keeps more cores busy by itself is not shuffled."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if 4 * scan.rdd.getNumPartitions() > cores else scan.repartition(cores, key)
