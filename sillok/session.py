"""Session helpers shared by every operator: table access, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Largest estimated size of a side that may be broadcast.
BROADCAST_BYTES = 16 << 20


def local_session(cores: int | str = "*", name: str = "sillok", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Where the session names none, a local session gets a folder of its own and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not found:
        current = jsc.getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sillok-cut-")
        spark.sparkContext.setCheckpointDir(found)
    elif not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def give_back(spark: SparkSession) -> None:
    """Let the driver's JVM give back the memory of finished plans; a loop over many batches else keeps it until the heap is full. Nothing else depends on it."""
    spark.sparkContext._jvm.System.gc()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder for a written table."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{os.urandom(8).hex()}"


def stored(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """``df`` written once to ``path`` (``scratch_path``) and read back; the shuffle files that made it are dropped as soon as it is written. ``rows_of`` tells its number of rows, counted as they were written."""
    spark = df.sparkSession
    before, seen = spark.conf.get(_TIDY, None), Observation()
    spark.conf.set(_TIDY, "true")
    try:
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._sillok_rows = seen
    return back


def rows_of(df: DataFrame) -> int:
    """The number of rows of a table; of one that ``stored`` gave, without another job."""
    seen = getattr(df, "_sillok_rows", None)
    return df.count() if seen is None else seen.get["rows"]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def bounded_broadcast(df: DataFrame, max_rows: int, row_bytes: int = 256) -> DataFrame:
    """Broadcast ``df`` if its counted rows stay under ``max_rows`` and the size bound; else leave the join to a shuffle."""
    rows = df.limit(max_rows + 1).count()
    return F.broadcast(df) if rows <= max_rows and rows * row_bytes <= BROADCAST_BYTES else df
