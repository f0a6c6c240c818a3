"""Versioned tables: each write is a new folder, a small pointer names the current one, nothing is overwritten in place."""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sillok.operators.merge import upsert, winners

POINTER = "current.json"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place, jvm


def read_current(spark: SparkSession, root: str) -> DataFrame | None:
    """The current version of a table; null if none was written."""
    fs, place, jvm = _fs(spark, f"{root}/{POINTER}")
    if not fs.exists(place):
        return None
    name = json.loads("".join(r[0] for r in spark.read.text(f"{root}/{POINTER}").collect()))["version"]
    return spark.read.parquet(f"{root}/{name}")


def write_version(df: DataFrame, root: str) -> str:
    """Write a new version, check that it reads back with as many rows as were written, then put its name into the pointer by one overwriting rename, so that readers always meet a table."""
    spark = df.sparkSession
    name = f"v{time.time_ns()}"
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(f"{root}/{name}")
    found = spark.read.parquet(f"{root}/{name}").count()
    if found != written.get["rows"]:
        raise OSError(f"{root}/{name} reads back with {found} rows of {written.get['rows']}")
    fs, target, jvm = _fs(spark, f"{root}/{POINTER}")
    fresh = jvm.org.apache.hadoop.fs.Path(f"{root}/.{POINTER}.{name}")
    out = fs.create(fresh, False)
    out.write(bytearray(json.dumps({"version": name}).encode()))
    out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    place = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    place.rename(fs.makeQualified(fresh), fs.makeQualified(target), options)
    return name


@contextmanager
def sole_writer(root: str, spark: SparkSession, patience: float = 10.0) -> Iterator[None]:
    """Hold a table's lock file while writing; TimeoutError if another writer keeps it longer than ``patience`` seconds. A foreign lock is never removed."""
    fs, lock, _ = _fs(spark, f"{root}/.lock")
    fs.mkdirs(lock.getParent())
    until = time.monotonic() + patience
    while not fs.createNewFile(lock):  # creates or refuses in one step
        if time.monotonic() >= until:
            raise TimeoutError(f"{root} is being written")
        time.sleep(0.1)
    try:
        yield
    finally:
        fs.delete(lock, False)


def save_observations(fresh: DataFrame, root: str, ordinal: str = "ordinal") -> DataFrame:
    """Merge fresh postings into the stored observations and return the shown records; sources that failed delete nothing. One writer at a time holds the table's lock.

    What is stored are the distinct observations (``merge.upsert``), so their number grows with what was really seen and a repeated save writes nothing.
    """
    spark = fresh.sparkSession
    with sole_writer(root, spark):
        changed = upsert(fresh, read_current(spark, root), ordinal)
        if changed is not None:
            write_version(changed, root)
    return winners(read_current(spark, root), ordinal)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def to_json(df: DataFrame) -> DataFrame:
    """One JSON text per row, nulls kept, letters unescaped."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def create_file(path: str, text: str) -> None:
    """A new local file with all of its text or none; an existing one is never replaced."""
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=os.path.dirname(os.path.abspath(path)), delete=False) as out:
        out.write(text)
    try:
        os.link(out.name, path)
    finally:
        os.unlink(out.name)
