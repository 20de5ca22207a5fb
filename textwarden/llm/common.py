"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import re
import tempfile
import time
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group is hot when it holds at least one row in HOT_PARTS, so there are at most HOT_PARTS hot groups.
HOT_PARTS = 1000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run below spark.checkpoint.dir, which every executor can reach.

    The setting is read from the session; only in local mode, where it is unset in tests, a local folder is set. A path
    without a scheme is one of the cluster's default file system.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "textwarden-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    full = re.sub(r"^file:/+", "file:///", full)
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(full)
    return full


#: Folders that each application has made.
_MADE: dict[str, list[str]] = {}


def clean_up(spark: SparkSession) -> int:
    """Deletes the folders that this application's runs have left; call it when their results have been stored."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for folder in made:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(made)


#: Rows that Python gets at once while a step is written: texts may be long, and both sides hold a batch.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back."""
    spark = df.sparkSession
    path, before = shared_dir(spark, name), spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
        _forget(spark)
    return spark.read.schema(df.schema).parquet(path)


#: Seconds between two collections of the driver's garbage.
COLLECT_EVERY = 5
_collected = 0.0


def _forget(spark: SparkSession) -> None:
    """Now and then, frees what the steps before have left: plans in the driver, and through Spark's cleaner their shuffle
    files and broadcasts, which stay until the driver's garbage is collected."""
    global _collected
    trim()
    if time.monotonic() - _collected > COLLECT_EVERY:
        gc.collect()
        spark._jvm.System.gc()
        trim_jvm(spark)
        _collected = time.monotonic()


def collect_executors(spark: SparkSession) -> None:
    """Collects the executors' garbage, by which their JVMs give back the heap that the steps before have grown and no
    longer use; else it stays at its largest, beside what the Python workers of later steps take. A task for each core,
    so that every executor that is free gets some; what little is left makes a repeated call cheap."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("gc")).write.format("noop").mode("overwrite").save()


def trim_jvm(spark: SparkSession) -> str | None:
    """Gives memory that the driver's JVM has freed outside its heap (compilers and plans leave much) back to the system;
    what the JVM says of it, None where it can't. The bean's class isn't public, so it is called by reflection."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    lang, named = jvm.java.lang, jvm.java.lang.Class.forName

    def array(kind, *items):
        out = gateway.new_array(kind, len(items))
        for k, item in enumerate(items):
            out[k] = item
        return out

    try:
        kinds = array(lang.Class, *map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
        bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = lang.management.ManagementFactory.getPlatformMBeanServer()
        return named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, array(lang.Object, bean, "systemTrimNativeHeap", None, None))
    except Py4JError:
        return None


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder, as executors open it; the store that Spark calls s3a is s3 here."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def write_atomically(uri: str, name: str):
    """(stream, commit) for a file of a task that may be retried: it shows under its name only when complete."""
    fs, base = open_fs(uri)
    fs.create_dir(base, recursive=True)
    part = f"{base}/.{name}.{uuid.uuid4().hex}"
    stream = fs.open_output_stream(part, compression=None)

    def commit() -> None:
        stream.close()
        fs.move(part, f"{base}/{name}")

    return stream, commit


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Left join of rows with one row per group, for groups of any skew.

    Groups of at least total / HOT_PARTS rows number at most HOT_PARTS, so they are broadcast; the others are
    small by definition and meet their rows in a shuffle.
    """
    digest = F.xxhash64(*keys)
    hot = [r[0] for r in groups.where(F.col(size) * F.lit(HOT_PARTS) >= F.lit(total)).select(digest).collect()]
    if not hot:
        return rows.join(groups.hint("merge"), keys, "left")
    # Both sides are split by the digest, so keys that share one stay together. At most HOT_PARTS values are listed.
    is_hot = digest.isin(hot)
    found = rows.where(is_hot).join(F.broadcast(groups.where(is_hot)), keys, "left")
    return found.unionByName(rows.where(~is_hot).join(groups.where(~is_hot).hint("merge"), keys, "left"))


def released(run):
    """A task function that, when its rows are done, gives back the memory that its worker holds but doesn't use, since
    workers stay for the next stages."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        trim()

    return wrapped


def trim() -> None:
    """Gives memory that this process holds but doesn't use back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library can't
        ctypes.CDLL(None).malloc_trim(0)


def crc_mod(column: str, mod: int) -> Column:
    """crc32 of an integer column as decimal text, modulo mod; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(mod)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
