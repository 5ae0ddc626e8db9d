"""Table helpers: reading inputs, clash-free columns, sizes and the shared folder."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """Only the operator's own columns, so that others may have any name."""
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *more)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a folder of this machine only where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sparkscan-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    for made in _scratch:
        made.append(path)
    return path


_scratch: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the folders made by shared_dir inside; results that read them must be written by then."""
    made: list[str] = []
    _scratch.append(made)
    try:
        yield
    finally:
        _scratch.pop()
        for path in made:
            remove(spark, path)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"  # 1 where each row is megabytes of packed arrays


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Queries that begin inside have this setting."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def freed(spark: SparkSession):
    """Queries that begin inside delete their shuffle files at their end; else these stay until the driver happens to collect its garbage."""
    return setting(spark, CLEANUP, "true")


def trim() -> None:
    """Gives what this process has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


SETTLE = 5  # seconds at least between two times that the driver gives memory back
_settled = [float("-inf")]


def settle(spark: SparkSession) -> None:
    """Gives memory that the driver's JVM doesn't use back to the system, if SETTLE seconds have gone by since the last time. Plans and answers of many
    queries grow its heap, and compiling them leaves as much in the C allocator's free lists; a JVM that can't trim these keeps them."""
    if time.monotonic() - _settled[0] < SETTLE:
        return
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    jvm.System.gc()

    def array(kind, *items):
        out = gateway.new_array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    try:
        named, name = jvm.java.lang.Class.forName, jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        kinds = (name.getClass(), *(named(x) for x in ("java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
        invoke = named("javax.management.MBeanServerConnection").getMethod("invoke", array(jvm.java.lang.Class, *kinds))
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke.invoke(server, array(jvm.Object, name, "systemTrimNativeHeap", array(jvm.Object), array(jvm.String)))
    except Py4JError:
        pass  # another JVM, or another system than Linux
    trim()
    _settled[0] = time.monotonic()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a written table in the shared folder: lost executors cost no recomputation."""
    return cut_at(df, shared_dir(df.sparkSession))


def cut_at(df: DataFrame, path: str) -> DataFrame:
    settle(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


UNKNOWN = 1 << 50  # estimates beyond this say that the optimizer knows nothing


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the input's size: file sizes for tables, without a scan. Rows of other origin are measured once."""
    if "_input_bytes" not in df.__dict__:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        if size >= UNKNOWN:
            texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("binary")), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
            size = int(df.select(sum(texts, F.lit(16)).cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0)
        df.__dict__["_input_bytes"] = size
    return df.__dict__["_input_bytes"]


PARTITIONS = 1 << 16  # of one shuffle; pieces beyond share partitions and are still taken one by one


def pieces_for(df: DataFrame, piece_bytes: int, least: int = 1) -> int:
    """How many pieces of about piece_bytes the input makes."""
    return max(least, -(-input_bytes(df) // piece_bytes))


def by_number(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows dealt by the number of their piece, so that tasks hold about one piece each whatever spark.sql.shuffle.partitions is."""
    return rows.repartition(max(1, min(PARTITIONS, n)), *keys)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
