"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset and Spark runs in one process, as in tests, a temporary folder is made and set; on a
    cluster that raises ValueError. This module needs a classic session (it asks the JVM for the folder).
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        named = named or tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named or current.get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, held in the shared folder.

    The files go when Spark's cleaner finds the result unreachable
    (spark.cleaner.referenceTracking.cleanCheckpoints); the rows that were shuffled for it go at once.
    """
    shared_folder(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        # a plan of its own: whether a plan's shuffles are freed is settled when it is made
        held = df.select("*").checkpoint(eager=True)
    tidy(df.sparkSession, if_grown=True)
    return held


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Of plans that are made and run within, the shuffled rows go from the disks once a plan has run."""
    with configured(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        yield


@contextmanager
def configured(spark: SparkSession, values: dict[str, str | int]) -> Iterator[None]:
    """Settings for what is run within."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


#: Share of the heap that the driver may have, beyond which tidy() takes it to have grown.
GROWN = 0.45


def grown(spark: SparkSession) -> bool:
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    return heap.totalMemory() > GROWN * heap.maxMemory()


def tidy(spark: SparkSession, if_grown: bool = False) -> None:
    """Call between the steps of a long loop: what earlier plans left on the driver goes, and with it, by Spark's cleaner, the
    files of checkpoints that nothing reads any more. Else both grow until the driver's heap is full.

    if_grown: only where the JVM has taken much heap, for short steps: it counts the time of each collection and, where
    that is a large part of the time between them, takes more heap instead of less."""
    if if_grown and not grown(spark):
        return
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """What the JVM's compiler has freed for the many plans' code stays with glibc, some 200 MB after four hundred stages; it
    goes back to the system. False where the JVM knows no System.trim_native_heap (before 17.0.9, or without glibc)."""
    from py4j.protocol import Py4JError

    jvm = spark.sparkContext._jvm
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # the server's class is not exported, so its method is taken from the interface
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(server, given)
    except Py4JError:
        return False
    return True


_ROOTS: list[Scratch] = []


def clear() -> None:
    """Drop all tables that this process kept. Results that were not read yet can't be read afterwards."""
    while _ROOTS:
        _ROOTS.pop().drop()


class Scratch:
    """Parquet tables in the shared folder, under one name, dropped together; or in a folder that the caller names and
    that clear() leaves alone."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_folder(spark)}/graphloom/{uuid.uuid4().hex}"
        if not root:
            _ROOTS.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def written(self) -> list[str]:
        """Names of the tables that were written to their end."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}/_SUCCESS"))]

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
