"""Folders that the driver and every executor can reach, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Folders made by this process, for ``clean``.
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tallyforge-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; nothing is written yet."""
    path = f"{shared_folder(spark)}/tallyforge/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


#: Spark's own switch: shuffle files go when the statement that made them ends.
_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def give_back_driver(spark: SparkSession) -> None:
    """Return free native memory of the driver's JVM to the system; a long run of statements piles it up."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    try:
        # By reflection, as the server's own class is not accessible.
        types, values = gateway.new_array(jvm.Class, 4), gateway.new_array(jvm.Object, 4)
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[k] = jvm.Class.forName(name)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, values)
    except Py4JError:  # a JVM without this command
        pass


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``df`` as Parquet; the shuffle files behind it are gone afterwards."""
    spark = df.sparkSession
    before = spark.conf.get(_FILE_CLEANUP, None)
    spark.conf.set(_FILE_CLEANUP, "true")
    try:
        df.write.mode(mode).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_FILE_CLEANUP)
        else:
            spark.conf.set(_FILE_CLEANUP, before)
        give_back_driver(spark)


def stored(df: DataFrame, label: str, scratch: list[DataFrame] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: its lineage ends there. ``scratch`` collects what is to be dropped later."""
    spark = df.sparkSession
    path = fresh_folder(spark, label)
    write(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if scratch is not None:
        scratch.append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` whose last reader is done."""
    for table in tables:
        if table.stored_at in _made:
            _made.remove(table.stored_at)
            _delete(table.sparkSession, table.stored_at)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def clean(spark: SparkSession) -> None:
    """Delete what this process has written; results that are still lazy must have been read by then."""
    while _made:
        _delete(spark, _made.pop())
