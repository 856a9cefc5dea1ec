"""Session-level helpers: the shared folder and lineage cuts."""

from __future__ import annotations

import contextlib
import tempfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


#: Threads that start the shuffles, and those that start the broadcasts, of a driver's plans.
STARTERS = 32
#: Whether files of a plan's shuffles are deleted when it has run.
DROP_FILES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def few_threads(spark: SparkSession) -> None:
    """Bounds the driver's threads that start shuffles and broadcasts, if no plan has run before.

    Spark makes a new one for each exchange, up to 1,024 and 128, and keeps it for a minute; with its stack and what it
    allocates each takes some 0.7 MB beside the heap. They only submit jobs, so with fewer the others wait their turn. The
    settings are static for a session's own configuration, but read when the first exchange starts.
    """
    conf = spark._jsparkSession.sessionState().conf()
    for pool in ("shuffleExchange", "broadcastExchange"):
        conf.setConfString(f"spark.sql.{pool}.maxThreadThreshold", str(STARTERS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset in local mode (tests).

    On a cluster without that setting there is no such folder, which is an error.
    """
    few_threads(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/peergraph-checkpoints"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def is_local(spark: SparkSession) -> bool:
    """Whether the driver's heap is the executors' too, and so grows with the data."""
    return spark.sparkContext._jsc.sc().isLocal()


def give_back(spark: SparkSession) -> None:
    """Returns memory that the driver's JVM has no use for to the system.

    Plans leave much garbage: the heap is collected once it has grown past half of its bound, else it grows to its bound
    whatever is in use. Beside it the C library keeps what compilers and threads have freed, in an arena for each of up to 8
    threads a core; it is asked to let go of that (Java has a command for it since 17.0.9, elsewhere nothing happens).
    """
    java = spark._jvm.java.lang
    heap = java.Runtime.getRuntime()
    if 2 * heap.totalMemory() > heap.maxMemory():
        java.System.gc()
    with contextlib.suppress(Py4JJavaError):
        server = java.management.ManagementFactory.getPlatformMBeanServer()
        ask = next(m for m in java.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(java.Object, 4)
        args[0], args[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        ask.invoke(server, args)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages reread it from the shared folder instead of recomputing what made it.

    So nothing reads the shuffles that made it again, and their files go at once; else they stay until the driver happens to
    collect its garbage. The setting is read when a plan is made, so it is set for this one plan only (a plan that another
    thread makes meanwhile would lose its files as well, and make them again if they are asked for).
    """
    shared_dir(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(DROP_FILES, None)
    conf.set(DROP_FILES, "true")
    try:
        own = df.select("*")
    finally:
        conf.unset(DROP_FILES) if before is None else conf.set(DROP_FILES, before)
    found = own.checkpoint()
    if not is_local(df.sparkSession):
        give_back(df.sparkSession)
    return found
