"""Session factory and the settings the engine relies on."""

from __future__ import annotations

import os
import tempfile

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that hold for every size; sizes of partitions are left to the cluster and to adaptive execution.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoints go when nothing refers to them any more; to be set on a session that is made elsewhere.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
#: Frames of at most so many bytes are broadcast.
BROADCAST_BYTES = 20_000_000


def build_session(app: str = "docloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings. `master` is for local use; on a cluster spark-submit sets it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | conf).getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the engine needs on a session made elsewhere; all of it can change at run time, and it stays set."""
    for key in ("spark.sql.mapKeyDedupPolicy", "spark.sql.session.timeZone"):
        spark.conf.set(key, SETTINGS[key])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: what the session names in spark.checkpoint.dir, else (in tests) a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "docloom-checkpoint"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame that several branches read, in the shared folder, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Collect the garbage of the driver's JVM: shuffle files, broadcasts and checkpoints that nothing refers to any more go only then, and after it the heap shrinks. Then hand back
    what the JVM has allocated outside its heap and freed, mostly to compile plans, which the C library else keeps."""
    context = spark.sparkContext
    context._jvm.System.gc()
    try:
        _trim(context._jvm, context._gateway.new_array)
    except Py4JError:  # a JVM or a system without this command
        pass


def _trim(jvm, array) -> None:
    """The command System.trim_native_heap of the JVM; its server's class isn't open to calls, the interface is."""
    kinds = array(jvm.java.lang.Class, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = jvm.java.lang.Class.forName(kind)
    values = array(jvm.java.lang.Object, 4)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(server, values)


def _width(column: str, kind: str) -> Column:
    """The bytes of a value, about."""
    if kind == "string":
        return F.coalesce(F.octet_length(column), F.lit(0)) + 24
    if kind == "array<string>":
        return F.coalesce(F.octet_length(F.array_join(column, "")) + 24 * F.size(column), F.lit(0)) + 24
    if kind.startswith("array"):
        return F.coalesce(F.size(column) * 16, F.lit(0)) + 24
    return F.lit(8)


def broadcast_checked(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The frame, to be broadcast if its rows have been measured to take `limit` bytes at most. The frame should have been cut."""
    size = sum((_width(c, kind) for c, kind in df.dtypes), F.lit(16))
    total = df.agg(F.sum(size.cast("long"))).first()[0]
    return F.broadcast(df) if (total or 0) <= limit else df


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """The keys that stand in more than one row."""
    return broadcast_checked(cut(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)))


def distinct_rows(df: DataFrame, key: str, repeated: DataFrame) -> DataFrame:
    """The distinct rows. `repeated` holds the keys that may stand in more than one row; only rows of these and of null keys are shuffled, no others can be equal."""
    some = F.col(key).isNotNull()
    single = df.where(some).join(repeated, key, "left_anti")
    return single.unionByName(df.join(repeated, key, "left_semi").unionByName(df.where(~some)).distinct()).select(*df.columns)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
