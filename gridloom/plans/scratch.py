"""Tables in the folder that driver and executors share, for loops whose lineage must end."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Characters of each plan's text that the driver keeps, where the session has Spark's default (no bound): loops run hundreds of jobs.
PLAN_TEXT = 4096


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; local sessions without one get a temporary folder."""
    if int(spark.conf.get("spark.sql.maxPlanStringLength", "0")) > 1 << 30:
        spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_TEXT))
    got = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not got:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def release(spark: SparkSession) -> bool:
    """Gives memory that the driver's native code has freed back to the system; False where its Java has no such command.

    Hundreds of short-lived threads plan and start jobs, and the C library keeps what each frees: 230 MB after 15 stages of
    the pipeline, of 437. Only free memory goes, so results can't change.
    """
    try:
        sc = spark.sparkContext
        jvm, array = sc._jvm, sc._gateway.new_array
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # its class is hidden, so the method is looked up in the public interface
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = array(jvm.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(server, given)
    except Exception:  # another Java, or no JVM at hand
        return False
    return True


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/gridloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
