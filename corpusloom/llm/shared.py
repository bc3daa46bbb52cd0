"""Where intermediate results go so that they outlive a lost executor."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder, as in tests on one machine.
LOCAL_FALLBACK = "file:///tmp/checkpoints"


#: Tables that this driver wrote, for ``release``.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, else the context's checkpoint folder. A local one is set only where neither is and
    everything runs on one machine; executors elsewhere would each write to a disk of their own, so that is an error."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = LOCAL_FALLBACK
        context.setCheckpointDir(named)
    return named.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut and the work is done once."""
    path = f"{shared_dir(df.sparkSession)}/stage-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Remove the tables that ``stage`` wrote, once their results are kept elsewhere; lazy results read them until then."""
    conf, n = spark._jsc.hadoopConfiguration(), 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
