"""Session settings and the folder that outlives executors."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# fixed when a session starts; call-site capture multiplies the driver's time to build long column expressions
START_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false", "spark.ui.enabled": "false",
                  "spark.ui.showConsoleProgress": "false"}


def local_session(cpus: int = 8, memory: str = "16g", name: str = "postingworks") -> SparkSession:
    """A session for tests and measurements on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name).config("spark.driver.memory", memory).config(
        "spark.sql.shuffle.partitions", str(cpus))
    for key, value in {**SETTINGS, **START_SETTINGS}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    return spark


def built_once(build):
    """Keeps what `build` returns per application and arguments: long column expressions are built once."""
    kept = {}

    @functools.wraps(build)
    def get(*args):
        context = SparkContext._active_spark_context
        key = (context.applicationId if context else None, *args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return get


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and all executors are on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
