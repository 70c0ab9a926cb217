"""A session with the settings that the engine's plans expect."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "cytoloom", master: str | None = None, **settings: str) -> SparkSession:
    """Adaptive execution splits skewed joins and joins small partitions; times are UTC. ``settings`` use __ for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    found = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in settings.items()}
    return builder.config(map=found).getOrCreate()


def checkpoints(spark: SparkSession) -> None:
    """Sees to a folder for ``checkpoint()``: the cluster's ``spark.checkpoint.dir``; a local one for a local master only."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not found and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp())


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the folder for checkpoints, which goes when the process ends.

    Iterations cut their lineage by this: a checkpoint would carry what the
    optimiser has inferred about the columns from round to round, and that
    grows with each.
    """
    spark = df.sparkSession
    checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
