"""Session settings that every operator relies on: the shared folder and table loading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share; from ``spark.checkpoint.dir``.

    Only a local session may run without the setting: it then gets a folder of its own, once.
    On a cluster a missing setting is an error, since a machine-local folder would not be shared.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if folder:
        # with its scheme, so that executors' Python finds the same place as Spark does
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="logweir-")
        spark.conf.set(CHECKPOINT_KEY, folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, unique to this call."""
    return f"{shared_dir(spark)}/logweir/{name}-{uuid.uuid4().hex}"


def kept(spark: SparkSession, name: str) -> str:
    """As ``scratch``, for what outlives the query that writes it: ``drop_scratch`` leaves it."""
    return f"{shared_dir(spark)}/logweir-kept/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet into the shared folder and reads it back.

    The copy survives lost executors, unlike a local checkpoint, and is read once per consumer
    instead of being computed once per consumer.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_scratch(spark: SparkSession) -> bool:
    """Removes all intermediate tables below the shared folder, once nothing reads them any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/logweir")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
