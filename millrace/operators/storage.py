"""Intermediate tables in the folder that all machines of a cluster share: lineage is cut, and lost executors cost no rerun."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet and read again. For tables with more than one consumer that are costly to make.

    The folder is in spark.checkpoint.dir, under the application's id; without that setting a temporary folder is made on one
    machine (local master), and a cluster is refused.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_root(spark: SparkSession) -> str:
    """The application's folder below spark.checkpoint.dir; below a temporary one with a local master and without that setting."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("millrace.stored.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-stored-", dir="/tmp")
        spark.conf.set("millrace.stored.dir", root)
    return f"{root.rstrip('/')}/millrace-{spark.sparkContext.applicationId}"


def spread(df: DataFrame) -> DataFrame:
    """The rows of a small input dealt over all cores: a table of fewer partitions than cores is often one row group, and one task.

    Inputs of more partitions, as large ones are, stay as they are: nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
