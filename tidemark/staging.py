"""Written tables that cut lineage and survive lost executors.

Loops and shared inputs are cut by writing Parquet into the shared folder that
``spark.checkpoint.dir`` names and reading it back: the data is computed once,
stays columnar, and no executor holds the only copy. Where that setting is
missing, a folder in the warehouse is used, which every executor reaches too.

The tables of a session lie in one folder. A loop drops a state as soon as the
next is written (``unstage``); whoever is done with a query's result may drop
all that is left (``clear_staged``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_root(spark: SparkSession) -> str:
    """The folder of this session's staged tables."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    shared = configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"
    return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}"


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._staged_path = path
    return written


def delete_staged(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def unstage(*written: DataFrame) -> None:
    """Delete staged tables that nothing will read again; other frames are left alone."""
    for df in written:
        path = df.__dict__.get("_staged_path")
        if path:
            delete_staged(df.sparkSession, path)


def clear_staged(spark: SparkSession) -> None:
    """Delete all staged tables of this session; results that still read them become invalid."""
    delete_staged(spark, staging_root(spark))
