"""Tables on the way: written once under the folder that all executors share, so that later reads need no second run."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or (where unset, as in tests) a folder of our own on a local master."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tagveil-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir()


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """The rows by hash, in as many pieces as a join makes, so that it takes them as they lie; small rows of which much is to be made are not gathered in few."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def stored(df: DataFrame) -> DataFrame:
    """The table as compressed Parquet, read back; it lives as long as the folder."""
    path = f"{shared_dir(df.sparkSession)}/scratch/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
