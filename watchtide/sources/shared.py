"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; below a temporary one where the setting is absent
    on one machine (on a cluster that is an error, as executors couldn't see it)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all input there is, into a Parquet table in the shared folder."""
    spark, path = stream.sparkSession, shared_folder(stream.sparkSession, name)
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write rows to a table in the shared folder and read it again: a cut in the lineage that outlives executors, for
    rows that are read more than once. The table stays as long as the folder does."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
