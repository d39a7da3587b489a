"""The folder for files that the driver and all executors exchange."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir.  Where that is unset, a folder of our own in local mode; on a cluster, whose machines wouldn't see it, an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    root = tempfile.mkdtemp(prefix="pulsegrid-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: what several later steps use is computed once, and a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/pulsegrid/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
