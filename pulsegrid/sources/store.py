"""A store of results that is added to in whole snapshots: readers see all of one or nothing.

Rows go to `<folder>/rows`, a folder for each snapshot; one line in `<folder>/snapshots` then makes
them visible.  What a lost or failed job left in `rows` has no line and is never read.  A newer
snapshot of the same analyzer, version and parameters takes the place of an older one for the
sources that it holds; other versions and parameters stand beside it.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SNAPSHOTS = "snapshot string, number long, analyzer string, version int, params_hash string"


def add_rows(results: DataFrame, folder: str) -> str:
    """Writes results, which need a column `source` (the content key of what they come from), and gives the snapshot's name; nobody sees them yet."""
    snapshot = uuid.uuid4().hex
    results.sortWithinPartitions("source").write.parquet(f"{folder}/rows/snapshot={snapshot}")
    return snapshot


def publish(spark: SparkSession, folder: str, snapshot: str, analyzer: str, version: int, params_hash: str = "") -> None:
    """Makes a snapshot visible by one line: the newest number wins, and of equal numbers the larger name."""
    line = spark.createDataFrame([(snapshot, time.time_ns(), analyzer, version, params_hash)], SNAPSHOTS)
    line.coalesce(1).write.mode("append").parquet(f"{folder}/snapshots")


def store(results: DataFrame, folder: str, analyzer: str, version: int, params_hash: str = "") -> str:
    snapshot = add_rows(results, folder)
    publish(results.sparkSession, folder, snapshot, analyzer, version, params_hash)
    return snapshot


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """The published snapshots; empty where nothing has been published yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(SNAPSHOTS).parquet(f"{folder}/snapshots")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], SNAPSHOTS)
        raise


def read(spark: SparkSession, folder: str, schema: str, analyzer: str, version: int, params_hash: str = "") -> DataFrame:
    """The newest published rows of each source for this analyzer, version and parameters, with the columns of `schema`; another version is a miss, not an error.

    The snapshots prune the folders of rows; which of them is a source's newest is one grouped
    aggregate of its sources, so that no source's rows are sorted.
    """
    found = snapshots(spark, folder).where((F.col("analyzer") == analyzer) & (F.col("version") == version) & (F.col("params_hash") == params_hash))
    if found.isEmpty():
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, snapshot string").option("basePath", f"{folder}/rows").parquet(f"{folder}/rows").join(found.select("snapshot", "number"), "snapshot")
    names = [c for c in rows.columns if c not in ("snapshot", "number")]
    newest = rows.groupBy("source").agg(F.max(F.struct("number", "snapshot")).alias("_newest"))
    newest = newest.select("source", F.col("_newest.snapshot").alias("snapshot"))
    return rows.join(newest, ["source", "snapshot"], "left_semi").select(*names)


def superseded(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(snapshot): published snapshots none of whose sources is newest any more; their folders can go."""
    rows = spark.read.schema(f"{schema}, snapshot string").option("basePath", f"{folder}/rows").parquet(f"{folder}/rows").select("snapshot", "source").distinct().join(snapshots(spark, folder), "snapshot")
    w = Window.partitionBy("source", "analyzer", "version", "params_hash").orderBy(F.col("number").desc(), F.col("snapshot").desc())
    ranked = rows.withColumn("_rank", F.row_number().over(w))
    return ranked.groupBy("snapshot").agg(F.min("_rank").alias("_best")).where("_best > 1").select("snapshot")
