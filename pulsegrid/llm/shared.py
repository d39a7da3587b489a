"""Session helpers shared by the operators: scratch tables, checked broadcasts, tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow (id-like) side up to which it is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bounds the Arrow batches that go to Python workers by bytes, as texts differ in length by orders of magnitude."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name)).lower().removesuffix("b")
    if not now.isdigit() or int(now) > size:
        spark.conf.set(name, str(size))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.  Where that is unset, a folder of our own in local mode; on a cluster, whose machines wouldn't see it, an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="pulsegrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/pulsegrid/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by materialize() that nothing refers to any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/pulsegrid/" in path:
                delete_path(df.sparkSession, path)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcasts a materialised narrow table if its counted rows are within the bound; else the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df
