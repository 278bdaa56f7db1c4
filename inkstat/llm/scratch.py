"""Tables written once into the shared folder of the cluster, so that a lost executor never costs the lineage behind them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else the session's checkpoint folder.

    Only a local session that names neither gets a folder of its own; on a cluster that raises,
    because a folder of the driver's machine is not seen by the executors.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def small_batches(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """Bound what one Arrow batch of texts holds in the JVM and in a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark


class Scratch:
    """A new subfolder for the intermediate tables of one call. ``drop`` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark = small_batches(spark)
        self.root = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        path_of = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for name in names:
            path = path_of(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
