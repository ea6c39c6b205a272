"""What the operators need from the cluster: storage that all executors share, and this package on them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.shipping import ship
from ..functions.storage import shared_dir

__all__ = ["qualified", "scratch_path", "shared_dir", "ship", "stored", "table"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = qualified(spark, f"{shared_dir(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI: without a scheme it is one of Hadoop's default file system, on the driver and on executors alike."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, and gives AQE true sizes."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
