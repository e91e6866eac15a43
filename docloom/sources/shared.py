"""The folder that the driver and all executors see, for tables that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or what the context was given; a temporary folder only where everything runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def place(spark: SparkSession, what: str) -> str:
    """A new path in that folder, which is deleted when the driver ends."""
    path = f"{folder(spark)}/docloom-{what}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


_once: dict[tuple, str] = {}


def once(spark: SparkSession, what: str, key: str, write) -> str:  # noqa: ANN001
    """The path of what write(path) writes, written once for each session and key."""
    name = (spark.sparkContext.applicationId, what, key)
    if name not in _once:
        path = place(spark, what)
        write(path)
        _once[name] = path
    return _once[name]


def stored(df: DataFrame, what: str, key: str) -> DataFrame:
    """df, written once for each session and key and read back."""
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(once(spark, what, key, lambda path: df.write.parquet(path)))


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written and read back: what several tables are made of is worked out once."""
    path = place(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
