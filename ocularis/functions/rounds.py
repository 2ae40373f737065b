"""Work tables of iterative operators: each round's small result is written to the folder that all executors share, so the lineage stays short."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_temporary: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The application's folder in spark.checkpoint.dir; in local mode a temporary one will do where that is unset."""
    app, found = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _temporary.get(app) or _temporary.setdefault(app, tempfile.mkdtemp(prefix="spark-ocularis-"))
    return f"{found.rstrip('/')}/{app}"


class Table:
    """A written work table: df reads it, drop() deletes its files."""

    def __init__(self, df: DataFrame, what: str) -> None:
        self.spark = df.sparkSession
        self.path = f"{folder(self.spark)}/{what}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes all work tables of the application; results that weren't collected or written are lost with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
