"""What the operators share: shared scratch tables, document loading and Arrow iteration."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python helper holds as Python objects at a time.
SLICE = 256
#: Most rows and bytes of an Arrow batch. Texts are long: Spark's 10,000 rows would be held several times over by each task.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


_temporary: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Sets the size of Arrow batches of a session; registered queries and pipeline stages call it, operators leave the session as it is."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The application's folder in spark.checkpoint.dir, which all executors share; in local mode a temporary one will do where that is unset."""
    app, found = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _temporary.get(app) or _temporary.setdefault(app, tempfile.mkdtemp(prefix="spark-ocularis-"))
    return f"{found.rstrip('/')}/{app}"


def scratch(spark: SparkSession, what: str) -> str:
    """A path below the application's folder that no other call gets."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes all work tables, shards and archives of the application; results that weren't collected or written are lost with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, read back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: references inside a lambda would recompute it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fixed(df: DataFrame, *columns: Column | str) -> DataFrame:
    """df.select of columns as a step of its own: the optimiser neither merges it into later ones nor pushes filters below it."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def rows(batches, *columns: str) -> Iterator[list[tuple]]:
    """Lists of at most SLICE tuples of the columns of Arrow record batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield list(zip(*(part.column(c).to_pylist() for c in columns), strict=True))


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow; see prepare for the size of batches."""
    return df.mapInArrow(function, schema)
