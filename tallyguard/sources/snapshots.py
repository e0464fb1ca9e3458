"""Tables that grow by one folder per batch, and the commit that makes a batch visible.

A batch writes ``<table>/v=<batch>/`` for each of its tables and, last, one row to
``commits/v=<batch>/``.  Readers start from the commits, so a batch is seen with all of its tables
or not at all.  Writing a batch again before its commit replaces its own folders only.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import COMPRESSION


def committed(spark: SparkSession, root: str, before: int | None = None) -> list[int]:
    """Batches whose commit is complete, in order, optionally only those before a batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/commits/v=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    batches = sorted(int(re.search(r"/v=(\d+)/", str(status.getPath().toString())).group(1)) for status in found)
    return [b for b in batches if before is None or b < before]


def publish(df: DataFrame, table: str, batch: int) -> None:
    """Write one batch of a table."""
    df.write.mode("overwrite").parquet(f"{table}/v={batch}", compression=COMPRESSION)


def read_batches(spark: SparkSession, table: str, schema: str, batches: list[int]) -> DataFrame:
    """The rows of some batches of a table."""
    parsed = StructType.fromDDL(schema)
    paths = [f"{table}/v={b}" for b in batches]
    return spark.read.schema(parsed).parquet(*paths) if paths else spark.createDataFrame([], parsed)
