"""Arrivals: one row per delivered payload, in a total order given by ``seq``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARRIVALS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("provider", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("payload", T.StringType()),
    ]
)


def read_arrivals(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Arrivals from JSON lines, Parquet, or any format the session can read."""
    return spark.read.schema(ARRIVALS).format(fmt).load(path)


def stream_arrivals(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """The same rows as an unbounded table."""
    return (
        spark.readStream.schema(ARRIVALS)
        .format(fmt)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )


def as_arrivals(df: DataFrame) -> DataFrame:
    """Any table with seq, received_at, provider and payload, given the arrival types."""
    if "version" not in df.columns:
        df = df.withColumn("version", F.lit(None).cast("int"))
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ARRIVALS.fields])
