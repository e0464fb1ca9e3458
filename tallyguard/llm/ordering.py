"""Places of rows in a distributed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def numbered(df: DataFrame, group: list[str], order: list[str | Column], name: str = "idx") -> DataFrame:
    """``df`` with its place (from 0) inside its group as ``name`` and the group's rows as ``n``.

    The rows are dealt by range over group and order, so a group with a large part of all rows
    lies in many tasks; rows that tie completely are spread by where they were read.  Null is a
    group like any other and comes first.  The result reads a written table: places do not change
    when a task runs again.
    """
    sort = [*group, *order, "_salt"]
    placed = cut(
        df.withColumn("_salt", F.monotonically_increasing_id())
        .repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .drop("_salt")
        # The number of the task and the place in it: increasing over the whole order.
        .withColumn("_at", F.monotonically_increasing_id()),
        "placed",
    ).withColumn("_part", F.shiftright("_at", 33))
    # One row per group and task.
    spans = cut(
        placed.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows")), "spans"
    )
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        *[F.col(c).alias(f"_{c}") for c in group],
        F.col("_part").alias("_span"),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(whole).alias("n"),
    )
    same = F.col("_part") == F.col("_span")
    for column in group:
        same &= F.col(column).eqNullSafe(F.col(f"_{column}"))
    return (
        placed.join(spans, same)
        .withColumn(name, F.col("_at") + F.col("_shift"))
        .select(*df.columns, name, "n")
    )
