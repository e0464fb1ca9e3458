"""Ordered work over a long group without a single-task window.

A plain window over a provider's rows would put them all in one task.  Here rows are
cut into buckets by the high bits of their sequence number, so a bucket holds at most
``2**BUCKET_BITS`` distinct positions; bucket totals are accumulated on their own,
and each row adds what came before its bucket to the running total inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, small_enough

BUCKET_BITS = 16
# Bucket rows one window task may order; above it totals are bucketed once more.
MAX_WINDOW_ROWS = 4_000_000


def with_bucket(df: DataFrame, seq: str, bits: int = BUCKET_BITS) -> DataFrame:
    return df.withColumn("_bucket", F.expr(f"shiftright({seq}, {bits})"))


def totals_before(buckets: DataFrame, group: str, measures: list[str], max_rows: int = MAX_WINDOW_ROWS) -> DataFrame:
    """Per (group, _bucket) row, the sums of all earlier buckets of the group.

    ``buckets`` has one row per (group, _bucket) and should be cheap to re-read.
    """
    earlier = [f"_before_{m}" for m in measures]
    if small_enough(buckets, max_rows):
        order = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = [F.coalesce(F.sum(m).over(order), F.lit(0)).alias(e) for m, e in zip(measures, earlier)]
        return buckets.select(group, "_bucket", *sums)

    wide = buckets.withColumn("_outer", F.expr(f"shiftright(_bucket, {BUCKET_BITS})"))
    outer = wide.groupBy(group, F.col("_outer").alias("_bucket")).agg(*[F.sum(m).alias(m) for m in measures])
    outer_before = totals_before(cut(outer, "outer_buckets"), group, measures, max_rows)
    inside = Window.partitionBy(group, "_outer").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    inner = wide.select(
        group, "_bucket", "_outer", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_in_{m}") for m in measures]
    )
    joined = inner.join(outer_before.withColumnRenamed("_bucket", "_outer"), [group, "_outer"])
    return joined.select(
        group, "_bucket", *[(F.col(f"_in_{m}") + F.col(e)).alias(e) for m, e in zip(measures, earlier)]
    )


def ranked(
    df: DataFrame,
    group: str,
    seq: str,
    name: str = "rank",
    tiebreak: tuple[Column, ...] = (),
    max_rows: int = MAX_WINDOW_ROWS,
) -> DataFrame:
    """Add the 1-based position of each row within its group, ordered by ``seq``.

    ``df`` is read twice, so it should be cheap to re-read.
    """
    bucketed = with_bucket(df, seq)
    sizes = cut(bucketed.groupBy(group, "_bucket").agg(F.count("*").alias("n")), "bucket_sizes")
    before = totals_before(sizes, group, ["n"], max_rows)
    inside = Window.partitionBy(group, "_bucket").orderBy(seq, *tiebreak)
    return (
        bucketed.withColumn("_in_bucket", F.row_number().over(inside))
        .join(before, [group, "_bucket"])
        .withColumn(name, F.col("_before_n") + F.col("_in_bucket"))
        .drop("_in_bucket", "_before_n", "_bucket")
    )


def running_totals(deltas: DataFrame, group: str, seq: str, measures: list[str], max_rows: int = MAX_WINDOW_ROWS) -> DataFrame:
    """Replace each measure by its running total up to and including ``seq``.

    Rows that share a sequence number all show the total after the last of them.
    ``deltas`` is read twice, so it should be cheap to re-read.
    """
    bucketed = with_bucket(deltas, seq)
    sums = cut(
        bucketed.groupBy(group, "_bucket").agg(*[F.sum(m).alias(m) for m in measures]), "bucket_totals"
    )
    before = totals_before(sums, group, measures, max_rows)
    inside = Window.partitionBy(group, "_bucket").orderBy(seq).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        bucketed.withColumns({m: F.sum(m).over(inside) for m in measures})
        .join(before, [group, "_bucket"])
        .withColumns({m: F.col(m) + F.col(f"_before_{m}") for m in measures})
        .drop("_bucket", *[f"_before_{m}" for m in measures])
    )


def in_ranges(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` written in order, dealt by range, with the number of each row's range as ``_range``.

    A group of rows that follow each other lies in as many ranges as its size asks for, whatever
    the distances of its positions, so a window over (group, ``_range``) is never one task's work
    for a hot group.  Summaries of (group, ``_range``) are at most one row per group and task.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(placed.withColumn("_range", F.spark_partition_id()), name)


def _last_before(buckets: DataFrame, group: list[str], max_rows: int) -> DataFrame:
    """Per (group, _bucket) row, the last ``_state`` of all earlier buckets of the group."""
    longest = buckets.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if longest <= max_rows:
        order = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        return buckets.select(*group, "_bucket", F.last("_state", ignorenulls=True).over(order).alias("_carried"))
    wide = buckets.withColumn("_outer", F.expr(f"shiftright(_bucket, {BUCKET_BITS})"))
    outer = wide.groupBy(*group, F.col("_outer").alias("_bucket")).agg(
        F.max_by("_state", F.when(F.col("_state").isNotNull(), F.col("_bucket"))).alias("_state")
    )
    before = _last_before(cut(outer, "outer_states"), group, max_rows)
    inside = Window.partitionBy(*group, "_outer").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    inner = wide.select(*group, "_bucket", "_outer", F.last("_state", ignorenulls=True).over(inside).alias("_in"))
    joined = inner.join(before.withColumnsRenamed({"_bucket": "_outer", "_carried": "_before"}), [*group, "_outer"])
    return joined.select(*group, "_bucket", F.coalesce("_in", "_before").alias("_carried"))


def as_of(
    states: DataFrame, probes: DataFrame, group: list[str], seq: str, columns: list[str], max_rows: int = MAX_WINDOW_ROWS
) -> DataFrame:
    """Each probe with ``columns`` of the latest state of its group at or before ``seq``.

    States and probes meet inside buckets of positions; what holds at the start of a bucket comes
    from the last states of the buckets before it.  NULL where no state precedes the probe.  Both
    sides are read twice, so they should be cheap to re-read.
    """
    state = F.struct(*columns)
    rows = with_bucket(
        states.select(*group, seq, state.alias("_state")).unionByName(
            probes.select(*group, seq, F.struct(*probes.columns).alias("_probe")), allowMissingColumns=True
        ),
        seq,
    )
    ends = cut(
        rows.groupBy(*group, "_bucket").agg(
            F.max_by("_state", F.when(F.col("_state").isNotNull(), F.col(seq))).alias("_state")
        ),
        "bucket_states",
    )
    # States come before probes of the same position.
    inside = Window.partitionBy(*group, "_bucket").orderBy(seq, F.col("_probe").isNotNull())
    seen = rows.withColumn("_seen", F.last("_state", ignorenulls=True).over(inside)).filter("_probe is not null")
    joined = seen.join(_last_before(ends, group, max_rows), [*group, "_bucket"])
    held = joined.withColumn("_held", F.coalesce("_seen", "_carried"))
    return held.select("_probe.*", *[F.col("_held")[c].alias(c) for c in columns])
