"""Reports over the event table: health, spend, field population."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import exact_sums
from .registry import PROVIDERS, Registry

# The fields of the population trace and the columns behind them.
VITAL_FIELDS = {
    "model": "model",
    "input_tokens": "input_tokens",
    "output_tokens": "output_tokens",
    "cost.amount_usd": "cost_amount_usd",
}
VITAL_WINDOW, VITAL_RECENT = 40, 20
ALIVE_RATE, DARK_RATE = 0.9, 0.1
HEALTHY_INTEGRITY = 99.0


def recent_events(events: DataFrame, limit: int = 50) -> DataFrame:
    """The latest events by first arrival; each task keeps its own best rows only."""
    return events.orderBy(F.col("ingested_at").desc(), F.col("first_seq").desc()).limit(limit)


def provider_health(events: DataFrame) -> DataFrame:
    return events.groupBy("provider").agg(
        F.count("*").alias("events"),
        F.max("parser_version").alias("parser_version"),
        F.max("ingested_at").alias("last_ingest"),
        F.max("occurred_at").alias("last_occurred"),
        F.count_if(F.col("cost_amount_usd").isNull()).alias("missing_cost"),
    )


def provider_versions(health: DataFrame, registry: Registry) -> DataFrame:
    """Health with the registered versions and the one that parses now."""
    return health.withColumn("registered_versions", F.expr(registry.version_list())).withColumn(
        "live_version", F.expr(f"coalesce(array_max({registry.version_list()}), parser_version)")
    )


def weekly(
    df: DataFrame,
    group: str = "provider",
    time: str = "occurred_at",
    amount: str = "cost_amount_usd",
    total: str = "cost_usd",
    count: str = "events",
) -> DataFrame:
    """Sum and row count per group and Monday-based week.

    Decimals are summed before the cast and doubles exactly, so the result does not depend on row
    order.
    """
    weeks = df.withColumn("week", F.date_trunc("week", time).cast("date"))
    if dict(df.dtypes)[amount] == "double":
        sums = exact_sums(weeks, [group, "week"], amount, total, count)
        return sums.withColumn(total, F.coalesce(total, F.lit(0.0)))
    return weeks.groupBy(group, "week").agg(
        F.coalesce(F.sum(amount), F.lit(0)).cast("double").alias(total), F.count("*").alias(count)
    )


def missing_cost(events: DataFrame) -> DataFrame:
    return events.groupBy("provider").agg(F.count_if(F.col("cost_amount_usd").isNull()).alias("missing_cost"))


def cost_integrity(events: DataFrame) -> DataFrame:
    """Share of events that have a cost, over all providers."""
    totals = events.agg(
        F.count("*").alias("events"), F.count_if(F.col("cost_amount_usd").isNull()).alias("missing_cost")
    )
    share = F.when(
        F.col("events") > 0, (F.lit(1.0) - F.col("missing_cost") / F.col("events")) * 100
    ).otherwise(F.lit(100.0))
    return totals.withColumn("integrity", share).withColumn("healthy", F.col("integrity") >= HEALTHY_INTEGRITY)


def weekly_grid(weekly_rows: DataFrame, providers: tuple[str, ...] = PROVIDERS) -> DataFrame:
    """Weeks by providers with zeros for gaps, the overall total and the largest cell.

    Runs over the weekly report, whose size is weeks times providers.
    """
    total = exact_sums(weekly_rows, [], "cost_usd", "total").select("total").scalar()
    largest = weekly_rows.agg(F.greatest(F.max("cost_usd"), F.lit(0.0001))).scalar()
    grid = weekly_rows.groupBy("week").pivot("provider", list(providers)).agg(F.sum("cost_usd")).fillna(0.0)
    return grid.withColumns({"total_usd": total, "max_cell": largest})


def last_flags(
    events: DataFrame,
    fields: dict[str, str],
    group: str = "provider",
    order: tuple[str, ...] = ("first_seq",),
    window: int = VITAL_WINDOW,
    recent: int = VITAL_RECENT,
) -> DataFrame:
    """Per group and field, populated flags of the last rows, oldest first, and their rate.

    Rows beyond the window are dropped before the shuffle, so a group costs at most
    ``window`` rows per task however large it is.
    """
    latest = Window.partitionBy(group).orderBy(*[F.col(o).desc() for o in order])
    kept = events.withColumn("_rn", F.row_number().over(latest)).filter(F.col("_rn") <= window)
    flags = kept.select(
        group,
        "_rn",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("field"), F.col(column).isNotNull().cast("int").alias("flag"))
                    for name, column in fields.items()
                ]
            )
        ),
    )
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("_rn")).alias("at"), "flag")))
    return flags.groupBy(group, "field").agg(
        F.transform(ordered, lambda s: s["flag"]).alias("series"),
        F.avg(F.when(F.col("_rn") <= recent, F.col("flag"))).alias("rate"),
    )


def field_vitals(events: DataFrame, window: int = VITAL_WINDOW) -> DataFrame:
    """Population trace of each provider's fields with a state."""
    state = (
        F.when(F.col("rate") >= ALIVE_RATE, "alive").when(F.col("rate") <= DARK_RATE, "dark").otherwise("warn")
    )
    return last_flags(events, VITAL_FIELDS, window=window).withColumn("state", state)


def dark_providers(vitals: DataFrame) -> DataFrame:
    """Whether any field of a provider is dark, and the provider to show first."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PROVIDERS]), F.col("provider"))
    flags = vitals.groupBy("provider").agg(F.bool_or(F.col("state") == "dark").alias("any_dark"))
    # One row per provider.
    order = Window.orderBy(~F.col("any_dark"), rank)
    return flags.withColumn("focus", F.row_number().over(order) == 1)


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count_if(F.col("severity") == "critical").alias("critical"), F.count("*").alias("total")
    )
