"""Replaying stored payloads through every registered parser version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .normalize import GOLDEN_FIELDS, golden, normalize
from .registry import Registry


def replay_rows(corpus: DataFrame, registry: Registry) -> DataFrame:
    """One row per stored payload and version of its provider, with its outcome.

    Each payload becomes a VARIANT once and is read once per version, inside a scan; nothing is shuffled.
    ``ok`` means equal to what was read at ingest, ``drift`` that another value came
    out, ``throw`` that the version refuses the payload.
    """
    parsed = corpus.withColumn("_doc", F.expr("try_parse_json(payload)"))
    stored = parsed.select(
        "seq",
        "received_at",
        "provider",
        F.explode(F.expr(registry.version_list())).alias("version"),
        "payload",
        "_doc",
        golden().alias("golden"),
    )
    candidate = normalize(stored, registry).withColumn("candidate", golden())
    refused = F.col("parse_reasons") != ""
    same = F.col("candidate").eqNullSafe(F.col("golden"))
    outcome = F.when(refused, "throw").when(same, "ok").otherwise("drift")
    return candidate.select(
        "seq", "provider", "version", outcome.alias("outcome"), "parse_reasons", "golden", "candidate"
    )


def replay_matrix(rows: DataFrame, registry: Registry) -> DataFrame:
    """Counts and status per provider and version; empty cells show zeros.

    Counts are partial aggregates, so only a few rows per task are shuffled.
    """
    counts = rows.groupBy("provider", "version").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("outcome") == "ok").alias("ok"),
        F.count_if(F.col("outcome") == "drift").alias("drift"),
        F.count_if(F.col("outcome") == "throw").alias("throw"),
        F.array_sort(F.collect_set(F.when(F.col("parse_reasons") != "", F.col("parse_reasons")))).alias("throw_reasons"),
    )
    cells = registry.frame(rows.sparkSession).select("provider", "version")
    filled = cells.join(counts, ["provider", "version"], "left").fillna(0, ["total", "ok", "drift", "throw"])
    status = F.when(F.col("throw") > 0, "red").when(F.col("drift") > 0, "amber").otherwise("green")
    return filled.withColumn("status", status).withColumn(
        "throw_reasons", F.coalesce("throw_reasons", F.array().cast("array<string>"))
    )


def replay_failures(rows: DataFrame, corpus: DataFrame, limit: int = 8) -> DataFrame:
    """The first refused payloads per provider, by version and received order.

    ``payload`` is the payload's zero-based position in the provider's corpus.
    """
    order = Window.partitionBy("provider").orderBy("version", "seq")
    first = (
        rows.filter("outcome = 'throw'")
        .withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") <= limit)
        .select("provider", "version", "seq", F.col("golden.cost_value").alias("expected"), "parse_reasons")
    )
    # Read twice below; a replay parses every stored payload.
    first = cut(first, "first_refused")
    # At most `limit` positions per provider: the stored payloads before each are counted
    # where they are, without ranking the corpus.
    sought = first.groupBy("provider").agg(F.array_sort(F.collect_set("seq")).alias("seqs"))
    before = F.array(*(F.count_if(F.col("seq") < F.get("seqs", F.lit(i))) for i in range(limit)))
    counted = (
        corpus.select("provider", "seq")
        .join(F.broadcast(sought), "provider")
        .groupBy("provider")
        .agg(F.first("seqs").alias("seqs"), before.alias("payloads"))
    )
    positions = counted.select("provider", F.inline(F.arrays_zip(F.col("seqs").alias("seq"), F.col("payloads").alias("payload"))))
    return first.join(positions.filter("seq is not null"), ["provider", "seq"]).select(
        "provider",
        "payload",
        "version",
        "expected",
        F.lit(None).cast("double").alias("actual"),
        F.col("parse_reasons").alias("reason"),
    )


def regressions(before: DataFrame, after: DataFrame, changed_provider: str | None = None) -> DataFrame:
    """Cells that differ between two replay matrices, and cells of either that throw.

    ``changed_provider`` is the one whose parser changed on purpose: its cells may
    differ, but must not throw.
    """
    measures = ["total", "ok", "drift", "throw", "status"]

    def side(matrix: DataFrame, name: str) -> DataFrame:
        return matrix.select("provider", "version", F.struct(*measures).alias(name))

    both = side(before, "before").join(side(after, "after"), ["provider", "version"], "full")
    differs = ~F.col("before").eqNullSafe(F.col("after"))
    if changed_provider is not None:
        differs = differs & (F.col("provider") != changed_provider)
    throws = F.coalesce(F.col("after.throw") > 0, F.lit(False))
    return both.withColumns({"differs": differs, "throws": throws}).filter("differs or throws")


def provider_replay(matrix: DataFrame) -> DataFrame:
    """Per provider: stored payloads, refusals over all versions, and the verdict."""
    sums = matrix.groupBy("provider").agg(
        F.max("total").alias("historical"), F.sum("throw").cast("bigint").alias("regressions")
    )
    return sums.withColumn("status", F.when(F.col("regressions") > 0, "failed").otherwise("passed"))


def replay_summary(matrix: DataFrame) -> DataFrame:
    """The run as a whole: cells, outcomes, and how many payloads are stored."""
    outcomes = ["ok", "drift", "throw"]
    per_provider = matrix.groupBy("provider").agg(
        F.count("*").alias("cells"), F.max("total").alias("stored"), *[F.sum(o).alias(o) for o in outcomes]
    )
    return per_provider.agg(
        F.sum("cells").cast("bigint").alias("cells"),
        *[F.sum(o).cast("bigint").alias(o) for o in outcomes],
        F.sum("stored").cast("bigint").alias("corpus_size"),
    )


def replay_grid(matrix: DataFrame, versions: list[int]) -> DataFrame:
    """Providers by versions, each cell as its status."""
    grid = matrix.groupBy("provider").pivot("version", versions).agg(F.first("status"))
    for version in versions:
        grid = grid.withColumnRenamed(str(version), f"v{version}")
    return grid


def replay_diff(rows: DataFrame) -> DataFrame:
    """Per payload and version, which canonical fields differ from ingest."""
    changed = F.array(
        *[
            F.when(~F.col(f"golden.{f}").eqNullSafe(F.col(f"candidate.{f}")), F.lit(f))
            for f in GOLDEN_FIELDS
        ]
    )
    return rows.select(
        "seq", "provider", "version", "outcome",
        F.filter(changed, lambda c: c.isNotNull()).alias("changed"),
    )
