"""Folding arrivals into one row per event, and exact-content deduplication.

An event's identity comes from its first arrival, its token counts and cost from the
last arrival that has them, and its pointers (raw payload, parser version) from the
last arrival.  All of that is plain aggregation.  The revision counter is not: it
depends on the order of the values.  It is a prefix scan: arrivals are dealt in ranges of
(key, position), each range is summarized, and the summaries of a key are merged, so that
one key holding a large part of all rows is spread over many tasks.  The same summaries, one
per batch, are what a continuous ingest appends and merges on read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, small_enough
from .normalize import with_event_id
from .prefix import in_ranges

VALUES = ("input_tokens", "output_tokens", "cost_amount_usd")
IDENTITY = ("occurred_at_text", "occurred_at", "event_type", "model", "raw_user_id")
POINTERS = ("content_hash", "parser_version", "shape_key")

EVENT_COLUMNS = (
    "event_id",
    "dedup_key",
    "provider",
    "parser_version",
    "raw_payload_id",
    *IDENTITY,
    *VALUES,
    "revision",
    "ingested_at",
    "first_seq",
    "last_seq",
    "shape_key",
    "content_hash",
    *[f"{c}_seq" for c in VALUES],
)


def _first(column: str, by: str = "seq") -> Column:
    return F.min_by(column, by)


def _last(column: str, by: str = "seq") -> Column:
    return F.max_by(column, by)


def _last_present(column: str, by: str = "seq") -> Column:
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(by)))


def _by_key(accepted: DataFrame, *measures: Column) -> DataFrame:
    """Aggregate per event; keys and hashes travel as bytes, half the size of their hex texts."""
    grouped = accepted.groupBy(F.unhex("dedup_key").alias("_key"), "provider").agg(*measures)
    return grouped.withColumn("dedup_key", F.lower(F.hex("_key"))).drop("_key")


def _fold_measures() -> list[Column]:
    return [
        *[_first(c).alias(c) for c in IDENTITY],
        _first("received_at").alias("ingested_at"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        *[_last_present(c).alias(c) for c in VALUES],
        *[F.min(F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"{c}_seq") for c in VALUES],
        F.lower(F.hex(F.max_by(F.unhex("content_hash"), "seq"))).alias("content_hash"),
        *[_last(c).alias(c) for c in POINTERS if c != "content_hash"],
    ]


def fold_events(accepted: DataFrame) -> DataFrame:
    """One row per event without its revision: a single hash aggregation.

    Unused columns are pruned from the aggregation, so a report over a few of them
    shuffles only those.
    """
    return _by_key(accepted, *_fold_measures())


def fold_presence(accepted: DataFrame) -> DataFrame:
    """One row per event with, in place of each measured field, 1 if it is populated.

    Enough for population reports, and made of fixed-width values only, so it is a
    hash aggregation where the full fold sorts.
    """
    def kept(column: str) -> Column:
        return F.when(F.col(column).isNotNull(), F.lit(1))

    return _by_key(
        accepted,
        F.min("seq").alias("first_seq"),
        *[F.min_by(kept(c), "seq").alias(c) for c in ("model", "raw_user_id")],
        *[F.max(kept(c)).alias(c) for c in VALUES],
        *[F.min(F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"{c}_seq") for c in VALUES],
    )


# --- the order-dependent part ----------------------------------------------------------
#
# A run is a set of arrivals of one key that follow each other.  Its summary holds, per value,
# the first value of the run (``head_``), where it stands (``head_seq_``, NULL once its row is
# counted as a change), the last value, and the number of changes inside the run.  Whether a
# head is a change depends on what came before the run; everything else is settled.  Summaries
# of neighbouring runs merge into one, in any grouping, so runs may be ranges of a batch,
# batches, or whole stored histories.

SUMMARY_COLUMNS = (
    "dedup_key",
    "provider",
    *IDENTITY,
    "ingested_at",
    "first_seq",
    "last_seq",
    "changes",
    *[f"head_{c}" for c in VALUES],
    *[f"head_seq_{c}" for c in VALUES],
    *VALUES,
    *[f"{c}_seq" for c in VALUES],
    *POINTERS,
)


def _segmented(rows: DataFrame) -> DataFrame:
    """Arrivals with, per value, the last present value before them in their range of the order."""
    segment = Window.partitionBy("dedup_key", "_range").orderBy("seq")
    earlier = segment.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_prev_{c}": F.last(c, ignorenulls=True).over(earlier) for c in VALUES})
    changed = reduce(
        lambda a, b: a | b, [F.coalesce(F.col(c) != F.col(f"_prev_{c}"), F.lit(False)) for c in VALUES]
    )
    heads = {f"_head_{c}": F.col(c).isNotNull() & F.col(f"_prev_{c}").isNull() for c in VALUES}
    return rows.withColumns({"_changed": changed, **heads})


def _segments(segmented: DataFrame) -> DataFrame:
    """One summary per key and range, of the values only."""
    def head(c: str) -> Column:
        return F.min_by(c, F.when(F.col(f"_head_{c}"), F.col("seq")))

    # Grouping by the window's own columns reuses its order.
    return segmented.groupBy("dedup_key", "_range").agg(
        F.min("seq").alias("first_seq"),
        F.count_if("_changed").alias("changes"),
        *[head(c).alias(f"head_{c}") for c in VALUES],
        # NULL where the row of the first value already counts as a change.
        *[F.min(F.when(F.col(f"_head_{c}") & ~F.col("_changed"), F.col("seq"))).alias(f"head_seq_{c}") for c in VALUES],
        *[_last_present(c).alias(c) for c in VALUES],
    )


def _with_entry(runs: DataFrame) -> DataFrame:
    """Runs with the values on entry: the last present ones of the key's earlier runs."""
    key = Window.partitionBy("dedup_key").orderBy("first_seq")
    earlier = key.rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumns(
        {
            **{f"entry_{c}": F.last(c, ignorenulls=True).over(earlier) for c in VALUES},
            "_opens": F.row_number().over(key) == 1,
        }
    )


def _rows_of(heads: list[Column]) -> Column:
    """Positions of heads that are changes; a row that sets several values is one change."""
    return F.array_distinct(F.filter(F.array(*heads), lambda s: s.isNotNull()))


def _settled(c: str) -> Column:
    """The head's position if what came before proves it a change."""
    return F.when(F.col(f"head_{c}") != F.col(f"entry_{c}"), F.col(f"head_seq_{c}"))


def _merged_values(runs: DataFrame) -> DataFrame:
    """Values, heads and changes of neighbouring runs as those of one run."""
    entered = _with_entry(runs).withColumn("_settled", _rows_of([_settled(c) for c in VALUES]))

    def still_open(c: str) -> Column:
        free = F.col(f"entry_{c}").isNull() & ~F.array_contains("_settled", F.col(f"head_seq_{c}"))
        return F.when(free, F.col(f"head_seq_{c}"))

    return entered.groupBy("dedup_key").agg(
        F.sum(F.col("changes") + F.size("_settled")).alias("changes"),
        *[F.min_by(f"head_{c}", F.when(F.col(f"head_{c}").isNotNull(), F.col("first_seq"))).alias(f"head_{c}") for c in VALUES],
        *[F.max(still_open(c)).alias(f"head_seq_{c}") for c in VALUES],
        *[_last_present(c, "first_seq").alias(c) for c in VALUES],
        *_others(runs),
    )


def _others(runs: DataFrame) -> list[Column]:
    """What is plain aggregation, of the columns that the runs have."""
    if "last_seq" not in runs.columns:
        return []
    return [
        *[_first(c, "first_seq").alias(c) for c in ("provider", *IDENTITY, "ingested_at")],
        F.min("first_seq").alias("first_seq"),
        F.max("last_seq").alias("last_seq"),
        *[F.min(f"{c}_seq").alias(f"{c}_seq") for c in VALUES],
        *[_last(c, "last_seq").alias(c) for c in POINTERS],
    ]


# Hashes of repeated keys that are broadcast; more are joined by a shuffle.
MAX_REPEATED = 2_000_000


def _key_hash() -> Column:
    return F.xxhash64("dedup_key").alias("_hash")


def _repeated(rows: DataFrame) -> DataFrame:
    """Hashes of the keys with more than one row: a count over the key column.

    A key that shares its hash with another is among them, which costs its rows a detour and changes no result.
    """
    return rows.groupBy(_key_hash()).agg(F.count("*").alias("_n")).filter("_n > 1").select("_hash")


def _parted(rows: DataFrame, several: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of keys that are not in ``several(_hash)``, a stored table, and of those that are."""
    several = F.broadcast(several) if small_enough(several, MAX_REPEATED) else several
    hashed = rows.select("*", _key_hash())
    return tuple(hashed.join(several, "_hash", how).drop("_hash") for how in ("left_anti", "left_semi"))


def summaries(accepted: DataFrame) -> DataFrame:
    """One run per key over all of ``accepted``, which should be cheap to re-read.

    Most keys arrive once: their summary is their row, and they are not shuffled while the others are few.  Only
    the values of the others are put in order, in ranges of (key, position), and the ranges of a key are merged.
    """
    once, several = _parted(accepted, cut(_repeated(accepted), "several"))
    seen = {c: F.when(F.col(c).isNotNull(), F.col("seq")) for c in VALUES}
    single = once.select(
        "*",
        F.col("received_at").alias("ingested_at"),
        F.col("seq").alias("first_seq"),
        F.col("seq").alias("last_seq"),
        F.lit(0).cast("bigint").alias("changes"),
        *[F.col(c).alias(f"head_{c}") for c in VALUES],
        *[at.alias(name) for c, at in seen.items() for name in (f"head_seq_{c}", f"{c}_seq")],
    )
    return single.select(*SUMMARY_COLUMNS).unionByName(_folded_runs(several))


def _folded_runs(accepted: DataFrame) -> DataFrame:
    """:func:`summaries` of keys that arrive several times."""
    alone = [
        F.lit(0).cast("bigint").alias("_changes"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"head_{c}") for c in VALUES],
    ]
    folded = _by_key(accepted, *_fold_measures(), *alone)
    ordered = in_ranges(accepted.select("dedup_key", "seq", *VALUES), ["dedup_key", "seq"], "repeated_arrivals")
    scanned = _merged_values(_segments(_segmented(ordered))).select(
        "dedup_key",
        F.col("changes").alias("_scanned"),
        *[F.col(f"head_seq_{c}").alias(f"_at_{c}") for c in VALUES],
    )
    found = F.col("_scanned").isNotNull()
    return (
        folded.join(scanned, "dedup_key", "left")
        .withColumns(
            {
                "changes": F.coalesce("_scanned", "_changes"),
                **{f"head_seq_{c}": F.when(found, F.col(f"_at_{c}")).otherwise(F.col(f"{c}_seq")) for c in VALUES},
            }
        )
        .select(*SUMMARY_COLUMNS)
    )


def merge_summaries(runs: DataFrame) -> DataFrame:
    """One run per key from any number of neighbouring ones."""
    return _merged_values(runs).select(*SUMMARY_COLUMNS)


def events_from(runs: DataFrame) -> DataFrame:
    """The event table of keys whose one run holds all of their arrivals.

    The first arrival is no change; later first values are.
    """
    late = [F.when(F.col(f"head_seq_{c}") != F.col("first_seq"), F.col(f"head_seq_{c}")) for c in VALUES]
    revision = (F.col("changes") + F.size(_rows_of(late)) + 1).cast("int")
    events = with_event_id(runs.withColumn("revision", revision))
    return with_event_id(events, "content_hash", "raw_payload_id").select(*EVENT_COLUMNS)


def events_table(accepted: DataFrame) -> DataFrame:
    """The full event table, revision included; ``accepted`` should be cheap to re-read."""
    return events_from(summaries(accepted))


def as_run(existing: DataFrame) -> DataFrame:
    """Events as the opening runs of their keys."""
    return existing.withColumns(
        {
            "changes": (F.col("revision") - 1).cast("bigint"),
            **{f"head_{c}": F.col(c) for c in VALUES},
            **{f"head_seq_{c}": F.lit(None).cast("bigint") for c in VALUES},
        }
    ).select(*SUMMARY_COLUMNS)


def merge_events(existing: DataFrame, accepted: DataFrame) -> DataFrame:
    """Fold a later batch into an existing event table; both should be cheap to re-read.

    Only keys with runs on both sides are merged: a single run is its own merge.
    """
    # An existing event without a value has seen all of its past: a later first value is a change.
    runs = as_run(existing).unionByName(cut(summaries(accepted), "later_runs"))
    once, several = _parted(runs, cut(_repeated(runs), "met_again"))
    return events_from(once.unionByName(merge_summaries(several)))


def ingest_results(accepted: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Per arrival: whether it inserted the event, and the event's revision after it.

    ``existing`` is the event table before these arrivals, if there is one.  A key's only arrival
    inserts at revision 1; just the arrivals of the other keys are put in order.
    """
    slim = accepted.select("dedup_key", "provider", "seq", *VALUES)
    several = _repeated(accepted)
    touched = None
    if existing is not None:
        touched = cut(existing.join(accepted.select("dedup_key").distinct(), "dedup_key", "left_semi"), "touched")
        several = several.union(touched.select(_key_hash())).distinct()
    once, repeated = _parted(slim, cut(several, "several"))
    once = once.select(
        "seq", "provider", "dedup_key", F.lit(True).alias("inserted"), F.lit(1).alias("revision")
    )

    segmented = _segmented(in_ranges(repeated, ["dedup_key", "seq"], "in_order"))
    runs = _segments(segmented)
    if touched is not None:
        runs = as_run(touched).select(*[c for c in runs.columns if c != "_range"]).unionByName(runs, allowMissingColumns=True)
    entered = _with_entry(runs)
    opening = F.col("_opens") & F.col("_range").isNotNull()
    changed = [
        F.when(~F.col(f"head_{c}").eqNullSafe(F.col(f"entry_{c}")), F.col(f"head_seq_{c}")) for c in VALUES
    ]
    known = F.filter(_rows_of(changed), lambda s: ~(opening & (s == F.col("first_seq"))))
    # What an existing event has seen is settled.
    steps = F.col("changes") + F.when(F.col("_range").isNotNull(), F.size(known)).otherwise(0)
    before = Window.partitionBy("dedup_key").orderBy("first_seq").rowsBetween(Window.unboundedPreceding, -1)
    entry = entered.withColumn("_base", F.coalesce(F.sum(steps).over(before), F.lit(0))).filter("_range is not null")
    entry = entry.select(
        "dedup_key", "_range", "_opens", "_base", F.col("first_seq").alias("_segment_first"), *[f"entry_{c}" for c in VALUES]
    )
    rows = segmented.join(entry, ["dedup_key", "_range"])
    first = F.col("_opens") & (F.col("seq") == F.col("_segment_first"))
    head_change = reduce(
        lambda a, b: a | b,
        [F.col(f"_head_{c}") & ~F.col(c).eqNullSafe(F.col(f"entry_{c}")) for c in VALUES],
    )
    change = F.when(~first & (F.col("_changed") | head_change), 1).otherwise(0)
    inside = Window.partitionBy("dedup_key", "_range").orderBy("seq")
    ordered = rows.withColumn("inserted", first).withColumn(
        "revision", (F.lit(1) + F.col("_base") + F.sum(change).over(inside)).cast("int")
    )
    results = once.unionByName(ordered.select(*once.columns))
    return with_event_id(results).select("seq", "provider", "dedup_key", "event_id", "inserted", "revision")


def first_by_content(df: DataFrame, content: str, order: str, columns: list[str]) -> DataFrame:
    """Keep the first row per content value, with the number of copies.

    Copies collapse in the map-side aggregation, so a value with very many copies
    sends one row per input partition.
    """
    first = df.groupBy(content).agg(
        F.min(order).alias(order),
        F.count("*").alias("copies"),
        F.min_by(F.struct(*columns), order).alias("_first"),
    )
    return first.select(content, order, "copies", "_first.*")


CORPUS_FIELDS = (
    "provider",
    "received_at",
    "parser_version",
    "payload",
    "shape_key",
    "dedup_key",
    "occurred_at_text",
    "event_type",
    "model",
    "raw_user_id",
    "input_tokens",
    "output_tokens",
    "cost_value",
)


def _repeats(accepted: DataFrame) -> DataFrame:
    """Positions of rows whose content arrived before, from hashes and positions alone."""
    rows = accepted.select(F.unhex("content_hash").alias("_content"), "seq")
    several = rows.groupBy("_content").agg(F.min("seq").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    return rows.join(several, "_content").filter("seq > _first").select("seq")


def corpus_table(accepted: DataFrame, fields: tuple[str, ...] = CORPUS_FIELDS) -> DataFrame:
    """Distinct payloads in first-received form, with the canonical fields read then.

    The hash decides alone, so the same payload from a second provider is not stored.  Payloads do
    not travel to be compared: copies are found by hash and position, and are taken out of the
    rows where these are, as long as the copies are few; else payloads move once, by position.
    ``accepted`` should then be cheap to re-read.  Without the payload, rows travel with their hash.
    """
    if "payload" in fields:
        repeats = cut(_repeats(accepted), "repeats")
        return accepted.join(repeats, "seq", "left_anti").select("seq", *fields, "content_hash")
    rows = accepted.withColumn("_content", F.unhex("content_hash"))
    first = first_by_content(rows, "_content", "seq", list(fields))
    return first.withColumn("content_hash", F.lower(F.hex("_content"))).drop("copies", "_content")
