"""A forensic report for every event.

Facts about a provider (its usual shape, field population, replay verdict) are computed
once, one row per provider, and broadcast; facts about an event are expressions over its
own row.  Provider tables are bounded by the registry, so the broadcasts are too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..session import cut, lookup
from .drift import SILENT_NULL, STRUCTURAL, field_stats
from .normalize import normalize, with_event_id
from .prefix import ranked
from .registry import COST_FIELD, FIELD_COLUMNS, Registry
from .reports import last_flags, missing_cost
from .shapes import dominant_shape, known_shapes, with_paths

RATE_THRESHOLD = 0.9
RECENT_LIMIT = 1 - RATE_THRESHOLD + 0.0001

# Above it, alerts reach the events by a salted join instead of a broadcast.
MAX_BROADCAST_ALERTS = 100_000

# Status names, and the texts and stages of the report.
HEALTHY, DRIFT, SILENT, REPLAY_FAILED = "Healthy", "Drift", "Silent Null", "Replay Failed"
NONE_MARK = "—"
TEXT_MOVED = "Provider moved a field: %s → %s."
TEXT_STOPPED = "%s stopped populating without a parse error."
TEXT_NO_INCIDENT = "No incident — every expected field is populating normally."
TEXT_IMPACT = "%d %s events currently missing %s."
TEXT_NO_IMPACT = "No fields missing on this event."
TEXT_UPGRADE = "Upgrade to %s parser v%d (reads the moved field)."
TEXT_NO_UPGRADE = "On the latest parser — no upgrade needed."
TEXT_REPLAY_OK = "%d historical %s payloads validate successfully."
TEXT_REPLAY_BAD = "%d regression(s) across %d historical payloads."


# --- provider facts -------------------------------------------------------------------


FAILURE = "struct<payload: bigint, version: int, expected: double, actual: double, reason: string>"


def provider_facts(
    events: DataFrame, corpus: DataFrame, matrix: DataFrame, failures: DataFrame | None = None
) -> DataFrame:
    """One row per provider with everything event reports need to know about it.

    ``failures`` are the first refused payloads of each provider, from ``replay_failures``.
    """
    shape = dominant_shape(known_shapes(corpus)).select(
        "provider",
        F.col("shape_key").alias("usual_key"),
        F.col("paths").alias("usual_all"),
        F.filter("paths", lambda p: p != "").alias("usual_paths"),
    )
    rates = (
        field_stats(events)
        .withColumn("historical", F.coalesce(F.try_divide("overall_populated", "overall_seen"), F.lit(1.0)))
        .withColumn("recent", F.coalesce(F.try_divide("recent_populated", "recent_seen"), F.lit(1.0)))
        .groupBy("provider")
        .agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("historical", "recent")))).alias("rates"))
    )
    series = (
        last_flags(events, FIELD_COLUMNS)
        .groupBy("provider")
        .agg(F.map_from_entries(F.collect_list(F.struct("field", "series"))).alias("field_series"))
    )
    replay = matrix.groupBy("provider").agg(
        F.max("total").alias("historical_payloads"), F.sum("throw").cast("bigint").alias("regressions")
    )
    # A provider whose payloads all arrived first from another one has events, but no stored
    # payloads: nothing is usual for it, and nothing of it was replayed.
    facts = events.select("provider").distinct()
    parts = [shape, rates, series, replay, missing_cost(events)]
    if failures is not None:
        # A few per provider.
        ordered = F.array_sort(F.collect_list(F.struct("version", "payload", "expected", "actual", "reason")))
        entry = lambda f: F.struct(*[f[n] for n in ("payload", "version", "expected", "actual", "reason")])
        parts.append(failures.groupBy("provider").agg(F.transform(ordered, entry).alias("failures")))
    for part in parts:
        facts = facts.join(F.broadcast(part), "provider", "left")
    if failures is None:
        facts = facts.withColumn("failures", F.lit(None))
    nothing = F.array().cast("array<string>")
    none = F.lit(0).cast("bigint")
    return facts.withColumns(
        {
            "usual_all": F.coalesce("usual_all", nothing),
            "usual_paths": F.coalesce("usual_paths", nothing),
            "historical_payloads": F.coalesce("historical_payloads", none),
            "regressions": F.coalesce("regressions", none),
            "failures": F.coalesce(F.col("failures").cast(f"array<{FAILURE}>"), F.array().cast(f"array<{FAILURE}>")),
        }
    )


# --- one event at a time, for all events ------------------------------------------------


def with_parser_match(events: DataFrame, registry: Registry) -> DataFrame:
    """Expected fields of the event's own parser version, split by whether they arrived."""
    empty = F.filter(
        F.array(*[F.when(F.col(column).isNull(), F.lit(field)) for field, column in FIELD_COLUMNS.items()]),
        lambda f: f.isNotNull(),
    )
    return (
        events.withColumn("expects", F.expr(registry.expected_fields()))
        .withColumn("_empty", empty)
        .withColumn("populated", F.array_except("expects", "_empty"))
        .withColumn("missing", F.array_intersect("expects", "_empty"))
        .drop("_empty")
    )


def with_shape_diff(events: DataFrame, facts: DataFrame) -> DataFrame:
    """Paths of the event's last payload against its provider's usual shape.

    Paths are read only where the shape key differs from the usual one.
    """
    usual = facts.select("provider", "usual_key", "usual_all", "usual_paths")
    joined = events.join(F.broadcast(usual), "provider", "left")
    current = F.when(F.col("shape_key").eqNullSafe(F.col("usual_key")), F.col("usual_all")).otherwise(
        F.expr(paths.paths_of_key("shape_key"))
    )
    return (
        joined.withColumn("current_paths", current)
        .withColumn("added", F.expr(paths.added_paths("current_paths", "usual_paths")))
        .withColumn("removed", F.expr(paths.removed_paths("current_paths", "usual_paths")))
        .withColumn("changed", (F.size("added") > 0) | (F.size("removed") > 0))
        .withColumnRenamed("usual_paths", "baseline_paths")
        .drop("usual_key", "usual_all")
    )


def with_silent_null(matched: DataFrame, facts: DataFrame) -> DataFrame:
    """Population analysis of the event's first missing field.

    Unlike the detector it asks for no minimum counts, counts an empty window as fully
    populated, and leaves a little room above the low rate.
    """
    known = F.broadcast(facts.select("provider", "rates", "field_series"))
    rate = F.try_element_at("rates", F.col("_field"))
    dark = (rate["historical"] >= RATE_THRESHOLD) & (rate["recent"] <= RECENT_LIMIT)
    found = F.struct(
        F.col("_field").alias("field"),
        rate["historical"].alias("historical_rate"),
        rate["recent"].alias("recent_rate"),
        F.lit(RATE_THRESHOLD).alias("threshold"),
        F.when(F.col("_field") == COST_FIELD, "CRITICAL").otherwise("WARN").alias("status"),
        F.try_element_at("field_series", F.col("_field")).alias("series"),
    )
    return (
        matched.join(known, "provider", "left")
        .withColumn("_field", F.get("missing", F.lit(0)))
        .withColumn("silent_null", F.when(dark, found))
        .drop("_field", "rates", "field_series")
    )


def with_replay(events: DataFrame, facts: DataFrame) -> DataFrame:
    replay = facts.select("provider", "historical_payloads", "regressions", "failures", "missing_cost")
    return events.join(F.broadcast(replay), "provider", "left").withColumn(
        "replay_status", F.when(F.col("regressions") > 0, "failed").otherwise("passed")
    )


def suggested_versions(matched: DataFrame, corpus: DataFrame, registry: Registry) -> DataFrame:
    """Per event, the lowest later parser version that fills a field missing now.

    Only events with something missing and a later version to try are joined with
    their payloads.  A version that refuses the payload fills nothing.
    """
    later = f"filter({registry.version_list()}, v -> v > parser_version)"
    open_events = (
        matched.filter("size(missing) > 0")
        .withColumn("later", F.expr(later))
        .filter("size(later) > 0")
        .select("event_id", "provider", "missing", "later", "content_hash")
    )
    payloads = corpus.select("content_hash", "payload", "seq", "received_at")
    tries = open_events.join(payloads, "content_hash").select(
        "seq", "received_at", "provider", F.explode("later").alias("version"), "payload", "event_id", "missing"
    )
    read = normalize(tries, registry).filter("parse_reasons = ''")
    filled = F.array(*[F.when(F.col(column).isNotNull(), F.lit(field)) for field, column in FIELD_COLUMNS.items()])
    helps = F.size(F.array_intersect("missing", F.array_compact(filled))) > 0
    return read.filter(helps).groupBy("event_id").agg(F.min("version").alias("suggested_version"))


def alert_index(alerts: DataFrame) -> DataFrame:
    """Alerts with what they concern (``kind``) and their place among those of their provider and kind.

    The newest has place 1.
    """
    kind = F.when(F.col("type") == STRUCTURAL, F.lit(STRUCTURAL)).otherwise(F.concat_ws(":", "type", "field"))
    keyed = alerts.withColumn("kind", kind).withColumns(
        {"_list": F.concat_ws(" ", "provider", "kind"), "_newest": -F.col("id")}
    )
    return ranked(cut(keyed, "keyed_alerts"), "_list", "_newest", "place").drop("_list", "_newest")


def with_related_alerts(described: DataFrame, index: DataFrame) -> DataFrame:
    """What alerts concern an event, as intervals of the index: one per kind, however many alerts.

    Silent-null alerts count if their field is missing on the event; structural ones if
    the event's shape is not the usual one.
    """
    sizes = index.groupBy("provider", "kind").agg(F.max("place").alias("n"))
    # One row per provider; kinds are the measurable fields and the shape.
    lists = sizes.groupBy("provider").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("_sizes"))
    kinds = F.concat(
        F.transform("missing", lambda f: F.concat(F.lit(f"{SILENT_NULL}:"), f)),
        F.when(F.col("changed"), F.array(F.lit(STRUCTURAL))).otherwise(F.array().cast("array<string>")),
    )
    spans = F.transform(
        kinds,
        lambda k: F.struct(
            k.alias("kind"), F.lit(1).cast("bigint").alias("start"), (F.try_element_at("_sizes", k) + 1).alias("stop")
        ),
    )
    return (
        described.join(F.broadcast(lists), "provider", "left")
        .withColumn("related_alerts", F.filter(spans, lambda i: i["stop"].isNotNull()))
        .drop("_sizes")
    )


def event_alerts(reports: DataFrame, index: DataFrame) -> DataFrame:
    """The alerts that concern events, one row each, for the reports asked for."""
    def key(place: str) -> Column:
        return F.concat_ws(" ", "provider", "kind", place)

    asked = reports.select("event_id", "provider", F.inline("related_alerts"))
    rows = asked.select("event_id", "provider", "kind", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("place"))
    found = index.select(
        key("place").alias("_key"), F.col("id").alias("alert_id"), "type", "severity", "field", "message", "created_at"
    )
    joined = lookup(
        rows.withColumn("_key", key("place")), cut(found, "alert_rows"), "_key", "event_id", MAX_BROADCAST_ALERTS
    )
    return joined.select("event_id", "alert_id", "type", "severity", "field", "message", "created_at")


def status() -> Column:
    return (
        F.when(F.col("replay_status") == "failed", REPLAY_FAILED)
        .when(F.col("silent_null.status") == "CRITICAL", SILENT)
        .when(F.col("changed") | F.col("silent_null").isNotNull(), DRIFT)
        .otherwise(HEALTHY)
    )


def _joined(column: str) -> Column:
    return F.array_join(column, ", ")


def notes() -> Column:
    """Root cause, impact, fix and replay sentences."""
    def or_mark(column: str) -> Column:
        return F.when(F.size(column) > 0, _joined(column)).otherwise(NONE_MARK)

    cause = (
        F.when(F.col("changed"), F.format_string(TEXT_MOVED, or_mark("removed"), or_mark("added")))
        .when(F.col("silent_null").isNotNull(), F.format_string(TEXT_STOPPED, F.col("silent_null.field")))
        .otherwise(TEXT_NO_INCIDENT)
    )
    # The count is of events without a cost, whichever field is missing here.
    impact = F.when(
        F.size("missing") > 0,
        F.format_string(TEXT_IMPACT, F.coalesce("missing_cost", F.lit(0)), F.col("provider"), _joined("missing")),
    ).otherwise(TEXT_NO_IMPACT)
    fix = F.when(
        F.col("suggested_version").isNotNull(),
        F.format_string(TEXT_UPGRADE, F.col("provider"), F.col("suggested_version")),
    ).otherwise(TEXT_NO_UPGRADE)
    replay = F.when(
        F.col("regressions") == 0, F.format_string(TEXT_REPLAY_OK, F.col("historical_payloads"), F.col("provider"))
    ).otherwise(F.format_string(TEXT_REPLAY_BAD, F.col("regressions"), F.col("historical_payloads")))
    return F.struct(
        cause.alias("root_cause"), impact.alias("impact"), fix.alias("suggested_fix"), replay.alias("replay")
    )


def timeline() -> Column:
    """The event's eight stages.  A silent null on a field other than cost warns but reads
    "no drift"."""
    critical = F.coalesce(F.col("silent_null.status") == "CRITICAL", F.lit(False))
    absent = F.size("missing") > 0

    def stage(name: str, state: Column, detail: Column, at: Column) -> Column:
        return F.struct(F.lit(name).alias("stage"), state.alias("status"), detail.alias("detail"), at.alias("at"))

    ok, received, stored = F.lit("ok"), F.col("received_at"), F.col("ingested_at")
    version = F.col("parser_version").cast("string")
    return F.array(
        stage("Payload Received", ok, F.lit("Raw JSON accepted"), received),
        stage("Provider Identified", ok, F.col("provider"), received),
        stage("Parser Selected", ok, F.concat(F.col("provider"), F.lit(" v"), version), received),
        stage(
            "Canonical Event Created",
            F.when(absent, "warn").otherwise("ok"),
            F.when(absent, F.concat(_joined("missing"), F.lit(" read null"))).otherwise(
                "All expected fields populated"
            ),
            F.col("occurred_at"),
        ),
        stage(
            "Deduplicated",
            ok,
            F.when(
                F.col("revision") > 1,
                F.concat(F.lit("merged backfill → revision "), F.col("revision").cast("string")),
            ).otherwise("new dedup_key"),
            stored,
        ),
        stage(
            "Drift Detection",
            F.when(critical, "fail")
            .when(F.col("changed") | F.col("silent_null").isNotNull(), "warn")
            .otherwise("ok"),
            F.when(critical, "SILENT_NULL critical raised")
            .when(F.col("changed"), "structural shape change")
            .otherwise("no drift"),
            stored,
        ),
        stage("Stored", ok, F.concat(F.lit("event "), F.left("event_id", F.lit(8)), F.lit("…")), stored),
        stage("Dashboard Updated", ok, F.lit("metrics + alerts refreshed"), stored),
    )


def canonical_nested() -> Column:
    """The nested canonical event rebuilt from its flat row."""
    return F.struct(
        "event_id",
        "dedup_key",
        "provider",
        "parser_version",
        "occurred_at",
        "event_type",
        "model",
        F.struct("raw_user_id").alias("actor"),
        F.struct("input_tokens", "output_tokens").alias("usage"),
        F.struct(F.col("cost_amount_usd").cast("double").alias("amount_usd")).alias("cost"),
        "revision",
        "ingested_at",
    )


def describe(events: DataFrame, facts: DataFrame, registry: Registry) -> DataFrame:
    """Parser match, shape difference, silent-null analysis and replay verdict per event."""
    described = with_silent_null(with_shape_diff(with_parser_match(events, registry), facts), facts)
    return with_replay(described, facts)


def with_receipt(events: DataFrame, corpus: DataFrame) -> DataFrame:
    """Add when the event's current payload was first received, and the payload."""
    receipt = corpus.select("content_hash", "received_at", F.col("payload").alias("raw_payload"))
    return events.join(receipt, "content_hash", "left").withColumn(
        "received_at", F.coalesce("received_at", "ingested_at")
    )


def inspect_events(
    events: DataFrame, corpus: DataFrame, index: DataFrame, facts: DataFrame, registry: Registry
) -> DataFrame:
    """The full report, one row per event; ``index`` comes from :func:`alert_index`."""
    described = describe(events, facts, registry)
    fixes = suggested_versions(described, corpus, registry)
    full = with_related_alerts(with_receipt(described, corpus).join(fixes, "event_id", "left"), index)
    return full.select(
        "event_id",
        "provider",
        status().alias("status"),
        canonical_nested().alias("event"),
        "raw_payload",
        "raw_payload_id",
        "received_at",
        F.struct(
            F.col("provider"),
            F.col("parser_version").alias("version"),
            "expects",
            "populated",
            "missing",
        ).alias("parser"),
        F.col("missing").alias("null_paths"),
        F.struct("changed", "baseline_paths", "current_paths", "added", "removed").alias("structural_diff"),
        "silent_null",
        F.struct(
            F.col("replay_status").alias("status"),
            F.col("historical_payloads").alias("historical"),
            "regressions",
            "failures",
        ).alias("replay"),
        timeline().alias("timeline"),
        notes().alias("notes"),
        "related_alerts",
    )


# --- which event to look at -------------------------------------------------------------


def provider_focus(events: DataFrame) -> DataFrame:
    """Per provider, the latest event without a cost, else the latest event."""
    last_null = F.max_by("dedup_key", F.when(F.col("cost_amount_usd").isNull(), F.col("first_seq")))
    focus = events.groupBy("provider").agg(
        F.coalesce(last_null, F.max_by("dedup_key", "first_seq")).alias("dedup_key")
    )
    return with_event_id(focus).select("provider", "event_id")


def alert_events(alerts: DataFrame, events: DataFrame, corpus: DataFrame) -> DataFrame:
    """Per alert, the event that shows it best.

    A silent null points at the latest event without the field, a structural alert at
    the latest event whose stored payload has the shape, and both fall back to the
    provider's focus event.
    """
    nulls = events.groupBy("provider").agg(
        *[
            F.max_by("dedup_key", F.when(F.col(column).isNull(), F.col("first_seq"))).alias(f"_k{i}")
            for i, column in enumerate(FIELD_COLUMNS.values())
        ]
    )
    by_field = nulls.select(
        "provider",
        F.inline(
            F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_k{i}").alias("k")) for i, f in enumerate(FIELD_COLUMNS)])
        ),
    ).filter("k is not null")
    by_shape = with_paths(
        events.join(corpus.select("content_hash"), "content_hash", "left_semi")
        .groupBy("provider", "shape_key")
        .agg(F.max("first_seq").alias("at"), F.max_by("dedup_key", "first_seq").alias("k"))
    ).groupBy("provider", "fingerprint").agg(F.max_by("k", "at").alias("k"))
    field_event = with_event_id(by_field, "k", "field_event").drop("k")
    shape_event = with_event_id(by_shape, "k", "shape_event").drop("k")
    focus = provider_focus(events).withColumnRenamed("event_id", "focus_event")
    return (
        alerts.join(field_event, ["provider", "field"], "left")
        .join(shape_event, ["provider", "fingerprint"], "left")
        .join(F.broadcast(focus), "provider", "left")
        .select("id", "provider", "type", "field", F.coalesce("field_event", "shape_event", "focus_event").alias("event_id"))
    )


def pick_event(
    reports: DataFrame,
    targets: DataFrame,
    focus: DataFrame,
    event_id: str | None = None,
    alert_id: int | None = None,
    provider: str | None = None,
) -> DataFrame:
    """The report of one event, chosen by its id, else by alert, else by provider.

    ``targets`` comes from :func:`alert_events`, ``focus`` from :func:`provider_focus`;
    an alert id of zero means none was given.
    """
    if event_id:
        return reports.filter(F.col("event_id") == event_id)
    if alert_id:
        wanted = targets.filter(F.col("id") == alert_id).select("event_id")
    elif provider:
        wanted = focus.filter(F.col("provider") == provider).select("event_id")
    else:
        return reports.limit(0)
    # A single id.
    return reports.join(F.broadcast(wanted), "event_id", "left_semi")
