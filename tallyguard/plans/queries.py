"""Every registered query: (spark, sf_dir) -> DataFrame with flat, comparable columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ecma
from ..functions.exact import exact_sums
from ..operators import drift, fold, forensics, replay, reports, shapes
from ..operators.normalize import normalize, route, with_event_id
from ..operators.registry import (
    ANTHROPIC_V1,
    COST_FIELD,
    CURSOR_V1,
    FIELD_COLUMNS,
    OPENAI_V1,
    OPENAI_V2,
    Parser,
    Registry,
    build_registry,
)
from ..session import cut, prepare, scratch_dir
from ..streaming.ingest import IngestJob
from . import fixture
from .tables import Tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# A version that insists on a cost, to give replay something to refuse.
STRICT_V3 = Parser(**{**OPENAI_V2.__dict__, "version": 3, "required": ("cost.amount_usd",)})


def with_v2() -> Registry:
    return build_registry(openai_v2=True)


def with_v3() -> Registry:
    return with_v2().plus(STRICT_V3)


def _list(column: str | Column, sep: str = ",") -> Column:
    return F.array_join(column, sep)


def _ntz(column: str) -> Column:
    return F.col(column).cast("timestamp_ntz").alias(column)


def _usd(column: str = "cost_amount_usd") -> Column:
    return F.col(column).cast("double").alias(column)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# --- sources and sinks ------------------------------------------------------------------


@query
def arrivals(spark, sf_dir):
    return fixture.arrivals(spark, sf_dir).select("seq", _ntz("received_at"), "provider", "payload")


@query
def quarantine(spark, sf_dir):
    return Tables.from_source(spark, sf_dir).quarantine.select("seq", "provider", "reason")


@query
def corpus(spark, sf_dir):
    fields = [f for f in fold.CORPUS_FIELDS if f != "payload"]
    rows = with_event_id(Tables.from_source(spark, sf_dir).light_corpus(*fields), "content_hash", "raw_payload_id")
    return shapes.attach_paths(cut(rows, "corpus")).select(
        "raw_payload_id", "content_hash", "provider", "seq", "parser_version", "fingerprint",
        "dedup_key", "event_type", "model", "input_tokens", "output_tokens", "cost_value",
    )


def _event_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "event_id", "dedup_key", "provider", "parser_version", "raw_payload_id", _ntz("occurred_at"),
        "event_type", "model", "raw_user_id", "input_tokens", "output_tokens", _usd(), "revision", _ntz("ingested_at"),
    )


@query
def events(spark, sf_dir):
    return _event_columns(Tables.from_source(spark, sf_dir).events)


@query
def merged_events(spark, sf_dir):
    """The event table folded in two batches: the later half merged into the earlier."""
    t = Tables.from_source(spark, sf_dir)
    rows = t.stored_light
    middle = rows.agg(F.avg("seq")).first()[0]
    first = cut(fold.events_table(rows.filter(F.col("seq") <= middle)), "first_half")
    return _event_columns(fold.merge_events(first, rows.filter(F.col("seq") > middle)))


@query
def alerts(spark, sf_dir):
    t = Tables.from_source(spark, sf_dir)
    return drift.with_removed_paths(cut(t.alerts, "alerts"), None, t.known).select(
        "id", "seq", "provider", "type", "severity", "field", "message", "fingerprint",
        _list("added").alias("added"), _list("removed").alias("removed"),
        "overall_rate", "recent_rate", "overall_seen", "recent_seen", _ntz("created_at"),
    )


# --- identity -----------------------------------------------------------------------------


@query
def canonical_json(spark, sf_dir):
    docs = fixture.arrivals(spark, sf_dir).selectExpr("seq", "to_json(try_parse_json(payload)) as printed")
    return docs.selectExpr("seq", f"{ecma.json_text('printed')} as canonical_json")


@query
def content_hash(spark, sf_dir):
    return Tables.from_source(spark, sf_dir).normalized.select("seq", "content_hash")


@query
def dedup_key(spark, sf_dir):
    return Tables.from_source(spark, sf_dir).normalized.select("seq", "provider", "dedup_key")


@query
def event_uuid(spark, sf_dir):
    rows = with_event_id(Tables.from_source(spark, sf_dir).normalized)
    return with_event_id(rows, "content_hash", "raw_payload_id").select("seq", "event_id", "raw_payload_id")


@query
def content_dedup(spark, sf_dir):
    """First document per distinct text, by content hash."""
    docs = _table(spark, sf_dir, "documents").withColumn("content_hash", F.sha2("text", 256))
    return fold.first_by_content(docs, "content_hash", "doc_id", ["lang", "source", "n_chars"])


@query
def conversation_dedup(spark, sf_dir):
    """First turn per distinct conversation text, ordered by conversation and turn."""
    turns = _table(spark, sf_dir, "conversations").select(
        F.sha2("text", 256).alias("content_hash"), F.struct("conv_id", "turn").alias("position"), "role"
    )
    first = fold.first_by_content(turns, "content_hash", "position", ["role"])
    return first.select("content_hash", "position.conv_id", "position.turn", "copies", "role")


# --- normalization --------------------------------------------------------------------------


def _canonical(df: DataFrame) -> DataFrame:
    return df.select(
        "seq", "provider", "parser_version", "dedup_key", "occurred_at_text", _ntz("occurred_at"), "event_type",
        "model", "raw_user_id", "input_tokens", "output_tokens", "cost_value", "parse_reasons",
    )


def _one_parser(spark, sf_dir, provider: str, version: int) -> DataFrame:
    registry = Registry([with_v2().table[provider][version]])
    rows = fixture.arrivals(spark, sf_dir).filter(F.col("provider") == provider)
    return _canonical(normalize(rows, registry))


@query
def normalize_openai_v1(spark, sf_dir):
    return _one_parser(spark, sf_dir, "openai", 1)


@query
def normalize_openai_v2(spark, sf_dir):
    return _one_parser(spark, sf_dir, "openai", 2)


@query
def normalize_anthropic_v1(spark, sf_dir):
    return _one_parser(spark, sf_dir, "anthropic", 1)


@query
def normalize_cursor_v1(spark, sf_dir):
    return _one_parser(spark, sf_dir, "cursor", 1)


@query
def normalize_all(spark, sf_dir):
    return _canonical(Tables.from_source(spark, sf_dir, with_v2()).normalized)


@query
def validation_reasons(spark, sf_dir):
    rows = Tables.from_source(spark, sf_dir).normalized
    return rows.groupBy("provider", "parse_reasons", "store_reasons").agg(F.count("*").alias("arrivals"))


def _pinned(spark, sf_dir) -> DataFrame:
    """Arrivals with versions: redeliveries pin the first, backfills ask for one that is
    not registered, the rest use zero for "none"."""
    return fixture.arrivals(spark, sf_dir).withColumn(
        "version", F.when(F.col("seq") % 10 == 5, 1).when(F.col("seq") % 10 == 7, 9).otherwise(0)
    )


@query
def routed(spark, sf_dir):
    return route(_pinned(spark, sf_dir), with_v2()).select("seq", "provider", "version", "parser_version")


@query
def registry(spark, sf_dir):
    """Registered parsers with the number of arrivals each one handles."""
    known = with_v2()
    handled = route(_pinned(spark, sf_dir), known).groupBy("provider", "parser_version").agg(
        F.count("*").alias("arrivals")
    )
    parsers = known.frame(spark).withColumn("latest", F.expr(f"version = array_max({known.version_list()})"))
    return parsers.join(
        handled.withColumnRenamed("parser_version", "version"), ["provider", "version"], "left"
    ).select("provider", "version", _list("expects").alias("expects"), "latest", F.coalesce("arrivals", F.lit(0)).alias("arrivals"))


# --- shapes -----------------------------------------------------------------------------------


def _keyed(spark, sf_dir) -> DataFrame:
    return shapes.attach_paths(Tables.from_source(spark, sf_dir).normalized.select("seq", "provider", "shape_key"))


@query
def leaf_paths(spark, sf_dir):
    return _keyed(spark, sf_dir).select("seq", F.explode("paths").alias("path"))


@query
def path_set(spark, sf_dir):
    return _keyed(spark, sf_dir).select("seq", F.size("paths").alias("n_paths"), _list("paths").alias("paths"))


@query
def fingerprint(spark, sf_dir):
    return _keyed(spark, sf_dir).select("seq", "provider", "fingerprint")


@query
def payload_paths(spark, sf_dir):
    """Paths read row by row, without the grouping key."""
    return shapes.payload_paths(fixture.arrivals(spark, sf_dir), "payload").select("seq", "fingerprint")


@query
def known_shapes(spark, sf_dir):
    return shapes.known_shapes(Tables.from_source(spark, sf_dir).light_corpus("provider", "shape_key")).select(
        "provider", "fingerprint", "first_seq", "n"
    )


@query
def known_paths(spark, sf_dir):
    known = shapes.known_shapes(Tables.from_source(spark, sf_dir).light_corpus("provider", "shape_key"))
    return shapes.known_paths(known)


@query
def dominant_shape(spark, sf_dir):
    known = shapes.known_shapes(Tables.from_source(spark, sf_dir).light_corpus("provider", "shape_key"))
    return shapes.dominant_shape(known).select("provider", "fingerprint", "n")


@query
def props_shapes(spark, sf_dir):
    """Shapes of the raw event properties per event type."""
    from ..functions import paths

    docs = _table(spark, sf_dir, "events").selectExpr(
        "event_id", "event_type", "try_parse_json(props) as doc"
    ).selectExpr("*", "schema_of_variant(doc) as kind")
    keyed = docs.selectExpr("event_id", "event_type", f"{paths.shape_key('doc', 'kind')} as shape_key")
    return shapes.known_shapes(keyed, "event_type", "event_id").select(
        "event_type", "fingerprint", F.col("first_seq").alias("first_event_id"), "n"
    )


# --- upsert and revision ------------------------------------------------------------------------


@query
def revisions(spark, sf_dir):
    return Tables.from_source(spark, sf_dir).events.select("event_id", "provider", "revision", _usd())


@query
def ingest_results(spark, sf_dir):
    t = Tables.from_source(spark, sf_dir)
    raised = t.stored_alerts.groupBy("seq").agg(F.count("*").alias("alerts"))
    return (
        fold.ingest_results(t.stored_light)
        .join(raised, "seq", "left")
        .select("seq", "dedup_key", "event_id", "inserted", "revision", F.coalesce("alerts", F.lit(0)).alias("alerts"))
    )


# --- drift ------------------------------------------------------------------------------------


@query
def structural_alerts(spark, sf_dir):
    t = Tables.from_source(spark, sf_dir)
    found = cut(drift.structural_alerts(t.stored_light, None, t.known), "structural_alerts")
    return drift.with_removed_paths(found, None, t.known).select(
        "seq", "provider", "severity", "message", "fingerprint",
        _list("added").alias("added"), _list("removed").alias("removed"),
    )


@query
def field_stats(spark, sf_dir):
    return drift.field_stats(Tables.from_source(spark, sf_dir).presence)


@query
def silent_null_alerts(spark, sf_dir):
    return drift.silent_nulls(drift.field_stats(Tables.from_source(spark, sf_dir).presence)).select(
        "provider", "field", "severity", "message", "overall_rate", "recent_rate", "overall_seen", "recent_seen"
    )


@query
def silent_null_first_fire(spark, sf_dir):
    t = Tables.from_source(spark, sf_dir)
    return drift.silent_null_first_fire(t.presence, t.registry).select(
        "provider", "field", "seq", "severity", "message",
        "overall_seen", "overall_populated", "recent_seen", "recent_populated",
    )


def _labelled(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(
        _table(spark, sf_dir, "labels"), "doc_id", "left"
    )


@query
def label_stats(spark, sf_dir):
    """How often documents of a language carry labels, baseline against the newest."""
    return drift.field_stats(
        _labelled(spark, sf_dir), {"quality": "quality", "toxic": "toxic"}, "lang", ("doc_id",)
    )


@query
def label_series(spark, sf_dir):
    """Label presence over the newest documents of each source."""
    flags = reports.last_flags(
        _labelled(spark, sf_dir), {"quality": "quality", "toxic": "toxic"}, "source", ("doc_id",)
    )
    return flags.select("source", "field", _list("series", "").alias("series"), "rate")


# A second openai version that reads the same places but does not expect a cost.
BLIND_V2 = Parser(**{**OPENAI_V1.__dict__, "version": 2, "expects": tuple(f for f in FIELD_COLUMNS if f != COST_FIELD)})


def _two_expectations(spark, sf_dir) -> Tables:
    """A load whose redeliveries and backfills are pinned to the first version."""
    pinned = fixture.arrivals(spark, sf_dir).withColumn("version", F.when(F.col("seq") % 10 != 0, 1))
    return Tables(pinned, Registry([OPENAI_V1, BLIND_V2, ANTHROPIC_V1, CURSOR_V1]))


@query
def expected_field_stats(spark, sf_dir):
    """Population of the fields that the newest arrival's version expects."""
    t = _two_expectations(spark, sf_dir)
    return drift.expected_stats(drift.field_stats(t.presence), t.accepted, t.registry)


@query
def silent_null_by_version(spark, sf_dir):
    """Only redeliveries and backfills come through the version that expects a cost."""
    t = _two_expectations(spark, sf_dir)
    rows = t.stored_light
    return drift.silent_null_first_fire(fold.fold_presence(rows), t.registry, arrivals=rows).select(
        "provider", "field", "seq", "severity", "message",
        "overall_seen", "overall_populated", "recent_seen", "recent_populated",
    )


@query
def known_path_positions(spark, sf_dir):
    """Known paths in the order they became known, as structural alerts number them."""
    t = Tables.from_source(spark, sf_dir)
    return t.known[1].select("provider", "path", "since", "position")


@query
def alert_list(spark, sf_dir):
    """Alerts as a list shows them: the newest first."""
    t = Tables.stored_load(spark, sf_dir)
    return drift.latest_first(t.stored_alerts).select(
        "place", "id", "provider", "type", "severity", "field", "message", _ntz("created_at")
    )


@query
def ingest_alerts(spark, sf_dir):
    """Arrivals that raised alerts, with the alerts."""
    t = Tables.stored_load(spark, sf_dir)
    # Ids are made of the results that are kept only.
    raising = fold.ingest_results(t.stored_accepted).join(t.stored_alerts.select("seq"), "seq", "left_semi")
    rows = drift.with_raised(raising, t.stored_alerts).filter(F.size("alerts") > 0)
    alert = lambda a: F.concat_ws(":", a["id"], a["type"], a["severity"], a["field"], a["message"])
    return rows.select("seq", "event_id", "inserted", "revision", _list(F.transform("alerts", alert), ";").alias("alerts"))


# --- the same load in four micro-batches --------------------------------------------------------

_STREAMED: dict[tuple[str, str], IngestJob] = {}


def _quarters(arrivals: DataFrame) -> DataFrame:
    """About where each quarter of the arrivals ends, from summaries of bounded size.

    Exact quartiles take every position to one task, and results do not depend on where batches end.
    """
    return arrivals.agg(F.percentile_approx("seq", [0.25, 0.5, 0.75]))


def _streamed(spark, sf_dir) -> IngestJob:
    """The tables that four batches of a continuous ingest leave, built on first use."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STREAMED:
        arrivals = cut(fixture.arrivals(spark, sf_dir), "arrivals")
        edges = _quarters(arrivals).first()[0]
        job = IngestJob(spark, f"{scratch_dir(spark)}/streamed", build_registry())
        for batch, (low, high) in enumerate(zip([None, *edges], [*edges, None])):
            above = F.lit(True) if low is None else F.col("seq") > low
            up_to = F.lit(True) if high is None else F.col("seq") <= high
            job.run_batch(arrivals.filter(above & up_to), batch)
        _STREAMED[key] = job
    return _STREAMED[key]


@query
def streamed_events(spark, sf_dir):
    return _event_columns(_streamed(spark, sf_dir).events())


@query
def streamed_alerts(spark, sf_dir):
    job = _streamed(spark, sf_dir)
    return drift.with_removed_paths(job.alerts(), job.corpus()).select(
        "id", "seq", "provider", "type", "severity", "field", "message", "fingerprint",
        _list("added").alias("added"), _list("removed").alias("removed"),
        "overall_rate", "recent_rate", "overall_seen", "recent_seen", _ntz("created_at"),
    )


@query
def streamed_results(spark, sf_dir):
    return _streamed(spark, sf_dir).results().select(
        "seq", "dedup_key", "event_id", "inserted", "revision", F.size("alerts").cast("bigint").alias("alerts")
    )


@query
def streamed_corpus(spark, sf_dir):
    return _streamed(spark, sf_dir).corpus().select("content_hash", "provider", "seq", "payload")


# --- replay -------------------------------------------------------------------------------------


@query
def replay_diff(spark, sf_dir):
    rows = Tables.from_source(spark, sf_dir).replay(with_v2())
    return replay.replay_diff(rows).select("seq", "provider", "version", "outcome", _list("changed").alias("changed"))


def _matrix(spark, sf_dir, known: Registry) -> DataFrame:
    return replay.replay_matrix(Tables.from_source(spark, sf_dir).replay(known), known)


@query
def replay_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir, with_v3()).withColumn("throw_reasons", _list("throw_reasons", ";"))


@query
def replay_summary(spark, sf_dir):
    """The replay run as a whole: cells, stored payloads, outcomes."""
    cells = _matrix(spark, sf_dir, with_v2())
    return replay.replay_summary(cells)


@query
def replay_failures(spark, sf_dir):
    t = Tables.from_source(spark, sf_dir)
    rows = replay.replay_rows(t.stored_corpus, with_v3())
    return replay.replay_failures(rows, t.stored_corpus)


@query
def replay_regressions(spark, sf_dir):
    """What the strict third openai version breaks, against the run before it."""
    t = Tables.from_source(spark, sf_dir)
    # A cell depends on its own version only, so the run before shares the older cells.
    after = cut(replay.replay_matrix(replay.replay_rows(t.stored_corpus, with_v3()), with_v3()), "replay_matrix")
    before = after.join(F.broadcast(with_v2().frame(spark).select("provider", "version")), ["provider", "version"], "left_semi")
    return replay.regressions(before, after, "openai").select(
        "provider", "version", "differs", "throws",
        F.col("after.total").alias("total"), F.col("after.throw").alias("throw"),
    )


@query
def replay_grid(spark, sf_dir):
    return replay.replay_grid(_matrix(spark, sf_dir, with_v3()), [1, 2, 3])


@query
def provider_replay(spark, sf_dir):
    return replay.provider_replay(_matrix(spark, sf_dir, with_v3()))


# --- reports --------------------------------------------------------------------------------------


@query
def recent_events(spark, sf_dir):
    return _event_columns(reports.recent_events(Tables.from_source(spark, sf_dir).events))


@query
def provider_health(spark, sf_dir):
    health = reports.provider_health(Tables.from_source(spark, sf_dir).folded)
    return health.select(
        "provider", "events", "parser_version", _ntz("last_ingest"), _ntz("last_occurred"), "missing_cost"
    )


@query
def provider_versions(spark, sf_dir):
    health = reports.provider_health(Tables.from_source(spark, sf_dir).folded)
    return reports.provider_versions(health, with_v2()).select(
        "provider", "events", "parser_version", _list(F.col("registered_versions").cast("array<string>")).alias("registered_versions"), "live_version"
    )


@query
def weekly_cost(spark, sf_dir):
    return reports.weekly(Tables.from_source(spark, sf_dir).folded)


@query
def exact_totals(spark, sf_dir):
    """Amounts between 1e-14 and 1e17, summed without rounding."""
    rows = _table(spark, sf_dir, "events").selectExpr(
        "event_type", "cast(concat(cast(round(value * 100) as bigint), 'E', event_id % 29 - 14) as double) as amount"
    )
    return exact_sums(rows, ["event_type"], "amount", "total", "events")


@query
def missing_cost(spark, sf_dir):
    return reports.missing_cost(Tables.from_source(spark, sf_dir).presence)


@query
def cost_integrity(spark, sf_dir):
    return reports.cost_integrity(Tables.from_source(spark, sf_dir).presence)


@query
def weekly_grid(spark, sf_dir):
    weeks = cut(reports.weekly(Tables.from_source(spark, sf_dir).folded), "weekly")
    return reports.weekly_grid(weeks).withColumns(
        {"total_usd": F.round("total_usd", 9), "max_cell": F.round("max_cell", 9)}
    )


@query
def field_vitals(spark, sf_dir):
    vitals = reports.field_vitals(Tables.from_source(spark, sf_dir).presence)
    return vitals.select("provider", "field", _list("series", "").alias("series"), "rate", "state")


@query
def dark_providers(spark, sf_dir):
    return reports.dark_providers(reports.field_vitals(Tables.from_source(spark, sf_dir).presence))


@query
def alert_counts(spark, sf_dir):
    return reports.alert_counts(Tables.from_source(spark, sf_dir).alerts)


@query
def order_weekly(spark, sf_dir):
    """Weekly order value per priority."""
    rows = _table(spark, sf_dir, "orders").withColumn("amount", F.col("o_totalprice").cast("decimal(18,2)"))
    return reports.weekly(rows, "o_orderpriority", "o_orderdate", "amount", "total_usd", "orders")


@query
def event_weekly(spark, sf_dir):
    """Weekly value per raw event type."""
    rows = _table(spark, sf_dir, "events").withColumn("amount", F.col("value").cast("decimal(18,2)"))
    return reports.weekly(rows, "event_type", "ts", "amount", "total_value", "events")


# --- forensics --------------------------------------------------------------------------------------


@query
def alert_events(spark, sf_dir):
    t = Tables.stored_load(spark, sf_dir)
    return forensics.alert_events(t.stored_alerts, t.stored_events, t.stored_corpus)


@query
def provider_focus_event(spark, sf_dir):
    return forensics.provider_focus(Tables.stored_load(spark, sf_dir).stored_events)


@query
def parser_match(spark, sf_dir):
    t = Tables.stored_load(spark, sf_dir)
    rows = forensics.with_parser_match(t.stored_events, t.latest_registry)
    return rows.select("event_id", _list("populated").alias("populated"), _list("missing").alias("missing"))


@query
def canonical_nested(spark, sf_dir):
    rows = Tables.stored_load(spark, sf_dir).stored_events.withColumn("event", forensics.canonical_nested())
    return rows.select(
        F.col("event.event_id").alias("event_id"),
        F.col("event.actor.raw_user_id").alias("raw_user_id"),
        F.col("event.usage.input_tokens").alias("input_tokens"),
        F.col("event.usage.output_tokens").alias("output_tokens"),
        F.col("event.cost.amount_usd").alias("amount_usd"),
        F.col("event.revision").alias("revision"),
    )


def _described(spark, sf_dir) -> tuple[Tables, DataFrame]:
    t = Tables.stored_load(spark, sf_dir)
    return t, forensics.describe(t.stored_events, t.stored_facts, t.latest_registry)


@query
def structural_diff(spark, sf_dir):
    _, rows = _described(spark, sf_dir)
    return rows.select("event_id", "changed", _list("added").alias("added"), _list("removed").alias("removed"))


@query
def silent_null_analysis(spark, sf_dir):
    _, rows = _described(spark, sf_dir)
    return rows.filter("silent_null is not null").select(
        "event_id", "silent_null.field", "silent_null.historical_rate", "silent_null.recent_rate",
        "silent_null.status", _list("silent_null.series", "").alias("series"),
    )


@query
def field_series(spark, sf_dir):
    flags = reports.last_flags(Tables.from_source(spark, sf_dir).presence, FIELD_COLUMNS)
    return flags.select("provider", "field", _list("series", "").alias("series"))


@query
def related_alerts(spark, sf_dir):
    t, rows = _described(spark, sf_dir)
    related = forensics.with_related_alerts(rows, t.stored_index)
    return related.join(_alert_ids(t, related), "event_id", "left").select("event_id", F.coalesce("alert_ids", F.lit("")).alias("alert_ids"))


def _alert_ids(t: Tables, related: DataFrame) -> DataFrame:
    """Ids of the alerts of each event that has any, newest first."""
    ids = F.sort_array(F.collect_list("alert_id"), asc=False).cast("array<string>")
    found = forensics.event_alerts(related.select("event_id", "provider", "related_alerts"), t.stored_index)
    return found.groupBy("event_id").agg(_list(ids).alias("alert_ids"))


@query
def event_alerts(spark, sf_dir):
    """Every event with every alert that concerns it."""
    t, rows = _described(spark, sf_dir)
    found = forensics.event_alerts(forensics.with_related_alerts(rows, t.stored_index), t.stored_index)
    return found.select("event_id", "alert_id", "type", "severity", "field", "message", _ntz("created_at"))


@query
def strict_inspection(spark, sf_dir):
    """Replay verdicts and refused payloads per event when a third openai version insists on a cost."""
    t = Tables.stored_load(spark, sf_dir)
    rows = forensics.describe(t.stored_events, t.facts(with_v3()), with_v3())
    failure = lambda f: F.concat_ws(":", f["payload"], f["version"], f["expected"], f["reason"])
    return rows.select(
        "event_id", "provider", forensics.status().alias("status"), "replay_status",
        "historical_payloads", "regressions", _list(F.transform("failures", failure), ";").alias("failures"),
    )


@query
def suggested_version(spark, sf_dir):
    t = Tables.stored_load(spark, sf_dir)
    matched = forensics.with_parser_match(t.stored_events, t.latest_registry)
    return forensics.suggested_versions(matched, t.stored_corpus, t.latest_registry)


@query
def event_status(spark, sf_dir):
    _, rows = _described(spark, sf_dir)
    return rows.select("event_id", "provider", forensics.status().alias("status"))


@query
def event_timeline(spark, sf_dir):
    t, rows = _described(spark, sf_dir)
    stages = forensics.with_receipt(rows, t.stored_corpus).select("event_id", F.inline(forensics.timeline()))
    return stages.select("event_id", "stage", "status", "detail", _ntz("at"))


@query
def event_notes(spark, sf_dir):
    t, rows = _described(spark, sf_dir)
    fixes = forensics.suggested_versions(rows, t.stored_corpus, t.latest_registry)
    return rows.join(fixes, "event_id", "left").withColumn("n", forensics.notes()).select("event_id", "n.*")


def _inspection(spark, sf_dir) -> tuple[Tables, DataFrame]:
    t = Tables.stored_load(spark, sf_dir)
    return t, forensics.inspect_events(
        t.stored_events, t.stored_corpus, t.stored_index, t.stored_facts, t.latest_registry
    )


@query
def event_inspection(spark, sf_dir):
    t, rows = _inspection(spark, sf_dir)
    related = forensics.with_related_alerts(_described(spark, sf_dir)[1], t.stored_index)
    return rows.join(_alert_ids(t, related), "event_id", "left").select(
        "event_id", "provider", "status", "raw_payload_id", _ntz("received_at"),
        F.col("event.revision").alias("revision"),
        F.col("event.cost.amount_usd").alias("amount_usd"),
        _list("parser.missing").alias("missing"),
        F.col("structural_diff.changed").alias("changed"),
        F.col("silent_null.status").alias("silent_null"),
        F.col("replay.status").alias("replay_status"),
        F.size("timeline").alias("stages"),
        F.col("notes.root_cause").alias("root_cause"),
        F.col("notes.suggested_fix").alias("suggested_fix"),
        F.size("replay.failures").alias("failures"),
        F.coalesce("alert_ids", F.lit("")).alias("alert_ids"),
    )


@query
def alert_inspection(spark, sf_dir):
    """The reports that the alerts lead to."""
    t, rows = _inspection(spark, sf_dir)
    targets = forensics.alert_events(t.stored_alerts, t.stored_events, t.stored_corpus)
    return rows.join(targets.select("id", "event_id"), "event_id").select(
        "id", "event_id", "status", F.col("notes.root_cause").alias("root_cause"), F.col("notes.impact").alias("impact")
    )
