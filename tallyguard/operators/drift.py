"""Structural drift, field population statistics and silent nulls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .prefix import BUCKET_BITS, as_of, ranked, running_totals
from .registry import COST_FIELD, FIELD_COLUMNS, Registry
from .shapes import known_paths, with_paths

# The messages of alerts.
SHAPE_MESSAGE = "New raw shape for %s: %d path(s) added, %d removed."
DARK_MESSAGE = "%s went dark: %.0f%% populated historically, %.0f%% across the last %d. Parser never threw."

STRUCTURAL, SILENT_NULL = "STRUCTURAL", "SILENT_NULL"

ALERT_SCHEMA = """id bigint, seq bigint, provider string, type string, severity string, field string, message string,
    fingerprint string, added array<string>, removed array<struct<start: bigint, stop: bigint>>,
    overall_rate double, recent_rate double, overall_seen bigint, recent_seen bigint, created_at timestamp"""


@dataclass(frozen=True)
class Thresholds:
    """When a field counts as gone: seen often and populated before, now hardly ever."""

    min_overall: int = 30
    min_recent: int = 10
    high_rate: float = 0.9
    low_rate: float = 0.1
    recent_window: int = 20


DEFAULTS = Thresholds()


# --- structural drift ---------------------------------------------------------------
#
# The paths known of a provider only ever grow, so they are numbered in the order they became
# known.  What was known before an arrival is then a prefix of these positions, and what a payload
# lacks of it is the gaps between its own positions: as many intervals as it has paths, however
# many paths are known.


def stored_shapes(corpus: DataFrame) -> DataFrame:
    """One row per provider and shape key of the stored payloads, with where it was first stored."""
    shapes = corpus.groupBy("provider", "shape_key").agg(F.min("seq").alias("stored_seq"))
    return cut(with_paths(shapes), "stored_shapes")


def path_positions(stored: DataFrame) -> DataFrame:
    """The known paths of each provider with their positions, from 0, in the order they became known.

    Positions do not change when more is stored later.
    """
    known = cut(known_paths(stored, order="stored_seq"), "known_paths")
    placed = ranked(known, "provider", "since", "_rank", (F.col("path"),))
    return cut(placed.withColumn("position", F.col("_rank") - 1).drop("_rank"), "path_positions")


def known_of(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored shapes and path positions of a corpus, for callers that need them more than once."""
    stored = stored_shapes(corpus)
    return stored, path_positions(stored)


def _compare_paths(new: DataFrame, positions: DataFrame) -> DataFrame:
    """Add to each new shape its added paths, and the intervals of known positions that it lacks."""
    shape = ["provider", "fingerprint"]
    own = new.select(*shape, "seq", F.explode("paths").alias("path")).join(positions, ["provider", "path"], "left")
    old = F.col("since") < F.col("seq")
    met = own.groupBy(*shape).agg(
        F.array_sort(F.collect_list(F.when(F.coalesce(~old, F.lit(True)), F.col("path")))).alias("added"),
        F.array_sort(F.collect_list(F.when(old, F.col("position")))).alias("_held"),
    )
    counts = positions.groupBy("provider", F.col("since").alias("_at")).agg((F.max("position") + 1).alias("n_known"))
    # What became known strictly before.
    probes = new.select(*shape, (F.col("seq") - 1).alias("_at"))
    known = as_of(cut(counts, "known_counts"), cut(probes, "shape_probes"), ["provider"], "_at", ["n_known"])
    none = F.lit(0).cast("bigint")
    gaps = F.expr(
        """filter(transform(sequence(0, size(_held)), i -> struct(
            if(i = 0, 0L, get(_held, i - 1) + 1) as start, coalesce(get(_held, i), n_known) as stop)), g -> g.start < g.stop)"""
    )
    return (
        new.join(met, shape)
        .join(known.select(*shape, F.coalesce("n_known", none).alias("n_known")), shape)
        .withColumn("removed", gaps)
        .withColumn("n_removed", F.col("n_known") - F.size("_held"))
    )


def structural_alerts(
    accepted: DataFrame, corpus: DataFrame | None, known: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """One alert per provider and shape that was new when it arrived.

    A shape is known once a payload with it is stored, and a provider's first stored
    payload raises nothing.  Arrivals and stored payloads are reduced to one row per
    shape key before anything is compared.  ``removed`` holds intervals of known paths by
    position; :func:`with_removed_paths` lists them.  ``known`` stands for the corpus if it is given.
    """
    stored, positions = known or known_of(corpus)
    # One row per provider, and providers are limited to the registry's.
    opening = stored.groupBy("provider").agg(F.min("stored_seq").alias("opened_seq"))
    later = (
        accepted.join(F.broadcast(opening), "provider")
        .filter("seq > opened_seq")
        .groupBy("provider", "shape_key")
        .agg(F.min("seq").alias("seq"))
    )
    seen_shapes = (
        with_paths(later)
        .groupBy("provider", "fingerprint")
        .agg(F.min("seq").alias("seq"), F.first("paths").alias("paths"))
    )
    first_stored = stored.groupBy("provider", "fingerprint").agg(F.min("stored_seq").alias("stored_seq"))
    new = (
        seen_shapes.join(first_stored, ["provider", "fingerprint"], "left")
        .join(F.broadcast(opening), "provider")
        .filter("stored_seq is null or stored_seq > opened_seq")
    )
    return _compare_paths(cut(new, "new_shapes"), positions).select(
        "seq",
        "provider",
        F.lit(STRUCTURAL).alias("type"),
        F.lit("warn").alias("severity"),
        F.lit(None).cast("string").alias("field"),
        F.format_string(SHAPE_MESSAGE, "provider", F.size("added"), "n_removed").alias("message"),
        "fingerprint",
        "added",
        "removed",
    )


def with_removed_paths(
    alerts: DataFrame, corpus: DataFrame | None, known: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Alerts with ``removed`` spelled out: one step per path listed, as the list asks for."""
    alert = ["provider", "fingerprint"]
    wanted = alerts.filter(F.col("type") == STRUCTURAL).select(*alert, F.inline("removed"))
    wanted = wanted.select(*alert, F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("position"))
    lists = (
        wanted.join((known or known_of(corpus))[1], ["provider", "position"])
        .groupBy(*alert)
        .agg(F.array_sort(F.collect_list("path")).alias("_removed"))
    )
    none = F.when(F.col("type") == STRUCTURAL, F.array().cast("array<string>"))
    listed = alerts.join(lists, alert, "left").withColumn("removed", F.coalesce("_removed", none))
    return listed.select(*alerts.columns)


# --- field statistics ---------------------------------------------------------------


def _unpivot_fields(df: DataFrame, keep: list[str], columns: dict[str, list[Column]], names: list[str]) -> DataFrame:
    """One row per (kept columns, field) from per-field column lists."""
    rows = F.array(
        *[
            F.struct(F.lit(field).alias("field"), *[c.alias(n) for c, n in zip(values, names)])
            for field, values in columns.items()
        ]
    )
    return df.select(*keep, F.inline(rows))


def field_stats(
    events: DataFrame,
    fields: dict[str, str] | None = None,
    group: str = "provider",
    order: tuple[str, ...] = ("first_seq",),
    recent_window: int = DEFAULTS.recent_window,
) -> DataFrame:
    """Seen and populated counts per group and field, baseline and most recent rows.

    The baseline is everything but the recent rows.  Totals are a partial aggregation,
    and the recent rows are cut to the window size before any shuffle.
    """
    fields = fields or FIELD_COLUMNS
    counts = {name: F.count(column) for name, column in fields.items()}
    # Both sides read the same columns, so the shuffle below them is done once.
    newest = F.max(order[0]).alias("newest")

    def stats(df: DataFrame, prefix: str) -> DataFrame:
        return df.groupBy(group).agg(
            F.count("*").alias(f"{prefix}_seen"),
            newest,
            *[c.alias(f"{prefix}_{i}") for i, c in enumerate(counts.values())],
        )

    latest = Window.partitionBy(group).orderBy(*[F.col(o).desc() for o in order])
    recent = events.withColumn("_rn", F.row_number().over(latest)).filter(F.col("_rn") <= recent_window)
    total, last = stats(events, "total"), stats(recent, "recent").withColumnsRenamed({group: "_group", "newest": "_newest"})
    # Null is a group like any other.
    same = total[group].eqNullSafe(last["_group"]) & total["newest"].eqNullSafe(last["_newest"])
    both = total.join(last, same).drop("_group", "_newest")
    return _unpivot_fields(
        both,
        [group],
        {
            name: [
                F.col("total_seen") - F.col("recent_seen"),
                F.col(f"total_{i}") - F.col(f"recent_{i}"),
                F.col("recent_seen"),
                F.col(f"recent_{i}"),
            ]
            for i, name in enumerate(fields)
        },
        ["overall_seen", "overall_populated", "recent_seen", "recent_populated"],
    )


def expected_stats(stats: DataFrame, arrivals: DataFrame, registry: Registry) -> DataFrame:
    """The statistics of the fields that the parser of each provider's newest arrival expects."""
    # One row per provider.
    newest = arrivals.groupBy("provider").agg(F.max_by("parser_version", "seq").alias("_version"))
    expected = registry.expected_fields(version="_version")
    joined = stats.join(F.broadcast(newest), "provider")
    return joined.filter(F.expr(f"array_contains({expected}, field)")).drop("_version")


def _rates(df: DataFrame) -> DataFrame:
    return df.withColumn("overall_rate", F.try_divide("overall_populated", "overall_seen")).withColumn(
        "recent_rate", F.try_divide("recent_populated", "recent_seen")
    )


def _is_dark(limits: Thresholds) -> Column:
    return (
        (F.col("overall_seen") >= limits.min_overall)
        & (F.col("recent_seen") >= limits.min_recent)
        & (F.col("overall_rate") >= limits.high_rate)
        & (F.col("recent_rate") <= limits.low_rate)
    )


def _silent_null_columns(df: DataFrame) -> DataFrame:
    return df.withColumn("type", F.lit(SILENT_NULL)).withColumns(
        {
            "severity": F.when(F.col("field") == COST_FIELD, "critical").otherwise("warn"),
            "message": F.format_string(
                DARK_MESSAGE,
                "field",
                F.col("overall_rate") * 100,
                F.col("recent_rate") * 100,
                "recent_seen",
            ),
        }
    )


def silent_nulls(stats: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Fields that were reliably populated and are nearly always null in recent rows."""
    return _silent_null_columns(_rates(stats).filter(_is_dark(limits)))


# --- first arrival at which a field counts as gone ------------------------------------

FIELDS = list(FIELD_COLUMNS)
_AT = [f"at_{i}" for i in range(len(FIELDS))]
_POP = [f"pop_{i}" for i in range(len(FIELDS))]
_REC = [f"rec_{i}" for i in range(len(FIELDS))]
_NUMBERS = ["overall_seen", "overall_populated", "recent_seen", "recent_populated"]

#: What the detector needs of everything before a position, one row per provider: events seen, how
#: many have each field, and the most recent events with where their fields were filled.
STATE_SCHEMA = (
    f"provider string, seen bigint, {', '.join(f'{p} bigint' for p in _POP)}, "
    f"ring array<struct<first_seq: bigint, {', '.join(f'{a}: bigint' for a in _AT)}>>"
)


def field_moves(events: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Per event, its first position and, per field, the position it was first filled at.

    ``events`` is a :func:`fold_presence` result, the event table or a batch's summaries.  With
    ``existing``, the events before the batch, a known event is there only with the fields that the
    batch fills (``is_new`` is false).
    """
    def at(column: str) -> Column:
        if f"{column}_seq" in events.columns:
            return F.col(f"{column}_seq")
        return F.when(F.col(column).isNotNull(), F.col("first_seq"))  # set by the first arrival or never

    columns = list(FIELD_COLUMNS.values())
    if existing is None:
        placed = [at(column).alias(a) for a, column in zip(_AT, columns)]
        return events.select("provider", "first_seq", *placed, F.lit(True).alias("is_new"))
    known = existing.select(
        "dedup_key",
        F.col("first_seq").alias("_first"),
        *[F.col(f"{c}_seq").alias(f"_{c}_seq") for c in columns if f"{c}_seq" in events.columns],
    )
    fresh = F.col("_first").isNull()

    def filled(column: str) -> Column:
        if f"{column}_seq" not in events.columns:
            return F.when(fresh, at(column))
        return F.when(fresh | F.col(f"_{column}_seq").isNull(), at(column))

    moves = events.join(known, "dedup_key", "left").select(
        "provider",
        F.coalesce("_first", "first_seq").alias("first_seq"),
        *[filled(column).alias(a) for a, column in zip(_AT, columns)],
        fresh.alias("is_new"),
    )
    return moves.filter(F.col("is_new") | F.coalesce(*_AT).isNotNull())


def _with_leaving(events: DataFrame, window: int) -> DataFrame:
    """Add the position of the arrival that pushes each event out of the recent window.

    That is the first arrival of the event ``window`` ranks later.  Blocks of ranks carry
    the first ranks of the next block along to look that up.
    """
    size = 1 << BUCKET_BITS
    block = F.floor(F.col("rank") / size)
    blocks = F.when((F.col("rank") % size) < window, F.array(block, block - 1)).otherwise(F.array(block))
    in_block = Window.partitionBy("provider", "_block").orderBy("rank")
    return (
        ranked(events, "provider", "first_seq")
        .withColumn("_home", block)
        .withColumn("_block", F.explode(blocks))
        .withColumn("leaves", F.lead("first_seq", window).over(in_block))
        .filter("_block = _home")
        .drop("_block", "_home", "rank")
    )


def _ring(state: DataFrame, moves: DataFrame) -> DataFrame:
    """The recent events of a state, with the fields that ``moves`` fill."""
    fills = moves.filter(~F.col("is_new")).select("provider", "first_seq", *[F.col(a).alias(f"_{a}") for a in _AT])
    ring = state.select("provider", F.inline("ring")).join(fills, ["provider", "first_seq"], "left")
    return ring.select("provider", "first_seq", *[F.coalesce(a, f"_{a}").alias(a) for a in _AT])


def next_state(state: DataFrame, moves: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """The state after a batch: reads the state before it and the batch, nothing older."""
    added = moves.groupBy("provider").agg(
        F.count_if("is_new").alias("_seen"), *[F.count(a).alias(f"_{p}") for a, p in zip(_AT, _POP)]
    )
    events = _ring(state, moves).unionByName(moves.filter("is_new").drop("is_new"))
    latest = Window.partitionBy("provider").orderBy(F.col("first_seq").desc())
    last = events.withColumn("_rn", F.row_number().over(latest)).filter(F.col("_rn") <= limits.recent_window)
    ring = last.groupBy("provider").agg(F.array_sort(F.collect_list(F.struct("first_seq", *_AT))).alias("ring"))
    none = F.lit(0).cast("bigint")
    counted = state.drop("ring").join(added, "provider", "full").select(
        "provider",
        *[(F.coalesce(c, none) + F.coalesce(f"_{c}", none)).alias(c) for c in ("seen", *_POP)],
    )
    return counted.join(ring, "provider", "left")


def _resume(moves: DataFrame, state: DataFrame, since: int, window: int) -> tuple[DataFrame, DataFrame]:
    """Events that can still move a total after ``since``, and the totals reached there."""
    recent = _ring(state, moves).unionByName(moves.filter("is_new").drop("is_new"))
    moving = _with_leaving(cut(recent, "moving_events"), window)
    # Older events left the window before `since`.
    ring = state.select("provider", F.inline("ring"))
    late = moves.filter(~F.col("is_new")).drop("is_new").join(ring, ["provider", "first_seq"], "left_anti")
    base = state.select(
        "provider",
        F.lit(since).cast("bigint").alias("seq"),
        "seen",
        *_POP,
        *[F.size(F.array_compact(F.col(f"ring.{a}"))).cast("bigint").alias(c) for a, c in zip(_AT, _REC)],
    )
    return moving.unionByName(late.withColumn("leaves", F.lit(-1).cast("bigint"))), base


def _field_changes(placed: DataFrame) -> DataFrame:
    """One row per change of a total: its position and what it adds."""
    at = [F.col(a) for a in _AT]
    leaves = F.col("leaves")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def delta(seq: Column, seen: Column, pops: list[Column], recs: list[Column]) -> Column:
        return F.struct(
            seq.alias("seq"),
            seen.alias("seen"),
            *[p.alias(c) for c, p in zip(_POP, pops)],
            *[r.alias(c) for c, r in zip(_REC, recs)],
        )

    def flag(condition: Column, value: Column = one) -> Column:
        return F.when(condition, value).otherwise(zero)

    arrives = [flag(a == F.col("first_seq")) for a in at]
    nothing = [zero] * len(at)
    changes = [
        delta(F.col("first_seq"), one, arrives, arrives),
        F.when(leaves.isNotNull(), delta(leaves, zero, nothing, [flag(a < leaves, -one) for a in at])),
    ]
    for i, a in enumerate(at):
        if FIELD_COLUMNS[FIELDS[i]] in ("model", "raw_user_id"):
            continue  # set by the first arrival or never
        later = [one if j == i else zero for j in range(len(at))]
        recent = [flag(leaves.isNull() | (a < leaves)) if j == i else zero for j in range(len(at))]
        changes.append(F.when(a > F.col("first_seq"), delta(a, zero, later, recent)))
    return placed.select("provider", F.inline(F.filter(F.array(*changes), lambda c: c.isNotNull())))


def _first_judged(states: DataFrame, registry: Registry, arrivals: DataFrame | None, since: int) -> DataFrame:
    """Per provider and field, the first arrival whose own parser expects the field while it is gone.

    ``states`` has a row per arrival that changes a field's numbers.  A field that all versions of a
    provider expect is judged at every arrival, so the change itself is the first.  Other fields
    are judged at the arrivals whose version expects them, against the state as of each.
    """
    first = [F.min("seq").alias("seq"), *[F.min_by(n, "seq").alias(n) for n in _NUMBERS]]
    always = registry.by_provider(lambda p: _names(registry.agreed(p)))
    dark = states.filter(F.col("dark") & (F.col("seq") > since))
    fired = dark.filter(F.expr(f"array_contains({always}, field)")).groupBy("provider", "field").agg(*first)
    sometimes = {p: registry.contested(p) for p in registry.table if registry.contested(p)}
    if not sometimes:
        return fired
    if arrivals is None:
        raise ValueError(f"parser versions of {', '.join(sometimes)} expect different fields: arrivals are needed")
    contested = registry.by_provider(lambda p: _names(registry.contested(p)))
    asking = arrivals.filter(F.col("provider").isin(*sometimes)).select(
        "provider", "seq", F.explode(F.expr(f"array_intersect({registry.expected_fields()}, {contested})")).alias("field")
    )
    held = states.filter(F.expr(f"array_contains({contested}, field)")).select("provider", "field", "seq", *_NUMBERS, "dark")
    judged = as_of(held, asking, ["provider", "field"], "seq", [*_NUMBERS, "dark"])
    return fired.unionByName(
        judged.filter(F.col("dark") & (F.col("seq") > since)).groupBy("provider", "field").agg(*first)
    )


def _names(fields: tuple[str, ...]) -> str:
    return f"cast(array({', '.join(map(repr, fields))}) as array<string>)"


def first_fires(
    moves: DataFrame,
    registry: Registry,
    limits: Thresholds = DEFAULTS,
    arrivals: DataFrame | None = None,
    state: DataFrame | None = None,
    since: int = -1,
) -> DataFrame:
    """Per provider and field, the first arrival after ``since`` after which the field was gone.

    The detector conceptually runs after every arrival.  Its three inputs (events
    seen, events populated, populated among the most recent) only change at known
    arrivals, so they are running totals over a table of changes:

    * an event adds to ``seen`` at its first arrival;
    * it adds to ``pop`` when its field is first present;
    * it adds to ``rec`` at that point if it is then still recent, and is taken out of
      ``rec`` when enough later events have pushed it out of the window.

    ``moves`` comes from :func:`field_moves`; with ``state``, the totals start from it and
    ``moves`` are those of the arrivals after ``since`` only.  ``arrivals`` (provider, seq,
    parser_version) are needed where versions of a provider expect different fields.
    """
    window = limits.recent_window
    slim = cut(moves, "field_moves")
    if state is None:
        placed, base = _with_leaving(slim.drop("is_new"), window), None
    else:
        placed, base = _resume(slim, state, since, window)
    deltas = _field_changes(placed)
    if base is not None:
        deltas = deltas.filter(F.col("seq") > since).unionByName(base)
    measures = ["seen", *_POP, *_REC]
    # One row per arrival that changes anything, before ordering.
    per_seq = cut(deltas.groupBy("provider", "seq").agg(*[F.sum(m).alias(m) for m in measures]), "field_changes")
    totals = running_totals(per_seq, "provider", "seq", measures)
    recent_seen = F.least(F.col("seen"), F.lit(window).cast("bigint"))
    states = _unpivot_fields(
        totals,
        ["provider", "seq"],
        {
            name: [F.col("seen") - recent_seen, F.col(pop) - F.col(rec), recent_seen, F.col(rec)]
            for name, pop, rec in zip(FIELDS, _POP, _REC)
        },
        _NUMBERS,
    )
    judged = _rates(states).withColumn("dark", F.coalesce(_is_dark(limits), F.lit(False)))
    if any(registry.contested(p) for p in registry.table):
        judged = cut(judged, "field_states")
    return _silent_null_columns(_rates(_first_judged(judged, registry, arrivals, since)))


def silent_null_first_fire(
    events: DataFrame, registry: Registry, limits: Thresholds = DEFAULTS, arrivals: DataFrame | None = None
) -> DataFrame:
    """:func:`first_fires` over a whole load."""
    return first_fires(field_moves(events), registry, limits, arrivals)


# --- alert table ----------------------------------------------------------------------


def new_alerts(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates not raised before: by shape for structural ones, else by field.

    Each provider and shape, and each provider and field, raises once and never again.
    """
    same = (
        candidates["provider"].eqNullSafe(existing["provider"])
        & candidates["type"].eqNullSafe(existing["type"])
        & candidates["field"].eqNullSafe(existing["field"])
        & candidates["fingerprint"].eqNullSafe(existing["fingerprint"])
    )
    return candidates.join(existing, same, "left_anti")


def number_alerts(alerts: DataFrame, start: int = 0) -> DataFrame:
    """Give alerts their ids in the order they were raised."""
    field_order = F.array_position(F.array(*[F.lit(n) for n in FIELD_COLUMNS]), F.col("field"))
    tiebreak = (F.col("type").desc(), field_order, F.col("fingerprint"))
    one_group = alerts.withColumn("_all", F.lit(0))
    return ranked(one_group, "_all", "seq", "id", tiebreak).drop("_all").withColumn("id", F.col("id") + start)


def alerts_table(
    structural: DataFrame, silent: DataFrame, received: DataFrame, raised: DataFrame | None = None
) -> DataFrame:
    """All alerts of a load in the order a one-by-one ingest would have raised them.

    ``received`` maps seq to received_at; ``raised`` holds the alerts that exist already.
    """
    both = structural.unionByName(
        silent.select(
            "seq", "provider", "type", "severity", "field", "message",
            "overall_rate", "recent_rate", "overall_seen", "recent_seen",
        ),
        allowMissingColumns=True,
    )
    start = 0
    if raised is not None:
        both = new_alerts(both, raised)
        start = raised.count()
    both = cut(both, "alerts")
    stamped = received.select("seq", F.col("received_at").alias("created_at")).join(both, "seq", "right")
    return number_alerts(cut(stamped, "stamped_alerts"), start)


def latest_first(alerts: DataFrame) -> DataFrame:
    """Alerts with their place in the list that shows the newest first."""
    ahead = alerts.select((-F.unix_micros("created_at")).alias("_age"), (-F.col("id")).alias("_later"), *alerts.columns)
    one_group = ahead.withColumn("_all", F.lit(0))
    listed = ranked(cut(one_group, "alert_list"), "_all", "_age", "place", (F.col("_later"),))
    return listed.drop("_all", "_age", "_later")


def with_raised(results: DataFrame, alerts: DataFrame) -> DataFrame:
    """Results of an ingest with the alerts that each arrival raised, in the order of their ids."""
    raised = alerts.groupBy("seq").agg(
        F.array_sort(F.collect_list(F.struct("id", "type", "severity", "field", "message"))).alias("alerts")
    )
    none = F.expr(f"cast(array() as {dict(raised.dtypes)['alerts']})")
    return results.join(raised, "seq", "left").withColumn("alerts", F.coalesce("alerts", none))
