"""Arrivals to canonical columns, with rejection reasons instead of exceptions.

Everything is column expressions over one parsed VARIANT per row, so a scan of the
arrivals stays in the JVM, needs no shuffle, and computes only the columns a later
step asks for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ecma, identity, paths, variants
from .registry import PROVIDERS, EventType, Parser, Registry

EPOCH_TEXT = "1970-01-01T00:00:00.000Z"
# Years 1 to 9999, the range a four-digit year can name.
MILLIS_RANGE = "-62135596800000D and 253402300799999D"
INT_RANGE = "-2147483648 and 2147483647"

# A UTC date-time: seconds and their fraction are optional, an offset is not allowed.
_UTC_TEXT = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9]([.][0-9]+)?)?Z$"

GOLDEN_FIELDS = (
    "dedup_key",
    "provider",
    "occurred_at_text",
    "event_type",
    "model",
    "raw_user_id",
    "input_tokens",
    "output_tokens",
    "cost_value",
)

# Raw fields a parser locates, and for the typed ones: output column, canonical
# field name, reader, and the code for a value of the wrong type.
_RAW = ("id", "model", "user", "input_tokens", "output_tokens", "cost", "clock")
_TYPED = {
    "model": ("model", "model", variants.as_string, "not_string"),
    "user": ("raw_user_id", "actor.raw_user_id", variants.as_string, "not_string"),
    "input_tokens": ("input_tokens", "usage.input_tokens", variants.as_double, "not_number"),
    "output_tokens": ("output_tokens", "usage.output_tokens", variants.as_double, "not_number"),
    "cost": ("cost_value", "cost.amount_usd", variants.as_double, "not_number"),
}
_TYPED_COLUMNS = [column for column, _, _, _ in _TYPED.values()]


def route(arrivals: DataFrame, registry: Registry) -> DataFrame:
    """Add ``parser_version``: the pinned version (0 and NULL mean none), else the latest.

    NULL where no such parser is registered.
    """
    latest = registry.by_provider(lambda name: str(registry.newest(name).version))
    wanted = f"coalesce(if(version != 0, version, null), {latest})"
    known = f"concat_ws(':', provider, {wanted}) in ({_quoted(p.key for p in registry.parsers)})"
    return arrivals.withColumn("parser_version", F.expr(f"if({known}, {wanted}, null)"))


def _quoted(names) -> str:
    return ", ".join(f"'{name}'" for name in names)


def _pick(parsers: list[Parser], attribute: Callable[[Parser], object], build: Callable[[object], str]) -> str:
    """CASE over parsers, with one branch for all parsers that agree on ``attribute``."""
    groups: dict[object, list[str]] = {}
    for parser in parsers:
        groups.setdefault(attribute(parser), []).append(parser.key)
    branches = [f"when _route in ({_quoted(keys)}) then {build(value)}" for value, keys in groups.items()]
    return f"case {' '.join(branches)} end"


def _event_type(spec: EventType) -> str:
    if spec.path is None:
        return f"'{spec.default}'"
    text = f"try_variant_get(_doc, '$.{spec.path}', 'string')"
    branches = " ".join(f"when '{raw}' then '{name}'" for raw, name in spec.when)
    return f"case {text} {branches} else '{spec.default}' end"


_CLOCK_MISSING = "coalesce(_clock_type, 'VOID') = 'VOID'"
_IS_EPOCH = "_clock_kind = 'epoch_seconds'"


def _millis() -> str:
    """The clock of an epoch parser as milliseconds."""
    number = ecma.number_from("_clock", "_clock_type")
    return f"case when {_IS_EPOCH} then if({_CLOCK_MISSING}, 0D, {number} * 1000) end"


def _iso() -> str:
    """The clock of the other parsers as text."""
    text = variants.as_string("_clock", "_clock_type")
    return f"if({_IS_EPOCH}, null, if({_CLOCK_MISSING}, '{EPOCH_TEXT}', {text}))"


def _occurred_at_text() -> str:
    # A cast to an integer cuts fractions of a millisecond towards zero.
    stamp = """date_format(timestamp_millis(cast(_millis as bigint)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")"""
    return f"if({_IS_EPOCH}, if(_millis between {MILLIS_RANGE}, {stamp}, null), _iso)"


def _reasons(conditions: list[tuple[str, str]]) -> str:
    """The codes whose condition holds, joined; empty text if there are none."""
    return f"concat_ws(';', {', '.join(f'''if({bad}, '{code}', null)''' for code, bad in conditions)})"


def _parse_reasons(registry: Registry) -> str:
    known = f"coalesce(provider in ({_quoted(PROVIDERS)}), false)"
    routed = "(parser_version is not null and _is_object)"
    stamped = f"(occurred_at is not null and occurred_at_text rlike '{_UTC_TEXT}')"
    checks = [
        ("provider:unknown", f"not {known}"),
        ("payload:missing", "payload is null"),
        ("payload:invalid_json", "payload is not null and _doc is null"),
        ("payload:not_object", "_doc is not null and not _is_object"),
        ("version:not_registered", f"{known} and parser_version is null"),
        ("occurred_at:not_datetime", f"{routed} and not coalesce({stamped}, false)"),
    ]
    for name, (column, field, _, code) in _TYPED.items():
        present = f"coalesce(_{name}_type, 'VOID') != 'VOID'"
        checks.append((f"{field}:{code}", f"{present} and {column} is null"))
        needed_by = [p.key for p in registry.parsers if field in p.required]
        if needed_by:
            checks.append((f"{field}:required", f"{routed} and not {present} and _route in ({_quoted(needed_by)})"))
    return _reasons(checks)


def _store_reasons() -> str:
    def not_int(column: str) -> str:
        return f"{column} is not null and ({column} != floor({column}) or not {column} between {INT_RANGE})"

    return _reasons(
        [
            ("usage.input_tokens:not_int32", not_int("input_tokens")),
            ("usage.output_tokens:not_int32", not_int("output_tokens")),
            (
                "cost.amount_usd:out_of_range",
                "cost_value is not null and (isnan(cost_value) or abs(cost_value) = double('Infinity'))",
            ),
            ("occurred_at:out_of_range", "startswith(occurred_at_text, '0000-')"),
            # Stored text cannot hold the character NUL, which JSON can only escape.
            (
                "payload:nul_text",
                r"payload rlike r'\\u0000' and contains(replace(payload, r'\\', ''), r'\u0000')",
            ),
        ]
    )


def normalize(arrivals: DataFrame, registry: Registry) -> DataFrame:
    """Route, parse, type-check and identify every arrival.

    Adds the canonical columns, ``content_hash`` and ``shape_key``, and two reason
    texts: ``parse_reasons`` (the parser refuses the payload) and ``store_reasons``
    (the event table could not hold the values).  A row is accepted when both are empty.

    The steps are separate projections on purpose: each value that later steps read
    more than once (the parsed document, a raw field, its type) is computed once.
    ``arrivals`` may bring its parsed documents as ``_doc``.
    """
    parsers = registry.parsers
    source = [f"`{c}`" for c in arrivals.columns if c != "_doc"]
    parsed = "_doc" if "_doc" in arrivals.columns else "try_parse_json(payload) as _doc"
    doc = route(arrivals, registry).selectExpr(
        *source, "parser_version", "concat_ws(':', provider, parser_version) as _route", parsed
    )

    def locate(name: str) -> str:
        where = (lambda p: p.clock[1:]) if name == "clock" else (lambda p: getattr(p, name))
        return f"{_pick(parsers, where, lambda at: variants.first_present('_doc', at))} as _{name}"

    kept = [*source, "parser_version", "_route", "_doc"]
    raw = doc.selectExpr(
        *kept,
        *[locate(name) for name in _RAW],
        f"{_pick(parsers, lambda p: p.clock[0], lambda kind: repr(kind))} as _clock_kind",
        f"{_pick(parsers, lambda p: p.event_type, _event_type)} as event_type",
        "schema_of_variant(_doc) as _doc_type",
    )
    typed = raw.selectExpr("*", *[f"schema_of_variant(_{name}) as _{name}_type" for name in _RAW])
    kinds = [f"_{name}_type" for name in _RAW]
    values = typed.selectExpr(
        *kept,
        "_id",
        *kinds,
        "_doc_type",
        "coalesce(startswith(_doc_type, 'OBJECT'), false) as _is_object",
        "event_type",
        "_clock_kind",
        f"{_millis()} as _millis",
        f"{_iso()} as _iso",
        f"{variants.as_string('_id', '_id_type')} as _id_text",
        *[f"{read(f'_{n}', f'_{n}_type')} as {column}" for n, (column, _, read, _) in _TYPED.items()],
    )
    checked = values.selectExpr(
        "*",
        f"{_occurred_at_text()} as occurred_at_text",
        f"{_store_reasons()} as store_reasons",
        "to_json(_doc) as _text",
    )
    key = identity.dedup_key("provider", "_id", "_id_type", "_id_text", "occurred_at_text", "model", "raw_user_id", "_doc")
    hashed = checked.selectExpr(
        "*",
        f"{identity.content_hash('_text')} as content_hash",
        "try_cast(occurred_at_text as timestamp) as occurred_at",
        f"{key} as dedup_key",
    )
    judged = hashed.selectExpr(
        "*",
        # The partition id makes this projection non-deterministic to the optimizer, so
        # a filter on the reasons stays above it.  Pushed below, the filter would
        # repeat the whole extraction that the projection does anyway.
        f"if(spark_partition_id() >= 0, {_parse_reasons(registry)}, null) as parse_reasons",
        f"{paths.shape_key('_doc', '_doc_type')} as shape_key",
    )
    return judged.selectExpr(
        *source,
        "parser_version",
        "dedup_key",
        "occurred_at_text",
        "occurred_at",
        "event_type",
        *_TYPED_COLUMNS,
        "cost_value as cost_amount_usd",
        "content_hash",
        "shape_key",
        "parse_reasons",
        "store_reasons",
    )


def with_event_id(df: DataFrame, key: str = "dedup_key", name: str = "event_id") -> DataFrame:
    """Add the UUID derived from a key column."""
    return (
        df.withColumn("_seed", F.sha2(key, 256))
        .withColumn(name, F.expr(identity.uuid_from("_seed")))
        .drop("_seed")
    )


def reject_reasons() -> Column:
    """All reasons of a normalized row, in checking order."""
    return F.expr("concat_ws(';', nullif(parse_reasons, ''), nullif(store_reasons, ''))")


def accepted(normalized: DataFrame) -> DataFrame:
    """Rows without a reason, with token counts in the event table's integer type."""
    return normalized.filter("parse_reasons = '' and store_reasons = ''").withColumns(
        {
            "input_tokens": F.col("input_tokens").cast("int"),
            "output_tokens": F.col("output_tokens").cast("int"),
        }
    )


def quarantined(normalized: DataFrame) -> DataFrame:
    """Rows with at least one reason; they never reach a table."""
    return normalized.filter("parse_reasons != '' or store_reasons != ''").withColumn("reason", reject_reasons())


def golden() -> Column:
    """The part of a canonical event a parser answers for, as one comparable struct.

    Token counts compare as plain JSON numbers, before the table's integer type.
    """
    as_number = {"input_tokens", "output_tokens"}
    return F.struct(
        *[(F.col(n).cast("double") if n in as_number else F.col(n)).alias(n) for n in GOLDEN_FIELDS]
    )
