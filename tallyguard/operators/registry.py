"""Versioned parsers, declared as data.

A parser says where in a provider's payload each canonical field lives.  Parsers are
turned into column expressions by :mod:`tallyguard.operators.normalize`; nothing here
touches rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# The closed sets of the canonical event.
PROVIDERS = ("openai", "anthropic", "cursor")
EVENT_TYPES = ("chat", "completion", "edit")

# Measurable canonical fields and the event columns that hold them,
# in the order alerts and reports list them.
FIELD_COLUMNS = {
    "model": "model",
    "usage.input_tokens": "input_tokens",
    "usage.output_tokens": "output_tokens",
    "cost.amount_usd": "cost_amount_usd",
    "actor.raw_user_id": "raw_user_id",
}
COST_FIELD = "cost.amount_usd"


@dataclass(frozen=True)
class EventType:
    """A constant event type, or one chosen by the text at a path."""

    default: str
    path: str | None = None
    when: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Parser:
    """Where one version of one provider's payload keeps the canonical fields.

    Each path tuple is tried in order; the first value that is not null wins.
    ``clock`` is ``("epoch_seconds", path)`` or ``("iso_text", path)``.  Fields in
    ``required`` must be present, or the payload is rejected.
    """

    provider: str
    version: int
    clock: tuple[str, str]
    event_type: EventType
    id: tuple[str, ...]
    model: tuple[str, ...]
    user: tuple[str, ...]
    input_tokens: tuple[str, ...]
    output_tokens: tuple[str, ...]
    cost: tuple[str, ...]
    expects: tuple[str, ...] = tuple(FIELD_COLUMNS)
    required: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.provider}:{self.version}"


class Registry:
    """A table of parsers, provider -> version -> parser, and the SQL that reads it.

    It never changes, so plans built from it are stable.  Providers keep the order in which
    they came, versions ascend; a later parser replaces an equal version.
    """

    def __init__(self, parsers: Iterable[Parser] = ()):
        table: dict[str, dict[int, Parser]] = {}
        for parser in parsers:
            table.setdefault(parser.provider, {})[parser.version] = parser
        self.table = {provider: dict(sorted(known.items())) for provider, known in table.items()}

    @property
    def parsers(self) -> list[Parser]:
        return [parser for known in self.table.values() for parser in known.values()]

    def plus(self, parser: Parser) -> Registry:
        return Registry([*self.parsers, parser])

    def newest(self, provider: str) -> Parser:
        return self.table[provider][max(self.table[provider])]

    def agreed(self, provider: str) -> tuple[str, ...]:
        """Fields that every version of a provider expects."""
        known = [set(parser.expects) for parser in self.table[provider].values()]
        return tuple(field for field in FIELD_COLUMNS if all(field in fields for fields in known))

    def contested(self, provider: str) -> tuple[str, ...]:
        """Measurable fields that some versions of a provider expect and others do not."""
        known = [set(parser.expects) for parser in self.table[provider].values()]
        return tuple(field for field in FIELD_COLUMNS if 0 < sum(field in fields for fields in known) < len(known))

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per parser; the row count is the registry's own size."""
        rows = [(p.provider, p.version, list(p.expects)) for p in self.parsers]
        return spark.createDataFrame(rows, "provider string, version int, expects array<string>")

    def by_provider(self, value: Callable[[str], str], column: str = "provider") -> str:
        """SQL CASE over a provider column."""
        branches = " ".join(f"when '{name}' then {value(name)}" for name in self.table)
        return f"case {column} {branches} end"

    def version_list(self, column: str = "provider") -> str:
        """SQL for the registered versions of a provider, ascending."""
        return self.by_provider(lambda name: f"array({', '.join(map(str, self.table[name]))})", column)

    def expected_fields(self, provider: str = "provider", version: str = "parser_version") -> str:
        """SQL for the expected field names of a parser; empty if it is not registered."""
        branches = " ".join(
            f"when '{p.key}' then array({', '.join(repr(e) for e in p.expects)})" for p in self.parsers
        )
        return f"case concat_ws(':', {provider}, {version}) {branches} else cast(array() as array<string>) end"


OPENAI_V1 = Parser(
    provider="openai",
    version=1,
    clock=("epoch_seconds", "created"),
    event_type=EventType("chat", "object", (("text.completion", "completion"),)),
    id=("id",),
    model=("model",),
    user=("user",),
    input_tokens=("usage.prompt_tokens",),
    output_tokens=("usage.completion_tokens",),
    cost=("cost.amount_usd",),
)

# Cost moved one level down; the old place is still read.
OPENAI_V2 = Parser(
    provider="openai",
    version=2,
    clock=OPENAI_V1.clock,
    event_type=OPENAI_V1.event_type,
    id=OPENAI_V1.id,
    model=OPENAI_V1.model,
    user=OPENAI_V1.user,
    input_tokens=OPENAI_V1.input_tokens,
    output_tokens=OPENAI_V1.output_tokens,
    cost=("pricing.cost.amount_usd", "cost.amount_usd"),
)

ANTHROPIC_V1 = Parser(
    provider="anthropic",
    version=1,
    clock=("iso_text", "created_at"),
    event_type=EventType("chat"),
    id=("id",),
    model=("model",),
    user=("metadata.user_id",),
    input_tokens=("usage.input_tokens",),
    output_tokens=("usage.output_tokens",),
    cost=("cost_usd",),
)

CURSOR_V1 = Parser(
    provider="cursor",
    version=1,
    clock=("iso_text", "timestamp"),
    event_type=EventType("edit"),
    id=("request_id",),
    model=("model",),
    user=("user.id",),
    input_tokens=("tokens.in",),
    output_tokens=("tokens.out",),
    cost=("billing.usd",),
)


def build_registry(openai_v2: bool = False) -> Registry:
    """The known parsers; the second openai version is opt-in."""
    parsers = [OPENAI_V1, ANTHROPIC_V1, CURSOR_V1]
    return Registry([*parsers, OPENAI_V2] if openai_v2 else parsers)
