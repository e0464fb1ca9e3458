"""The tables a load produces, derived step by step from the arrivals."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, fold, forensics, replay
from ..operators.normalize import accepted, normalize, quarantined
from ..operators.registry import Registry, build_registry
from ..session import cut
from . import fixture


_LOADS: dict[tuple[str, str], Tables] = {}


class Tables:
    """Lazily defined tables over one source.

    ``events`` and ``corpus`` are plans; the ``stored_`` properties are the same tables
    written once to the shared folder, for reports that read them several times.
    """

    def __init__(self, arrivals: DataFrame, registry: Registry | None = None):
        self.arrivals = arrivals
        self.registry = registry or build_registry()

    @classmethod
    def from_source(cls, spark: SparkSession, sf_dir: str, registry: Registry | None = None) -> Tables:
        return cls(fixture.arrivals(spark, sf_dir), registry)

    @classmethod
    def stored_load(cls, spark: SparkSession, sf_dir: str) -> Tables:
        """The load whose stored tables the forensic reports of this session read.

        They are built on first use and then read like any other table.
        """
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in _LOADS:
            _LOADS[key] = cls.from_source(spark, sf_dir)
        return _LOADS[key]

    @cached_property
    def normalized(self) -> DataFrame:
        return normalize(self.arrivals, self.registry)

    @cached_property
    def accepted(self) -> DataFrame:
        return accepted(self.normalized)

    @cached_property
    def quarantine(self) -> DataFrame:
        return quarantined(self.normalized)

    @cached_property
    def folded(self) -> DataFrame:
        return fold.fold_events(self.accepted)

    @cached_property
    def presence(self) -> DataFrame:
        return fold.fold_presence(self.accepted)

    @cached_property
    def events(self) -> DataFrame:
        return fold.events_table(self.stored_light)

    @cached_property
    def corpus(self) -> DataFrame:
        return fold.corpus_table(self.stored_accepted)

    def light_corpus(self, *fields: str) -> DataFrame:
        """Some fields of the stored payloads, straight from the source."""
        return fold.corpus_table(self.accepted, fields)

    @cached_property
    def stored_accepted(self) -> DataFrame:
        """Accepted rows parsed once and written; later steps read the columns they need."""
        return cut(self.accepted.drop("version", "parse_reasons", "store_reasons"), "accepted")

    @cached_property
    def stored_light(self) -> DataFrame:
        """Accepted rows without payload texts, for jobs that only count and compare.

        A load that is stored already serves as it is.
        """
        if "stored_accepted" in self.__dict__:
            return self.stored_accepted
        return cut(self.accepted.drop("payload", "version", "parse_reasons", "store_reasons"), "accepted_light")

    @cached_property
    def stored_events(self) -> DataFrame:
        return cut(fold.events_table(self.stored_accepted), "events")

    @cached_property
    def stored_corpus(self) -> DataFrame:
        return cut(fold.corpus_table(self.stored_accepted), "corpus")

    @cached_property
    def known(self) -> tuple[DataFrame, DataFrame]:
        """Shapes and paths of the stored payloads."""
        return drift.known_of(fold.corpus_table(self.stored_light, ("provider", "shape_key")))

    @cached_property
    def alerts(self) -> DataFrame:
        rows = self.stored_light
        structural = drift.structural_alerts(rows, None, self.known)
        silent = drift.silent_null_first_fire(fold.fold_presence(rows), self.registry, arrivals=rows)
        return drift.alerts_table(structural, silent, rows)

    @cached_property
    def stored_alerts(self) -> DataFrame:
        return cut(self.alerts, "alerts")

    def replay(self, registry: Registry) -> DataFrame:
        return replay.replay_rows(self.corpus, registry)

    @cached_property
    def latest_registry(self) -> Registry:
        """What reports replay with: the load's parsers and every later version known."""
        return build_registry(openai_v2=True)

    @cached_property
    def stored_index(self) -> DataFrame:
        return cut(forensics.alert_index(self.stored_alerts), "alert_index")

    def facts(self, registry: Registry) -> DataFrame:
        """What event reports need to know of each provider, replayed with ``registry``."""
        rows = replay.replay_rows(self.stored_corpus, registry)
        matrix = cut(replay.replay_matrix(rows, registry), "replay_matrix")
        refused = matrix.agg(F.sum("throw")).first()[0]
        failures = replay.replay_failures(rows, self.stored_corpus) if refused else None
        return cut(forensics.provider_facts(self.stored_events, self.stored_corpus, matrix, failures), "provider_facts")

    @cached_property
    def stored_facts(self) -> DataFrame:
        return self.facts(self.latest_registry)
