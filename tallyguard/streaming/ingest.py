"""Continuous ingest: micro-batches of arrivals into appended tables.

Each micro-batch runs the batch operators and appends what it found: new payloads, one summary per
event it touched, results, alerts, refused arrivals.  Events are the merged summaries of their key.
The detector of silent nulls goes on from a state of one row per provider, so a batch reads its
own rows and that state, however long the history is.  All tables of a batch become visible with its
commit, which is written last; a batch that runs again after its commit does nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from ..operators import drift, fold
from ..operators.normalize import accepted, normalize, quarantined
from ..operators.registry import Registry
from ..session import cut, intermediate_tables, prepare
from ..sources.snapshots import committed, publish, read_batches

CORPUS_SCHEMA = """content_hash string, seq bigint, provider string, received_at timestamp, parser_version int,
    payload string, shape_key string, dedup_key string, occurred_at_text string, event_type string, model string,
    raw_user_id string, input_tokens int, output_tokens int, cost_value double"""
RUN_SCHEMA = """dedup_key string, provider string, occurred_at_text string, occurred_at timestamp, event_type string,
    model string, raw_user_id string, ingested_at timestamp, first_seq bigint, last_seq bigint, changes bigint,
    head_input_tokens int, head_output_tokens int, head_cost_amount_usd double,
    head_seq_input_tokens bigint, head_seq_output_tokens bigint, head_seq_cost_amount_usd bigint,
    input_tokens int, output_tokens int, cost_amount_usd double,
    input_tokens_seq bigint, output_tokens_seq bigint, cost_amount_usd_seq bigint,
    content_hash string, parser_version int, shape_key string"""
SHAPE_SCHEMA = "provider string, shape_key string, seq bigint"
ALERT_LIST = "array<struct<id: bigint, type: string, severity: string, field: string, message: string>>"
RESULT_SCHEMA = f"""seq bigint, provider string, dedup_key string, event_id string, inserted boolean, revision int,
    alerts {ALERT_LIST}"""
QUARANTINE_SCHEMA = "seq bigint, received_at timestamp, provider string, version int, payload string, reason string"
#: Per batch: its positions, its summaries, and the compacted table to read summaries from.
COMMIT_SCHEMA = "batch bigint, first_seq bigint, last_seq bigint, runs bigint, base bigint, base_runs bigint"

#: Summaries below this number are not worth compacting.
LEAST_COMPACTED = 100_000


def _columns(schema: str) -> list[str]:
    return StructType.fromDDL(schema).names


@dataclass
class IngestJob:
    """Ingest into tables under ``root``, a folder all executors share."""

    spark: SparkSession
    root: str
    registry: Registry
    limits: drift.Thresholds = drift.DEFAULTS
    least_compacted: int = LEAST_COMPACTED

    def _read(self, table: str, schema: str, before: int | None = None) -> DataFrame:
        return read_batches(self.spark, f"{self.root}/{table}", schema, committed(self.spark, self.root, before))

    def _write(self, df: DataFrame, table: str, schema: str, batch: int) -> None:
        publish(df.select(*_columns(schema)), f"{self.root}/{table}", batch)

    def _last_commit(self, before: int | None = None):
        batches = committed(self.spark, self.root, before)[-1:]
        return read_batches(self.spark, f"{self.root}/commits", COMMIT_SCHEMA, batches).first()

    def runs(self, before: int | None = None) -> DataFrame:
        """Summaries of events, one per key and batch, older batches compacted to one per key."""
        last = self._last_commit(before)
        if last is None:
            return read_batches(self.spark, f"{self.root}/runs", RUN_SCHEMA, [])
        later = [b for b in committed(self.spark, self.root, before) if b > last.base]
        parts = read_batches(self.spark, f"{self.root}/runs", RUN_SCHEMA, later)
        if last.base < 0:
            return parts
        return read_batches(self.spark, f"{self.root}/base", RUN_SCHEMA, [last.base]).unionByName(parts)

    def events(self, before: int | None = None) -> DataFrame:
        return fold.events_from(fold.merge_summaries(self.runs(before)))

    def corpus(self, before: int | None = None) -> DataFrame:
        return self._read("corpus", CORPUS_SCHEMA, before)

    def alerts(self, before: int | None = None) -> DataFrame:
        return self._read("alerts", drift.ALERT_SCHEMA, before)

    def quarantine(self) -> DataFrame:
        return self._read("quarantine", QUARANTINE_SCHEMA)

    def results(self) -> DataFrame:
        """Per arrival, inserted flag, revision and the alerts it raised."""
        return self._read("results", RESULT_SCHEMA)

    def detector_state(self, before: int | None = None) -> DataFrame:
        """One row per provider, as the last batch left it."""
        last = committed(self.spark, self.root, before)[-1:]
        return read_batches(self.spark, f"{self.root}/state", drift.STATE_SCHEMA, last)

    def _shapes(self, before: int) -> DataFrame:
        return self._read("shapes", SHAPE_SCHEMA, before)

    def run_batch(self, arrivals: DataFrame, batch: int) -> None:
        """Process one batch; its sequence numbers must follow those of earlier batches."""
        prepare(self.spark)
        if batch in committed(self.spark, self.root):
            return
        with intermediate_tables(self.spark):
            self._run(arrivals, batch)

    def _run(self, arrivals: DataFrame, batch: int) -> None:
        # Parsed once, read for both outcomes.
        rows = cut(normalize(arrivals, self.registry), "normalized")
        span = self._checked_span(rows, batch)
        self._write(quarantined(rows), "quarantine", QUARANTINE_SCHEMA, batch)
        good = cut(accepted(rows), "accepted")

        known = self.corpus(before=batch).select("content_hash")
        new_corpus = cut(fold.corpus_table(good).join(known, "content_hash", "left_anti"), "new_corpus")
        self._write(new_corpus, "corpus", CORPUS_SCHEMA, batch)

        runs = cut(fold.summaries(good), "runs")
        self._write(runs, "runs", RUN_SCHEMA, batch)
        touched = self.runs(before=batch).join(runs.select("dedup_key"), "dedup_key", "left_semi")
        existing = cut(fold.events_from(fold.merge_summaries(touched)), "existing")

        raised = self._alerts(good, new_corpus, drift.field_moves(runs, existing), span, batch)
        results = drift.with_raised(fold.ingest_results(good, existing), raised)
        self._write(results, "results", RESULT_SCHEMA, batch)
        self._commit(runs, span, batch)

    def _checked_span(self, rows: DataFrame, batch: int) -> tuple[int | None, int | None]:
        """First and last position; fails a batch that does not follow those before it.

        Revisions and alerts depend on the order, and earlier results are not revised.
        """
        first, last = rows.agg(F.min("seq"), F.max("seq")).first()
        before = self._last_commit(batch)
        if before is None or before.last_seq is None:
            return first, last
        if first is not None and first <= before.last_seq:
            raise ValueError(f"batch {batch} starts at position {first}, but {before.last_seq} was already ingested")
        # An empty batch does not move the end.
        return first, max(before.last_seq, last if last is not None else before.last_seq)

    def _alerts(
        self, good: DataFrame, new_corpus: DataFrame, moves: DataFrame, span: tuple[int | None, int | None], batch: int
    ) -> DataFrame:
        shapes = cut(new_corpus.groupBy("provider", "shape_key").agg(F.min("seq").alias("seq")), "new_shapes")
        stored = self._shapes(before=batch).unionByName(shapes)
        structural = drift.structural_alerts(good, stored)
        # Arrival order is total, so the batch's first position separates it from the past.
        since = -1 if span[0] is None else span[0] - 1
        moves, state = cut(moves, "moves"), self.detector_state(before=batch)
        silent = drift.first_fires(moves, self.registry, self.limits, good, state, since)
        raised = cut(self.alerts(before=batch), "raised")
        table = cut(drift.alerts_table(structural, silent, good, raised), "new_alerts")
        self._write(table, "alerts", drift.ALERT_SCHEMA, batch)
        self._write(shapes, "shapes", SHAPE_SCHEMA, batch)
        self._write(drift.next_state(state, moves, self.limits), "state", drift.STATE_SCHEMA, batch)
        return table

    def _commit(self, runs: DataFrame, span: tuple[int | None, int | None], batch: int) -> None:
        """Make the batch visible; compact summaries once as many were added as are compacted.

        Compaction so costs each summary a number of rewrites that grows with the logarithm of the
        history, and other batches write their own summaries only.
        """
        before = self._last_commit(batch)
        base, base_runs, earlier = (-1, 0, 0) if before is None else (before.base, before.base_runs, before.runs)
        added = earlier + runs.count()
        if added >= max(base_runs, self.least_compacted):
            merged = fold.merge_summaries(self.runs(before=batch).unionByName(runs.select(*_columns(RUN_SCHEMA))))
            self._write(merged, "base", RUN_SCHEMA, batch)
            base_runs = read_batches(self.spark, f"{self.root}/base", RUN_SCHEMA, [batch]).count()
            base, added = batch, 0
        row = [(batch, *span, added, base, base_runs)]
        publish(self.spark.createDataFrame(row, COMMIT_SCHEMA).coalesce(1), f"{self.root}/commits", batch)

    def writer(self, arrivals: DataFrame, checkpoint: str) -> DataStreamWriter:
        return arrivals.writeStream.foreachBatch(self.run_batch).option("checkpointLocation", checkpoint)

    def start(self, arrivals: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        writer = self.writer(arrivals, checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
