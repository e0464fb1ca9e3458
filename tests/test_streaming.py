"""Micro-batches give what one batch gives, also when a batch runs twice."""

from pyspark.sql import functions as F

from tallyguard.operators import drift, fold
from tallyguard.operators.registry import build_registry
from tallyguard.plans.tables import Tables
from tallyguard.sources.arrivals import stream_arrivals
from tallyguard.streaming.ingest import IngestJob

from .test_model import LIMITS, random_load

ALERT = ["id", "seq", "provider", "type", "field", "message", "fingerprint", "overall_seen", "recent_rate", "created_at"]
EVENT = ["dedup_key", "event_id", "revision", "cost_amount_usd", "input_tokens", "first_seq", "last_seq", "content_hash"]


def same(left, right, columns):
    left, right = left.select(*columns), right.select(*columns)
    assert left.count() == right.count()
    assert left.exceptAll(right).count() == 0


def test_stream_equals_batch(spark, make_arrivals, tmp_path):
    arrivals = make_arrivals(random_load(11, 200), 30011)
    source = str(tmp_path / "arrivals")
    edges = [0, 120 * 30011, 170 * 30011, 1 << 60]
    job = IngestJob(spark, str(tmp_path / "tables"), build_registry(), LIMITS, least_compacted=60)
    for low, high in zip(edges, edges[1:]):
        part = arrivals.filter((F.col("seq") >= low) & (F.col("seq") < high))
        part.coalesce(1).write.mode("append").parquet(source)
        stream = stream_arrivals(spark, source, files_per_batch=10)
        job.start(stream, str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    # The last batch once more, as after a lost driver.
    job.run_batch(arrivals.filter(F.col("seq") >= edges[-2]), 2)

    t = Tables(arrivals)
    rows = t.stored_accepted
    same(job.events(), t.events, EVENT)
    same(job.corpus(), t.corpus, ["content_hash", "seq", "provider", "payload"])
    same(job.results(), fold.ingest_results(rows), ["seq", "inserted", "revision", "event_id"])
    same(job.quarantine(), t.quarantine, ["seq", "reason"])
    structural = drift.structural_alerts(rows, fold.corpus_table(rows, ("provider", "shape_key")))
    silent = drift.silent_null_first_fire(fold.fold_presence(rows), t.registry, LIMITS)
    expected = drift.alerts_table(structural, silent, rows)
    assert expected.count() > 2
    same(job.alerts(), expected, ALERT)
