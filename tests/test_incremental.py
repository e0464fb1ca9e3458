"""Work that goes on from earlier results: summaries of runs, detector state, commits."""

import json

import pytest
from pyspark.sql import functions as F

from tallyguard.functions.exact import exact_sums
from tallyguard.operators import drift, fold, prefix, reports
from tallyguard.operators.normalize import accepted, normalize
from tallyguard.operators.registry import OPENAI_V1, Parser, Registry, build_registry
from tallyguard.session import cut
from tallyguard.sources.snapshots import committed
from tallyguard.streaming.ingest import IngestJob

from .model import FIELDS, Model, parse
from .test_model import LIMITS, random_load


def good_rows(make_arrivals, items, step=10, registry=None):
    return cut(accepted(normalize(make_arrivals(items, step), registry or build_registry())), "accepted")


def usage(key, cost=None, tokens=None):
    return ("openai", {"id": key, "cost": {"amount_usd": cost}, "usage": {"prompt_tokens": tokens}})


# --- runs ---------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_runs_merge_in_any_grouping(spark, make_arrivals, seed):
    import random

    rng = random.Random(seed)
    values = [None, 1, 2]
    items = [usage(f"k{rng.randrange(4)}", rng.choice(values), rng.choice(values)) for _ in range(60)]
    rows = good_rows(make_arrivals, items)
    whole = fold.events_table(rows)
    edges = [0, *sorted(rng.sample(range(10, 590, 10), 4)), 600]
    parts = [
        cut(fold.summaries(rows.filter((F.col("seq") >= a) & (F.col("seq") < b))), "part") for a, b in zip(edges, edges[1:])
    ]
    flat = fold.merge_summaries(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4]))
    left = cut(fold.merge_summaries(parts[0].unionByName(parts[1])), "left")
    middle = cut(fold.merge_summaries(parts[2].unionByName(parts[3])), "middle")
    right = cut(fold.merge_summaries(middle.unionByName(parts[4])), "right")
    nested = fold.merge_summaries(left.unionByName(right))
    for runs in (flat, nested):
        events = fold.events_from(runs)
        assert events.count() == whole.count() and events.exceptAll(whole).count() == 0


def test_hot_key_at_sparse_positions_is_spread(spark, make_arrivals):
    """One key holds 20,000 arrivals that are 70,001 positions apart."""
    costs = [None if i % 5 == 4 else (i // 3) % 4 for i in range(20_000)]
    rows = good_rows(make_arrivals, [usage("hot", c) for c in costs], 70_001)
    revision, now, results = 0, None, []
    for i, cost in enumerate(costs):
        changed = cost is not None and cost != now
        revision += changed or i == 0
        now = cost if cost is not None else now
        results.append((i * 70_001, i == 0, revision))
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        ranges = prefix.in_ranges(rows.select("dedup_key", "seq"), ["dedup_key", "seq"], "ranges")
        sizes = [r["count"] for r in ranges.groupBy("dedup_key", "_range").count().collect()]
        assert sum(sizes) == 20_000 and len(sizes) >= 8 and max(sizes) < 5_000
        (event,) = fold.events_table(rows).collect()
        assert event.revision == revision
        got = fold.ingest_results(rows).orderBy("seq").collect()
        assert [(r.seq, r.inserted, r.revision) for r in got] == results
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# --- exact costs ----------------------------------------------------------------------------


def test_costs_are_kept_as_sent(make_arrivals):
    near = ["0.12345678901234567", "0.12345678901234569", "1.0000000000000002", "1.00000000000000021"]
    texts = ["1e-19", "2e-19", "1e21", "1e21", *near]
    items = [("openai", '{"id":"k%d","cost":{"amount_usd":%s}}' % (i // 2, t)) for i, t in enumerate(texts)]
    rows = normalize(make_arrivals(items), build_registry())
    assert {r.store_reasons for r in rows.collect()} == {""}
    events = {r.first_seq: (r.revision, r.cost_amount_usd) for r in fold.events_table(cut(accepted(rows), "rows")).collect()}
    # The last two texts are one double.
    assert events == {0: (2, 2e-19), 20: (1, 1e21), 40: (2, float(near[1])), 60: (1, 1.0000000000000002)}


def test_infinite_cost_is_refused(make_arrivals):
    rows = normalize(make_arrivals([("openai", '{"id":"a","cost":{"amount_usd":1e400}}')]), build_registry()).collect()
    assert [bool(r.parse_reasons or r.store_reasons) for r in rows] == [True]


@pytest.mark.parametrize("parts", [1, 7])
def test_sums_do_not_depend_on_partitions(spark, parts):
    from fractions import Fraction

    cases = {
        "plain": [0.1, 0.2],
        "far apart": [1e21, 1e-19, -1e21],
        "negative": [-5.5, 2.25],
        "missing": [None, None],
        "some missing": [123456789.123456789] * 7 + [None],
        "extremes": [5e-324, 1e300, 1e308, -1e308],
        "cancelling": [1e15, 1e16, -1e16, 0.5],
        "many": [-0.001] * 1000,
    }
    rows = [(k, v) for k, values in cases.items() for v in values]
    sums = exact_sums(spark.createDataFrame(rows, "k string, x double").repartition(parts), ["k"], "x", "total", "n")
    for r in sums.collect():
        values = [v for v in cases[r.k] if v is not None]
        assert r.total == (float(sum(Fraction(repr(v)) for v in values)) if values else None)
        assert r.n == len(cases[r.k])


def test_weekly_spend_is_exact(make_arrivals):
    rows = good_rows(make_arrivals, [usage(f"k{i}", c) for i, c in enumerate([0.1, 0.2, 1e-19, None])])
    weeks = cut(reports.weekly(fold.fold_events(rows)), "weekly")
    assert [(r.cost_usd, r.events) for r in weeks.collect()] == [(0.3, 4)]
    assert [r.total_usd for r in reports.weekly_grid(weeks).collect()] == [0.3]


# --- structural drift -------------------------------------------------------------------------


def test_payloads_with_their_own_keys_cost_their_own_paths(make_arrivals):
    n = 600
    items = [("openai", {"id": f"e{i}", f"own_{i:04}": 1, "shared": 2}) for i in range(n)]
    rows = good_rows(make_arrivals, items)
    corpus = cut(fold.corpus_table(rows, ("provider", "shape_key")), "corpus")
    alerts = cut(drift.structural_alerts(rows, corpus), "alerts").orderBy("seq").collect()
    assert len(alerts) == n - 1
    for i, a in enumerate(alerts, 1):
        # id and shared are positions 0 and then 2 of the known paths; everything else is missing.
        assert a.added == [f"own_{i:04}"] and len(a.removed) <= 3
        assert sum(r.stop - r.start for r in a.removed) == i
        assert a.message == f"New raw shape for openai: 1 path(s) added, {i} removed."
    listed = {r.seq: r.removed for r in drift.with_removed_paths(cut(drift.structural_alerts(rows, corpus), "again"), corpus).collect()}
    assert listed[50] == [f"own_{i:04}" for i in range(5)]


# --- fields expected per version --------------------------------------------------------------


class VersionedModel(Model):
    """Judges after each arrival only the fields that its version expects."""

    def ingest(self, seq, provider, doc, fields=None):
        self.fields = fields
        super().ingest(seq, provider, doc)

    def silent(self, seq, provider):
        known = len(self.alerts)
        super().silent(seq, provider)
        self.alerts[known:] = [a for a in self.alerts[known:] if a[2] in self.fields]


@pytest.mark.parametrize("seed", [4, 5])
def test_versions_may_expect_different_fields(spark, make_arrivals, seed):
    some = ("model", "usage.input_tokens")
    later = Parser(**{**OPENAI_V1.__dict__, "version": 2, "expects": some})
    registry = build_registry().plus(later)
    model, items = VersionedModel(LIMITS), []
    for i, (provider, doc) in enumerate(random_load(seed)):
        pinned = 1 if provider == "openai" and i % 9 == 0 else None
        items.append((provider, doc, pinned))
        if parse(provider, doc) is not None:
            model.ingest(i * 10, provider, doc, set(some) if provider == "openai" and not pinned else set(FIELDS))
    rows = good_rows(make_arrivals, items, registry=registry)
    found = drift.silent_null_first_fire(fold.fold_presence(rows), registry, LIMITS, rows).collect()
    assert {(r.provider, r.field, r.seq) for r in found} == {(p, f, s) for s, p, f, *_ in model.alerts if f}
    with pytest.raises(ValueError):
        drift.silent_null_first_fire(fold.fold_presence(rows), registry, LIMITS)


def test_no_version_expects_a_field(make_arrivals):
    registry = Registry([Parser(**{**OPENAI_V1.__dict__, "expects": ("model",)})])
    items = [("openai", {"id": f"k{i}", "model": "m", "cost": {"amount_usd": 1 if i < 40 else None}}) for i in range(80)]
    rows = good_rows(make_arrivals, items, registry=registry)
    assert drift.silent_null_first_fire(fold.fold_presence(rows), registry, LIMITS).count() == 0


@pytest.mark.parametrize("last,fields", [(None, ["model"]), (1, sorted(FIELDS))])
def test_statistics_of_the_fields_that_the_newest_arrival_expects(make_arrivals, last, fields):
    registry = build_registry().plus(Parser(**{**OPENAI_V1.__dict__, "version": 2, "expects": ("model",)}))
    items = [("openai", {"id": f"k{i}", "model": "m"}, 1) for i in range(5)] + [("openai", {"id": "z"}, last)]
    rows = good_rows(make_arrivals, items, registry=registry)
    stats = drift.expected_stats(drift.field_stats(fold.fold_presence(rows)), rows, registry).collect()
    assert sorted(r.field for r in stats) == fields


def test_as_of_meets_the_latest_state(spark):
    far = 1 << 17
    states = [("a", 5, "x"), ("a", far, "y"), ("b", 3 * far, "z")]
    probes = [("a", 4, 1), ("a", 5, 2), ("a", far - 1, 3), ("a", far, 4), ("a", 9 * far, 5), ("b", far, 6), ("c", 1, 7)]
    left = spark.createDataFrame(states, "g string, seq long, s string")
    right = spark.createDataFrame(probes, "g string, seq long, n int")
    want = [(1, None), (2, "x"), (3, "x"), (4, "y"), (5, "y"), (6, None), (7, None)]
    for most in (1_000_000, 2):
        got = prefix.as_of(left, right, ["g"], "seq", ["s"], most).orderBy("n").collect()
        assert [(r.n, r.s) for r in got] == want


# --- micro-batches ----------------------------------------------------------------------------


@pytest.fixture
def job(spark, tmp_path):
    return IngestJob(spark, str(tmp_path / "tables"), build_registry(), LIMITS)


def parts_of(arrivals, n, size):
    return [arrivals.filter((F.col("seq") >= i * size) & (F.col("seq") < (i + 1) * size)) for i in range(n)]


def test_a_batch_works_on_its_own_rows(spark, make_arrivals, job):
    """Four equal batches write and judge equally much, however much came before."""
    items = [usage(f"k{i % 90}" if i % 9 else f"new{i}", i, i) for i in range(400)]
    written, judged, states = [], [], []
    moves = drift.first_fires

    def counted(m, *args, **kwargs):
        judged.append((m.count(), args[3].count()))
        return moves(m, *args, **kwargs)

    drift.first_fires = counted
    try:
        for batch, part in enumerate(parts_of(make_arrivals(items), 4, 1000)):
            job.run_batch(part, batch)
            written.append(spark.read.parquet(f"{job.root}/runs/v={batch}").count())
            states += [(r.seen, len(r.ring)) for r in job.detector_state().collect()]
    finally:
        drift.first_fires = moves
    keys = [len({d["id"] for _, d in items[i : i + 100]}) for i in range(0, 400, 100)]
    assert written == keys
    # After the first batch only new events and newly filled fields are judged, from one state row.
    assert [rows for rows, _ in judged][1:] == [len([i for i in range(a, a + 100) if i % 9 == 0]) for a in (100, 200, 300)]
    assert [rows for _, rows in judged] == [0, 1, 1, 1]
    assert all(ring == LIMITS.recent_window for _, ring in states)


def test_a_batch_is_seen_whole_or_not_at_all(spark, make_arrivals, job):
    first, second = parts_of(make_arrivals(random_load(11, 120), 10), 2, 600)
    job.run_batch(first, 0)

    def seen():
        tables = (job.events(), job.corpus(), job.alerts(), job.results(), job.quarantine(), job.detector_state())
        return [sorted(map(json.dumps, (json.loads(j) for j in t.toJSON().collect()))) for t in tables]

    before = seen()

    def lost(*args):
        raise RuntimeError("driver lost")

    commit, job._commit = job._commit, lost
    with pytest.raises(RuntimeError):
        job.run_batch(second, 1)
    # All tables of the batch are written, none is visible.
    assert spark.read.parquet(f"{job.root}/alerts/v=1").count() >= 0
    assert seen() == before and committed(spark, job.root) == [0]
    job._commit = commit
    job.run_batch(second, 1)
    after = seen()
    assert after != before and committed(spark, job.root) == [0, 1]
    job.run_batch(second, 1)
    assert seen() == after


def test_results_name_the_alerts_they_raised(make_arrivals, job):
    items = [("openai", {"id": f"k{i}", "model": "m", **({"extra": 1} if i == 7 else {})}) for i in range(9)]
    job.run_batch(make_arrivals(items), 0)
    raised = {r.seq: [(a.type, a.severity, a.field) for a in r.alerts] for r in job.results().collect()}
    assert raised == {i * 10: [("STRUCTURAL", "warn", None)] if i == 7 else [] for i in range(9)}


def test_an_early_batch_is_refused_and_an_empty_one_is_not(spark, make_arrivals, job):
    arrivals = make_arrivals([usage("a", 1), usage("b", 1)])
    job.run_batch(arrivals.filter("seq >= 10"), 0)
    job.run_batch(arrivals.limit(0), 1)
    with pytest.raises(ValueError):
        job.run_batch(arrivals.filter("seq < 10"), 2)
    assert job.events().count() == 1


def test_alert_list_shows_the_newest_first(spark):
    from datetime import datetime

    rows = [(i, datetime(2024, 1, 1, 0, 0, s)) for i, s in ((1, 5), (2, 9), (3, 5), (4, 1))]
    listed = drift.latest_first(spark.createDataFrame(rows, "id long, created_at timestamp")).orderBy("place").collect()
    assert [(r.place, r.id) for r in listed] == [(1, 2), (2, 3), (3, 1), (4, 4)]
