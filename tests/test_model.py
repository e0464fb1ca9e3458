"""Batch results against the sequential model, on random arrival orders."""

import random

import pytest
from pyspark.sql import functions as F

from tallyguard.operators import drift, fold
from tallyguard.operators.normalize import accepted, normalize
from tallyguard.operators.registry import build_registry
from tallyguard.operators.shapes import with_paths
from tallyguard.session import cut

from .model import Model

LIMITS = drift.Thresholds(min_overall=4, min_recent=3, high_rate=0.75, low_rate=0.34, recent_window=4)


def random_payload(rng, provider, phase):
    doc = {}
    usable = rng.random() < 0.9
    place = "request_id" if provider == "cursor" else "id"
    if usable:
        doc[place] = f"x{rng.randrange(60)}"
    elif rng.random() < 0.5:
        doc[place] = ""
    if rng.random() < 0.9 - 0.8 * phase:
        doc["model"] = rng.choice(["m1", "m2"])
    if rng.random() < 0.05:
        doc["model"] = 404
    cost = None if rng.random() < 0.1 + 0.8 * phase else rng.choice([0.1, 0.25, 3])
    count = rng.choice([None, 5, 7])
    if provider == "openai":
        doc["cost"] = {"amount_usd": cost}
        doc["usage"] = {"prompt_tokens": count, "completion_tokens": 9}
        if rng.random() < 0.3:
            doc["user"] = "u1"
    elif provider == "anthropic":
        doc["cost_usd"] = cost
        doc["usage"] = {"input_tokens": count}
    else:
        doc["billing"] = {"usd": cost}
        doc["tokens"] = {"in": 3, "out": count}
    if rng.random() < 0.1:
        doc["extra"] = rng.choice([[], {}, [{"a": 1}, None], [1, {"b": {"c": []}}], {"k": 2}])
    return doc


def random_load(seed, n=260):
    rng = random.Random(seed)
    shared = [{"id": "s1"}, {"id": "s2", "note": "same for all"}, {"request_id": "s3", "deep": {"x": [[]]}}]
    items = []
    for i in range(n):
        provider = rng.choice(["openai", "openai", "anthropic", "cursor"])
        phase = 1.0 if 90 < i < 160 else 0.0
        doc = rng.choice(shared) if rng.random() < 0.06 else random_payload(rng, provider, phase)
        items.append((provider, doc))
        if rng.random() < 0.1:
            items.append(rng.choice(items))
    return items


@pytest.mark.parametrize("seed,step", [(1, 30011), (2, 10), (3, 70001)])
def test_batch_equals_one_at_a_time(spark, make_arrivals, seed, step):
    items = random_load(seed)
    model = Model(LIMITS)
    for i, (provider, doc) in enumerate(items):
        model.ingest(i * step, provider, doc)

    rows = cut(accepted(normalize(make_arrivals(items, step), build_registry())), "accepted")
    events = {r.dedup_key: r for r in fold.events_table(rows).collect()}
    assert set(events) == set(model.events)
    for key, e in model.events.items():
        r = events[key]
        cost = None if r.cost_amount_usd is None else float(r.cost_amount_usd)
        got = (r.provider, r.model, r.raw_user_id, r.input_tokens, r.output_tokens, cost, r.revision, r.first_seq)
        want = (e["provider"], e["model"], e["user"], e["input_tokens"], e["output_tokens"], e["cost"], e["revision"], e["first"])
        assert got == want
        assert r.content_hash == e["raw"]

    results = {(r.seq, r.inserted, r.revision) for r in fold.ingest_results(rows).collect()}
    assert results == set(model.results)

    corpus = cut(fold.corpus_table(rows), "corpus")
    stored = {r.content_hash: (r.provider, r.fingerprint, r.seq) for r in with_paths(corpus).collect()}
    assert stored == model.corpus

    structural = drift.structural_alerts(rows, corpus)
    silent = drift.silent_null_first_fire(fold.fold_presence(rows), build_registry(), LIMITS)
    table = cut(drift.alerts_table(structural, silent, rows), "alerts")
    alerts = drift.with_removed_paths(table, corpus).orderBy("id").collect()
    got = [
        (a.seq, a.provider, a.field, a.fingerprint, a.added and tuple(a.added), a.removed and tuple(a.removed))
        for a in alerts
    ]
    want = [(s, p, f, fp, a or None, r or None) for s, p, f, fp, a, r in model.alerts]
    assert [(s, p, f, fp, a or None, r or None) for s, p, f, fp, a, r in got] == want
    assert any(f for _, _, f, _, _, _ in want), "the load must make a field go dark"


def test_two_batches_equal_one(spark, make_arrivals):
    rows = cut(accepted(normalize(make_arrivals(random_load(7), 30011), build_registry())), "accepted")
    middle = 140 * 30011
    first = cut(fold.events_table(rows.filter(F.col("seq") < middle)), "first")
    later = rows.filter(F.col("seq") >= middle)
    whole = fold.events_table(rows)
    assert fold.merge_events(first, later).exceptAll(whole).count() == 0
    assert whole.count() == fold.merge_events(first, later).count()
    resumed = fold.ingest_results(later, first)
    assert resumed.exceptAll(fold.ingest_results(rows)).count() == 0

    whole_fire = drift.silent_null_first_fire(fold.fold_presence(rows), build_registry(), LIMITS)
    early = {(r.provider, r.field): r.seq for r in whole_fire.collect()}
    assert early
    # Four parts, each judged from the state that the one before left.
    edges = [0, 60 * 30011, 130 * 30011, 190 * 30011, 1 << 60]
    state = spark.createDataFrame([], drift.STATE_SCHEMA)
    fired, runs = {}, None
    for low, high in zip(edges, edges[1:]):
        part = rows.filter((F.col("seq") >= low) & (F.col("seq") < high))
        own = cut(fold.summaries(part), "own")
        before = None if runs is None else cut(fold.events_from(fold.merge_summaries(runs)), "before")
        moves = cut(drift.field_moves(own, before), "moves")
        for r in drift.first_fires(moves, build_registry(), LIMITS, state=state, since=low - 1).collect():
            fired.setdefault((r.provider, r.field), r.seq)
        state = cut(drift.next_state(state, moves, LIMITS), "state")
        runs = own if runs is None else runs.unionByName(own)
    assert fired == early
    assert fold.events_from(fold.merge_summaries(runs)).exceptAll(whole).count() == 0
