"""The five-step acceptance story, end to end on small payload sets."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tallyguard.operators import drift, fold, forensics, replay, reports
from tallyguard.operators.normalize import accepted, normalize
from tallyguard.operators.registry import OPENAI_V2, build_registry
from tallyguard.session import cut

PROVIDERS = ("openai", "anthropic", "cursor")
BEGIN = datetime(2025, 3, 3, 8, tzinfo=timezone.utc)

#: One payload text per provider, with the places its parser reads.
LAYOUT = {
    "openai": """{"id": "%(key)s", "object": "chat.completion", "created": %(epoch)d, "model": "large", "user": "%(user)s",
        "usage": {"prompt_tokens": %(read)d, "completion_tokens": %(written)d}, %(price)s}""",
    "anthropic": """{"id": "%(key)s", "type": "message", "created_at": "%(clock)s", "model": "small",
        "metadata": {"user_id": "%(user)s"}, "usage": {"output_tokens": %(written)d, "input_tokens": %(read)d}, "cost_usd": %(amount)s}""",
    "cursor": """{"request_id": "%(key)s", "kind": "edit", "timestamp": "%(clock)s", "model": "small", "user": {"id": "%(user)s"},
        "tokens": {"in": %(read)d, "out": %(written)d}, "billing": {"usd": %(amount)s}}""",
}
PLAIN, MOVED_TO = '"cost": {"amount_usd": %s}', '"pricing": {"cost": {"amount_usd": %s}}'


def payload(provider, number, key=None, amount=None, place=PLAIN):
    """Payload ``number`` of a provider: one a minute, a cent per hundred numbers dearer."""
    when = BEGIN + timedelta(minutes=number)
    amount = amount or f"0.{100 + number:04d}"
    values = {
        "key": key or f"{provider}-{number:05d}",
        "epoch": when.timestamp(),
        "clock": when.strftime("%Y-%m-%dT%H:%M:%S.000Z"),
        "user": f"member {number // 10}",
        "read": 1000 - number,
        "written": 3 * number + 1,
        "amount": amount,
        "price": place % amount,
    }
    return provider, LAYOUT[provider] % values


CLEAN = [payload(provider, number) for number in range(150) for provider in PROVIDERS]
AGAIN = [payload("openai", number) for number in range(30)]
LATE = [payload("openai", 3, "late-bill", amount) for amount in ("null", "0.5")]
MOVED = [payload("openai", number, f"moved-{number}", place=MOVED_TO) for number in range(30)]


@pytest.fixture(scope="module")
def load(make_arrivals):
    rows = cut(accepted(normalize(make_arrivals(CLEAN + AGAIN + LATE + MOVED, 1), build_registry())), "accepted")
    events = cut(fold.events_table(rows), "events")
    corpus = cut(fold.corpus_table(rows), "corpus")
    structural = drift.structural_alerts(rows, corpus)
    silent = drift.silent_null_first_fire(fold.fold_presence(rows), build_registry())
    alerts = cut(drift.alerts_table(structural, silent, rows), "alerts")
    return rows, events, corpus, alerts


def test_counts(load):
    rows, events, corpus, _ = load
    assert (events.count(), corpus.count()) == (481, 482)
    results = {r.seq: r for r in fold.ingest_results(rows).collect()}
    assert all(results[s].inserted for s in range(len(CLEAN)))
    again = range(len(CLEAN), len(CLEAN) + len(AGAIN))
    assert not any(results[s].inserted for s in again)
    assert {results[s].revision for s in again} == {1}
    first, second = results[again.stop], results[again.stop + 1]
    assert (first.inserted, first.revision, second.inserted, second.revision) == (True, 1, False, 2)
    assert first.event_id == second.event_id


def test_alerts(load):
    _, _, corpus, raised = load
    alerts = drift.with_removed_paths(raised, corpus).orderBy("id").collect()
    moved = len(CLEAN) + len(AGAIN) + len(LATE)
    assert [(a.type, a.severity, a.field) for a in alerts] == [
        ("STRUCTURAL", "warn", None),
        ("SILENT_NULL", "critical", "cost.amount_usd"),
    ]
    assert alerts[0].seq == moved
    assert (alerts[0].added, alerts[0].removed) == (["pricing.cost.amount_usd"], ["cost.amount_usd"])
    assert alerts[1].seq == moved + 17  # two populated rows of twenty are few enough
    assert alerts[1].message == (
        "cost.amount_usd went dark: 100% populated historically, 10% across the last 20. Parser never threw."
    )


def test_replay(load):
    corpus = load[2]
    before_registry, after_registry = build_registry(), build_registry().plus(OPENAI_V2)
    before = replay.replay_matrix(replay.replay_rows(corpus, before_registry), before_registry)
    after = replay.replay_matrix(replay.replay_rows(corpus, after_registry), after_registry)
    cells = {(c.provider, c.version): c for c in after.collect()}
    assert all(c.throw == 0 for c in cells.values())
    second = cells[("openai", 2)]
    assert (second.total, second.ok, second.drift, second.status) == (182, 152, 30, "amber")
    assert all(c.status == "green" for key, c in cells.items() if key != ("openai", 2))
    assert replay.regressions(before, after, "openai").count() == 0


def test_reports(load):
    events = load[1]
    health = {r.provider: r for r in reports.provider_health(events).collect()}
    assert (health["openai"].events, health["openai"].missing_cost) == (181, 30)
    vitals = reports.field_vitals(events).filter("field = 'cost.amount_usd' and provider = 'openai'").first()
    assert (vitals.state, vitals.rate, vitals.series) == ("dark", 0.0, [1] * 10 + [0] * 30)
    focus = reports.dark_providers(reports.field_vitals(events)).filter("focus").first()
    assert (focus.provider, focus.any_dark) == ("openai", True)


def test_inspection(load):
    _, events, corpus, alerts = load
    registry = build_registry(openai_v2=True)
    matrix = replay.replay_matrix(replay.replay_rows(corpus, registry), registry)
    facts = cut(forensics.provider_facts(events, corpus, cut(matrix, "matrix")), "facts")
    index = cut(forensics.alert_index(alerts), "index")
    inspected = cut(forensics.inspect_events(events, corpus, index, facts, registry), "reports")
    targets = forensics.alert_events(alerts, events, corpus)
    focus = forensics.provider_focus(events)
    report = forensics.pick_event(inspected, targets, focus, alert_id=2).first()
    assert report.status == "Silent Null"
    assert report.parser.missing == ["cost.amount_usd"]
    assert report.silent_null.status == "CRITICAL"
    assert report.notes.root_cause == "Provider moved a field: cost.amount_usd → pricing.cost.amount_usd."
    assert report.notes.impact == "30 openai events currently missing cost.amount_usd."
    assert report.notes.suggested_fix == "Upgrade to openai parser v2 (reads the moved field)."
    assert report.notes.replay == "182 historical openai payloads validate successfully."
    picked = forensics.pick_event(inspected, targets, focus, alert_id=2)
    related = forensics.event_alerts(picked, index).orderBy(F.col("alert_id").desc()).collect()
    assert [(a.event_id, a.alert_id, a.type, a.severity, a.field) for a in related] == [
        (report.event_id, 2, "SILENT_NULL", "critical", "cost.amount_usd"),
        (report.event_id, 1, "STRUCTURAL", "warn", None),
    ]
    assert related[0].message.startswith("cost.amount_usd went dark: ") and related[0].created_at
    assert report.replay.failures == []
    assert [s.status for s in report.timeline] == ["ok", "ok", "ok", "warn", "ok", "fail", "ok", "ok"]
    healthy = forensics.pick_event(inspected, targets, focus, provider="cursor").first()
    assert (healthy.status, healthy.related_alerts, healthy.silent_null) == ("Healthy", [], None)
    same = forensics.pick_event(inspected, targets, focus, event_id=report.event_id).first()
    assert same == report
    assert forensics.pick_event(inspected, targets, focus).count() == 0
    assert inspected.filter(F.size("timeline") != 8).count() == 0
