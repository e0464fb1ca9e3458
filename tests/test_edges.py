"""Hand-written rows that pin single rules."""

import json

import pytest
from pyspark.sql import functions as F

from tallyguard.functions import ecma, paths
from tallyguard.operators import drift, fold, forensics, replay
from tallyguard.operators.normalize import accepted, normalize, quarantined, with_event_id
from tallyguard.operators.registry import ANTHROPIC_V1, Parser, build_registry
from tallyguard.operators.shapes import known_shapes
from tallyguard.sources.arrivals import read_arrivals

from .model import sha


def normalized(make_arrivals, *items, openai_v2=False):
    return normalize(make_arrivals(items), build_registry(openai_v2)).orderBy("seq")


def test_usable_id_decides_alone(make_arrivals):
    a, b = normalized(
        make_arrivals,
        ("openai", {"id": "oa_1", "model": "m", "cost": {"amount_usd": None}}),
        ("openai", {"id": "oa_1", "model": "n", "created": 5, "cost": {"amount_usd": 0.5}}),
    ).collect()
    assert a.dedup_key == b.dedup_key == sha("openai|oa_1")


def test_falsy_id_collides_and_missing_id_hashes_the_payload(make_arrivals):
    same, other, missing, zero = normalized(
        make_arrivals,
        ("openai", {"id": "", "model": "m", "x": 1}),
        ("openai", {"id": "", "model": "m", "x": 2}),
        ("openai", {"model": "m", "x": 1}),
        ("openai", {"id": 0, "model": "m"}),
    ).collect()
    epoch = "1970-01-01T00:00:00.000Z"
    assert same.dedup_key == other.dedup_key == sha(f"openai|{epoch}|m||{sha(json.dumps(''))}")
    assert missing.dedup_key == sha(f"openai|{epoch}|m||{sha(json.dumps({'model': 'm', 'x': 1}, separators=(',', ':')))}")
    assert zero.dedup_key == sha(f"openai|{epoch}|m||{sha('0')}")


def test_numeric_ids_pass(make_arrivals):
    a, b, c = normalized(
        make_arrivals, ("openai", '{"id": 12345}'), ("openai", '{"id": 12.50}'), ("openai", '{"id": 1e2}')
    ).collect()
    assert [r.dedup_key for r in (a, b, c)] == [sha("openai|12345"), sha("openai|12.5"), sha("openai|100")]


def test_array_ids_are_joined_at_every_depth(make_arrivals):
    ids = {
        '["nullable"]': "nullable",
        '["able"]': "able",
        '[{"k": 1, "l": [{}, "]"]}]': "[object Object]",
        '["[object Object]"]': "[object Object]",
        '[["a", null], 1.0, [], true]': "a,,1,,true",
        r'["x\"y,[z]\\", "null"]': 'x"y,[z]\\,null',
    }
    rows = normalized(make_arrivals, *(("openai", f'{{"id": {i}}}') for i in ids)).collect()
    assert [r.dedup_key for r in rows] == [sha(f"openai|{text}") for text in ids.values()]


def test_provider_without_stored_payloads(make_arrivals):
    """Its only payload arrived first from another provider."""
    registry = build_registry()
    rows = accepted(normalize(make_arrivals([("anthropic", {"id": "a"}), ("openai", {"id": "a"})]), registry))
    events, corpus = fold.events_table(rows), fold.corpus_table(rows)
    alerts = drift.alerts_table(
        drift.structural_alerts(rows, corpus), drift.silent_null_first_fire(fold.fold_presence(rows), registry), rows
    )
    matrix = replay.replay_matrix(replay.replay_rows(corpus, registry), registry)
    facts = forensics.provider_facts(events, corpus, matrix)
    reports = {r.provider: r for r in forensics.inspect_events(events, corpus, forensics.alert_index(alerts), facts, registry).collect()}
    report = reports["openai"]
    assert (report.status, report.structural_diff.changed) == ("Drift", True)
    assert report.notes.impact.startswith("1 openai events currently missing ")
    assert report.notes.replay == "0 historical openai payloads validate successfully."
    assert reports["anthropic"].structural_diff.changed is False


def test_text_with_nul_is_not_stored(make_arrivals):
    rows = normalized(
        make_arrivals,
        ("openai", r'{"id": "a", "model": "x\u0000y"}'),
        ("openai", r'{"id": "b", "model": "x\\u0000y"}'),
        ("openai", r'{"id": "c", "k\\\u0000": 1}'),
    ).collect()
    assert [r.store_reasons for r in rows] == ["payload:nul_text", "", "payload:nul_text"]
    assert [r.parse_reasons for r in rows] == [""] * 3


def test_null_group_keeps_its_statistics(spark):
    events = spark.createDataFrame([(None, i, None if i > 6 else "x") for i in range(9)], "provider string, first_seq long, model string")
    row = drift.field_stats(events, {"model": "model"}, recent_window=3).first()
    assert (row.provider, row.overall_seen, row.overall_populated, row.recent_seen, row.recent_populated) == (None, 6, 6, 3, 1)


@pytest.mark.parametrize(
    "created,text",
    [
        ("null", "1970-01-01T00:00:00.000Z"),
        ("1717243200", "2024-06-01T12:00:00.000Z"),
        ("1717243200.5", "2024-06-01T12:00:00.500Z"),
        ('"1717243200"', "2024-06-01T12:00:00.000Z"),
        ("true", "1970-01-01T00:00:01.000Z"),
        ("-1.0005", "1969-12-31T23:59:59.000Z"),
    ],
)
def test_epoch_clock(make_arrivals, created, text):
    (row,) = normalized(make_arrivals, ("openai", f'{{"id":"a","created":{created}}}')).collect()
    assert (row.occurred_at_text, row.parse_reasons) == (text, "")


@pytest.mark.parametrize("created", ['"abc"', "{}", "1e300", "9e12"])
def test_epoch_clock_out_of_range(make_arrivals, created):
    (row,) = normalized(make_arrivals, ("openai", f'{{"id":"a","created":{created}}}')).collect()
    assert row.parse_reasons == "occurred_at:not_datetime"


@pytest.mark.parametrize(
    "stamp,ok",
    [
        ("2024-06-01T12:00:00Z", True),
        ("2024-06-01T12:00:00.123456789Z", True),
        ("2024-02-29T00:00:00Z", True),
        ("2023-02-29T00:00:00Z", False),
        ("2024-06-01T12:00:00+02:00", False),
        ("2024-06-01T24:00:00Z", False),
        ("2024-06-01", False),
        ("yesterday", False),
    ],
)
def test_text_clock(make_arrivals, stamp, ok):
    (row,) = normalized(make_arrivals, ("anthropic", {"id": "a", "created_at": stamp})).collect()
    assert row.occurred_at_text == stamp
    assert (row.parse_reasons == "") is ok


def test_no_coercion(make_arrivals):
    rows = normalized(
        make_arrivals,
        ("openai", {"id": "a", "usage": {"prompt_tokens": "412"}}),
        ("openai", {"id": "a", "model": 404}),
        ("openai", {"id": "a", "user": {"name": "x"}}),
        ("openai", {"id": "a", "cost": {"amount_usd": True}}),
        ("anthropic", {"id": "a", "created_at": 5}),
        ("openai", {"id": "a", "usage": "none", "cost": []}),
    ).collect()
    assert [r.parse_reasons for r in rows] == [
        "usage.input_tokens:not_number",
        "model:not_string",
        "actor.raw_user_id:not_string",
        "cost.amount_usd:not_number",
        "occurred_at:not_datetime",
        "",
    ]


def test_values_the_table_cannot_hold(make_arrivals):
    rows = normalized(
        make_arrivals,
        ("openai", {"id": "a", "usage": {"prompt_tokens": 1.5}}),
        ("openai", {"id": "a", "usage": {"completion_tokens": 3000000000}}),
        ("openai", {"id": "a", "usage": {"prompt_tokens": 7.0}}),
    )
    assert [(r.parse_reasons, r.store_reasons) for r in rows.collect()] == [
        ("", "usage.input_tokens:not_int32"),
        ("", "usage.output_tokens:not_int32"),
        ("", ""),
    ]
    assert accepted(rows).count() == 1


def test_requests_turned_away(make_arrivals):
    rows = quarantined(
        normalized(
            make_arrivals,
            ("mistral", {"id": "a"}),
            ("openai", None),
            ("openai", "{not json"),
            ("openai", "[1, 2]"),
            ("openai", "null"),
            ("openai", {"id": "a"}, 9),
            ("openai", {"id": "a"}, 0),
            ("openai", ' {"id": "a", "id": "b"}', 1),
        )
    ).orderBy("seq")
    assert [r.reason for r in rows.collect()] == [
        "provider:unknown",
        "payload:missing",
        "payload:invalid_json",
        "payload:not_object",
        "payload:not_object",
        "version:not_registered",
    ]


def test_repeated_key_takes_the_last_value(make_arrivals):
    (row,) = normalized(make_arrivals, ("openai", '{"id": "a", "id": "b"}')).collect()
    assert row.dedup_key == sha("openai|b")


def test_second_version_prefers_the_new_place(make_arrivals):
    both = {"id": "a", "cost": {"amount_usd": 1}, "pricing": {"cost": {"amount_usd": 2}}}
    null = {"id": "a", "cost": {"amount_usd": 1}, "pricing": {"cost": {"amount_usd": None}}}
    items = [("openai", both, 1), ("openai", both, 2), ("openai", null, 2)]
    rows = normalized(make_arrivals, *items, openai_v2=True).collect()
    assert [r.cost_value for r in rows] == [1.0, 2.0, 1.0]
    assert len({r.dedup_key for r in rows}) == 1


def test_revision_counts_changes_only(make_arrivals):
    def cost(i, value):
        return ("openai", {"id": i, "cost": {"amount_usd": value}, "usage": {"prompt_tokens": value and 5}})

    rows = accepted(
        normalized(
            make_arrivals,
            cost("keeps", 1), cost("keeps", None), cost("keeps", 1),
            cost("flips", 1), cost("flips", 2), cost("flips", 1),
            cost("fills", None), cost("fills", 3),
        )
    )
    events = {r.dedup_key: (r.revision, float(r.cost_amount_usd)) for r in fold.events_table(rows).collect()}
    assert events[sha("openai|keeps")] == (1, 1.0)
    assert events[sha("openai|flips")] == (3, 1.0)
    assert events[sha("openai|fills")] == (2, 3.0)


def test_same_payload_from_two_providers_is_stored_once(make_arrivals):
    rows = accepted(normalized(make_arrivals, ("anthropic", {"id": "a"}), ("openai", {"id": "a"})))
    assert [r.provider for r in fold.corpus_table(rows).collect()] == ["anthropic"]
    assert fold.events_table(rows).count() == 2


@pytest.mark.parametrize(
    "doc,want",
    [
        ("[]", ["[]"]),
        ("{}", [""]),
        ("5", [""]),
        ('[null,{"a":1}]', ["[]", "[].a"]),
        ('{"a":[{"b":1},{"c":[]}],"d":{},"e":null}', ["a[].b", "a[].c[]", "d", "e"]),
        ('{"a.b":1,"c d":{"x":[[],[1]]}}', ["a.b", "c d.x[][]"]),
        ('{"":{"q":1}}', ["q"]),
        ('{"t":[1,"a",true]}', ["t[]"]),
        ('{"o":[1,{"p":{"q":[{"r":0}]}}]}', ["o[]", "o[].p.q[].r"]),
        ('{"o":["]}{[\\"",{"p":[2,{"q":"\\\\"}]}]}', ["o[]", "o[].p[]", "o[].p[].q"]),
    ],
)
def test_leaf_paths(spark, doc, want):
    row = (
        spark.createDataFrame([(doc,)], "p string")
        .selectExpr("parse_json(p) as v")
        .selectExpr(f"{paths.path_set('v')} as walked", f"{paths.shape_key('v', 'schema_of_variant(v)')} as key")
        .selectExpr("walked", f"{paths.paths_of_key('key')} as keyed")
        .first()
    )
    assert row.walked == want
    assert row.keyed == want


def test_null_value_keeps_the_shape_and_moved_value_changes_it(make_arrivals):
    rows = accepted(
        normalized(
            make_arrivals,
            ("openai", {"id": "a", "cost": {"amount_usd": 1}}),
            ("openai", {"id": "b", "cost": {"amount_usd": None}}),
            ("openai", {"id": "c", "cost": {"amount_usd": 0.25}}),
            ("openai", {"id": "d", "pricing": {"cost": {"amount_usd": 1}}}),
        )
    )
    shapes = known_shapes(fold.corpus_table(rows)).orderBy("first_seq").collect()
    assert [(s.fingerprint, s.n) for s in shapes] == [("cost.amount_usd\nid", 3), ("id\npricing.cost.amount_usd", 1)]


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"b":1.50,"a":[1e2,1.0]}', '{"a":[100,1],"b":1.5}'),
        ("[1e21,1e-7,0.0000001,0.00001234,123e18,-1.5e-9]", "[1e+21,1e-7,1e-7,0.00001234,123000000000000000000,-1.5e-9]"),
        ("[9007199254740993,-0,-0.0,12345678901234567890]", "[9007199254740992,0,0,12345678901234567000]"),
        ('{"s":"x,1.0E7:1.0","e":"\\u001f\\n\\"\\\\"}', '{"e":"\\u001f\\n\\"\\\\","s":"x,1.0E7:1.0"}'),
    ],
)
def test_json_text(spark, text, want):
    row = spark.createDataFrame([(text,)], "p string").selectExpr("to_json(parse_json(p)) as t")
    assert row.selectExpr(f"{ecma.json_text('t')} as j").first().j == want


def test_json_lines_source(spark, tmp_path):
    lines = [
        {"seq": 1, "received_at": "2024-01-01T00:00:00Z", "provider": "openai", "payload": {"id": "a", "n": [1, {"x": 1.5}]}},
        {"seq": 2, "received_at": "2024-01-01T00:00:01Z", "provider": "openai"},
        {"seq": 3, "received_at": "2024-01-01T00:00:02Z", "provider": "openai", "version": 1, "payload": [1]},
    ]
    (tmp_path / "in.json").write_text("\n".join(json.dumps(line) for line in lines))
    rows = normalize(read_arrivals(spark, str(tmp_path), "json"), build_registry()).orderBy("seq").collect()
    assert [r.parse_reasons for r in rows] == ["", "payload:missing", "payload:not_object"]
    assert json.loads(rows[0].payload) == lines[0]["payload"]
    assert rows[0].dedup_key == sha("openai|a")


def test_uuid_shape(spark):
    rows = with_event_id(spark.range(200).select(F.sha2(F.col("id").cast("string"), 256).alias("dedup_key")))
    pattern = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    assert rows.filter(~F.col("event_id").rlike(pattern)).count() == 0
    assert rows.select("event_id").distinct().count() == 200


def test_a_strict_version_turns_its_cells_red(make_arrivals):
    strict = Parser(**{**ANTHROPIC_V1.__dict__, "version": 2, "required": ("model",)})
    registry = build_registry(openai_v2=True).plus(strict)
    items = [("anthropic", {"id": "a"}), ("anthropic", {"id": "b", "model": "m"})]
    corpus = fold.corpus_table(accepted(normalize(make_arrivals(items), build_registry())))
    cells = replay.replay_matrix(replay.replay_rows(corpus, registry), registry).collect()
    found = {(c.provider, c.version): (c.total, c.ok, c.drift, c.throw, c.status, c.throw_reasons) for c in cells}
    assert found[("anthropic", 1)] == (2, 2, 0, 0, "green", [])
    assert found[("anthropic", 2)] == (2, 1, 0, 1, "red", ["model:required"])
    assert found[("openai", 2)] == (0, 0, 0, 0, "green", [])
