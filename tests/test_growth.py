"""Steps whose cost per task must not grow with the input."""

import re

from pyspark.sql import functions as F

from tallyguard.functions import ecma
from tallyguard.operators import fold, replay
from tallyguard.plans import fixture
from tallyguard.plans.queries import _quarters, with_v3
from tallyguard.plans.tables import Tables
from tallyguard.session import cut, spread
from tallyguard.sources.snapshots import publish

from .conftest import SMALL
from .test_plans import plan


def test_rows_of_one_split_are_dealt_evenly(spark):
    """One split holds all rows, and there are more splits than cores."""
    held = spark.range(4000, numPartitions=1).union(spark.range(0, 0, 1, numPartitions=40))
    dealt = spread(held, "id", rows_per_task=100)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert dealt.rdd.getNumPartitions() == 40 and sum(sizes) == 4000
    assert max(sizes) < 200


def test_quarters_come_from_bounded_summaries(spark):
    rows = spark.range(0, 200_000, 7).withColumnRenamed("id", "seq")
    assert " percentile(" not in plan(_quarters(rows))
    edges = _quarters(rows).first()[0]
    assert [abs(e - 50_000 * (i + 1)) < 200 for i, e in enumerate(edges)] == [True] * 3


def _codecs(df):
    return {re.search(r"\.(\w+)\.parquet$", f).group(1) for f in df.inputFiles()}


def test_stored_tables_are_entropy_coded(spark, tmp_path):
    rows = spark.range(10).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    stored = cut(rows, "hashes")
    assert _codecs(stored) == {"zstd"}
    publish(rows, str(tmp_path / "t"), 0)
    assert _codecs(spark.read.parquet(str(tmp_path / "t" / "v=0"))) == {"zstd"}
    assert stored.exceptAll(rows).count() == 0


def test_hashes_travel_as_bytes(spark):
    text = plan(Tables.from_source(spark, SMALL).folded)
    partial = next(line for line in text.splitlines() if "partial_max_by" in line)
    assert "partial_max_by(content_hash" not in partial and "partial_max_by(unhex(content_hash" in partial


def test_refused_payloads_are_replayed_once(spark):
    t = Tables.from_source(spark, SMALL)
    rows = replay.replay_rows(t.stored_corpus, with_v3())
    found = replay.replay_failures(rows, t.stored_corpus)
    assert "try_parse_json" not in plan(found)
    assert found.count() == min(8, rows.filter("outcome = 'throw'").count()) > 0


def test_events_are_dealt_before_their_payloads_are_made(spark):
    """Only the four columns that payloads are made of are shuffled, once, and no payload is."""
    text = fixture.arrivals(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("RepartitionByExpression") == 1
    above, below = text.split("RepartitionByExpression")
    assert "concat(" in above and "concat(" not in below


def test_deliveries_at_once_are_the_branches_of_the_recipe(spark, tmp_path):
    """Repeated and null ids and times included."""
    start = "timestamp '2024-01-28 11:59:00'"
    rows = spark.range(0, 5000).selectExpr(
        "if(id % 701 = 0, null, id % 4400) event_id", f"if(id % 89 = 0, null, {start} + make_interval(0,0,0,0,0,id % 3)) ts",
        "id % 7 user_id", "id * 0.25d value", "'x' event_type", "'{}' props",
    )
    rows.write.parquet(str(tmp_path / "events.parquet"))
    branches = fixture.RECIPE.format(
        text="string", iso="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")", epoch="unix_timestamp(ts)",
        events="{source}", deliveries=fixture.DELIVERIES,
    )
    want = spark.sql(fixture._escape(branches), source=rows)
    got = fixture.arrivals(spark, str(tmp_path)).select(*want.columns)
    assert {r["k"] for r in want.selectExpr("seq % 10 as k").distinct().collect()} == {None, 0, 5, 7}
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_numbers_are_read_as_what_they_are(spark):
    texts = ["0", "-0.0", "9223372036854775807", "9007199254740993", "0.1", "123.4560", "1e400", "1e-7", "0.30000000000000004",
             "12345678901234567890123456789", "1.2345678901234567890123456789012345678901", '"1"', "true", "null", "{}", "[1]"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("parse_json(t) v", "schema_of_variant(parse_json(t)) k")
    both = rows.selectExpr(f"if({ecma.is_numeric('k')}, try_variant_get(v, '$', 'double'), null) a", f"{ecma.double_from('v', 'k')} b")
    assert [(str(r["a"]), str(r["b"])) for r in both.collect() if str(r["a"]) != str(r["b"])] == []
    assert both.where("b is not null").count() == 11


def _payloads(make_arrivals):
    """Two keys that arrive twice, among keys that arrive once."""
    items = [("cursor", {"request_id": f"c{i}", "timestamp": "2024-01-01T00:00:00Z", "tokens": {"in": i}}) for i in range(6)]
    items += [("cursor", {"request_id": "c1", "timestamp": "2024-01-01T00:00:00Z", "tokens": {"in": 1}, "billing": {"usd": 0.5}})]
    items += [("openai", {"id": "o1", "created": 1704067200, "model": "m", "cost": {"amount_usd": c}}) for c in (None, 0.25)]
    return make_arrivals(items)


def test_replay_parses_a_payload_once(spark, make_arrivals):
    stored = fold.corpus_table(cut(Tables(_payloads(make_arrivals)).accepted, "accepted"))
    text = plan(replay.replay_rows(stored, with_v3()))
    # Plans are printed from the end: what comes later in the text happens earlier.
    assert "parsejson" in text[text.index("Generate explode") :].lower().replace("_", "")


def test_keys_that_arrive_once_are_not_folded(spark, make_arrivals):
    """Only rows of the two other keys reach the fold and the merge; the results are those of a load as a whole."""
    rows = cut(Tables(_payloads(make_arrivals)).accepted, "accepted")
    several = cut(fold._repeated(rows), "several")
    once, others = fold._parted(rows, several)
    assert several.count() == 2 and (once.count(), others.count()) == (5, 4)
    whole = fold.events_table(rows)
    assert "LeftAnti" in plan(whole)
    assert {r.event_id: r.revision for r in whole.collect()} == {
        r.event_id: r.revision for r in fold.merge_events(cut(fold.events_table(rows.filter("seq < 55")), "first"), rows.filter("seq >= 55")).collect()
    }
    assert sorted(r.revision for r in whole.collect()) == [1, 1, 1, 1, 1, 2, 2]


def test_keys_beyond_the_broadcast_bound_are_parted_alike(spark, make_arrivals, monkeypatch):
    rows = cut(Tables(_payloads(make_arrivals)).accepted, "accepted")
    whole = fold.events_table(rows).collect()
    monkeypatch.setattr(fold, "MAX_REPEATED", 0)
    assert sorted(fold.events_table(rows).collect()) == sorted(whole)


def test_texts_to_reprint_are_found_in_one_pass(spark):
    """As by a search for each kind of text."""
    assert ecma.is_suspect("t").count("contains(") == 0
    texts = ["", "1.0", '{"a":1.0}', "[1.0,2]", "[1.0]", "0.0000001", "0.000001", "1E5", '{"E":1}', '"\\u0001"', '"\\\\u"', "0.05", "1.01",
             "1234567890.12345", "123456789.12345", '"2024-01-01T00:00:00.000Z"', "1.0 ", "a.0", "5e3"]
    old = """(contains(t, '.0,') or contains(t, '.0]') or contains(t, '.0}') or contains(t, '.000000') or contains(t, r'\\u00')
        or endswith(t, '.0') or (contains(t, 'E') and t rlike '[0-9]E') or t rlike '[0-9.]{16}')"""
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", f"{ecma.is_suspect('t')} as now", f"{old} as before")
    assert [r for r in rows.collect() if r.now != r.before] == []
