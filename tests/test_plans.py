"""Properties of the physical plans and of the bounded-window helpers."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from tallyguard.operators import drift, fold, prefix, reports
from tallyguard.operators.replay import replay_matrix, replay_rows
from tallyguard.plans.queries import QUERIES, with_v2
from tallyguard.plans.tables import Tables
from tallyguard.session import cut, lookup

from .conftest import SMALL


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture(scope="module")
def tables(spark):
    return Tables.from_source(spark, SMALL)


def test_recent_rows_are_cut_before_the_shuffle(tables):
    for df in (drift.field_stats(tables.presence), reports.field_vitals(tables.presence)):
        text = plan(df)
        assert text.count("WindowGroupLimit") == 2
        final = text.index("WindowGroupLimit")
        shuffle = text.index("Exchange hashpartitioning(provider", final)
        assert "WindowGroupLimit" in text[shuffle:]


def test_spend_report_is_hash_aggregation_only(tables):
    text = plan(reports.weekly(tables.folded))
    assert "SortAggregate" not in text and "Window" not in text
    # Source spread over the cores, events, exact sums per range of decimal places, report.
    assert text.count("Exchange") == 4


def test_source_columns_are_pruned(spark):
    text = plan(QUERIES["weekly_cost"](spark, SMALL))
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert scans and all("props" not in line and "event_type" not in line for line in scans)


def test_replay_shuffles_counters_only(tables):
    rows = replay_rows(tables.stored_corpus, with_v2())
    text = plan(replay_matrix(rows, with_v2()))
    assert text.count("Exchange hashpartitioning") == 1
    assert "Python" not in text


@pytest.mark.parametrize("name", ["events", "structural_alerts", "replay_diff", "recent_events", "payload_paths"])
def test_no_python_in_the_plan(spark, name):
    assert "Python" not in plan(QUERIES[name](spark, SMALL))


@pytest.mark.parametrize("max_rows", [3, 1_000_000])
def test_ranks_and_running_totals(spark, max_rows):
    rng = random.Random(5)
    seqs = sorted(rng.sample(range(0, 1 << 40, 7919), 400))
    rows = [(rng.choice("aab"), s, rng.randrange(-3, 9)) for s in seqs]
    df = cut(spark.createDataFrame(rows, "g string, seq bigint, v bigint"), "rows")
    ranks = {r.seq: r["rank"] for r in prefix.ranked(df, "g", "seq", max_rows=max_rows).collect()}
    totals = {r.seq: r.v for r in prefix.running_totals(df, "g", "seq", ["v"], max_rows=max_rows).collect()}
    count, total = {}, {}
    for g, s, v in rows:
        count[g], total[g] = count.get(g, 0) + 1, total.get(g, 0) + v
        assert (ranks[s], totals[s]) == (count[g], total[g])


def test_lookup_is_the_same_either_way(spark):
    big = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("k"))
    small = spark.createDataFrame([(0, "x"), (1, "y")], "k bigint, name string")
    broadcast = lookup(big, small, "k", "id", max_rows=10)
    salted = lookup(big, small, "k", "id", max_rows=1, salts=8)
    assert "_salt" not in salted.columns
    assert broadcast.select("id", "k", "name").exceptAll(salted.select("id", "k", "name")).count() == 0
    assert salted.count() == 500


def test_one_key_with_most_rows_is_spread(spark, make_arrivals):
    """A key's arrivals are ordered in ranges, never in one window over the whole key."""
    text = plan(fold.events_table(Tables(make_arrivals([("openai", {"id": "hot"})])).stored_light))
    windows = [line for line in text.splitlines() if "Window [" in line or "Window (" in line]
    assert windows
    first_shuffle = text.rindex("Exchange hashpartitioning(dedup_key")
    assert "_range" in text[first_shuffle : first_shuffle + 120]


def test_payloads_are_not_shuffled_to_be_compared(spark, make_arrivals):
    rows = Tables(make_arrivals([("openai", {"id": str(i % 3)}) for i in range(9)])).stored_accepted
    corpus = fold.corpus_table(rows)
    assert corpus.count() == 3
    text = plan(corpus)
    assert "BroadcastHashJoin" in text and "payload" in text
    assert "Exchange hashpartitioning" not in text
