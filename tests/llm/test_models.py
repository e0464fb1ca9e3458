"""The quality classifier and the mix: held-out accuracy, brute force, edge rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyguard.llm import mixing, quality
from tallyguard.llm.queries import TARGETS, labelled_domains

MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    scored = quality.score_documents(docs, labels)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = scored.join(labels.select("doc_id", "quality"), "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    fold = [r for r in rows if r["held_out"] and r["quality"] is not None]
    right = [r["predicted"] == r["quality"] for r in fold]
    assert len(fold) > 50 and np.mean(right) > 0.9
    assert np.mean([r["predicted"] for r in fold if r["quality"] == 1]) > 0.95


def test_labels_of_the_held_out_fold_are_not_used(tables):
    docs, labels = tables
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = (quality.fit(docs, x, 50, 100) for x in (labels, flipped))
    assert np.array_equal(one.weights, other.weights) and one.bias == other.bias


def test_quality_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, "a", 1.0), (2, "", None, 2.0), (2, "", None, 2.0), (None, "some text", "b", None), (3, "x " * 50_000, "c", 0.0)],
        "doc_id long, text string, quality string, score double",
    )
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, None, 1), (None, 1, None)], "doc_id long, quality int, toxic int")
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    none = labels.limit(0)
    assert {r["score"] for r in quality.score_documents(docs, none).collect()} == {0.5}
    assert quality.score_documents(docs.limit(0), labels).collect() == []
    assert quality.keep_good(docs, none).collect() == []


def test_rates_meet_the_targets(tables):
    docs, labels = tables
    rows = mixing.rates(docs, labelled_domains(docs, labels), TARGETS).collect()
    assert len(rows) == docs.count()
    names = sorted(TARGETS)
    totals = np.array([np.array(r["posterior"]) * r["rate"] * r["n_tokens"] for r in rows]).sum(0)
    assert np.allclose(totals / totals.sum(), [TARGETS[n] for n in names], atol=1e-6)
    assert min(r["rate"] for r in rows) >= 1 and min(r["copies"] for r in rows) >= 1
    # What is still missed is reported, and is as small as the sums say.
    worst = max(abs(t / totals.sum() - TARGETS[n]) for t, n in zip(totals, names))
    assert {r["miss"] for r in rows} == {rows[0]["miss"]} and worst <= rows[0]["miss"] + 1e-9 <= 1e-6
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert np.mean([truth[r["doc_id"]] == r["domain"] for r in rows]) > 0.97


def test_projection_against_brute_force(spark):
    """A total so low that some rates hit zero: same optimum as plain small steps."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.4, 0.4, 0.4], 60)
    tokens = rng.integers(0, 50, 60)
    frame = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p)], "tokens long, p array<double>")
    targets, total = np.array([0.9, 0.1, 0.0]), 300.0
    steps = mixing.solve(frame, targets, total)
    got = np.array([r[0] for r in frame.select(mixing._rate(steps)).collect()])
    a = (p * tokens[:, None]).T
    inverse = np.linalg.inv(sum(t * np.outer(x, x) for t, x in zip(tokens, p)))
    rates = np.ones(60)
    for _ in range(20_000):
        rates = np.maximum(0, rates - 0.5 * p @ (inverse @ (a @ rates - targets * total)))
    miss = lambda r: (a @ r - targets * total) @ inverse @ (a @ r - targets * total)
    assert (got >= 0).all() and (got == 0).any()
    assert miss(got) <= miss(rates) + 0.02 * miss(np.zeros(60))


def test_mix_edges(spark):
    schema = "doc_id long, text string, lang string, rate string, p int, tokens int"
    rows = [(1, None, "en", "x", 1, 2), (2, "", "de", None, None, 3), (2, "", "de", None, None, 3), (None, "the of", "en", "y", 1, 1), (5, "und der " * 9, "de", "z", 2, 2)]
    docs = spark.createDataFrame(rows, schema)
    labelled = docs.withColumnRenamed("lang", "domain")
    mixed = mixing.mix(docs, labelled, {"en": 0.5, "de": 0.5, "xx": 1.0})
    assert mixed.columns == ["doc_id", "text", "lang", "p", "tokens", "rate", "copies"] and mixed.count() == 5
    none = labelled.limit(0)
    assert [r["copies"] for r in mixing.mix(docs, none, TARGETS).collect()] == [1] * 5
    assert [r["rate"] for r in mixing.rates(docs, none, TARGETS).collect()] == [1.0] * 5
    assert mixing.rates(docs.limit(0), labelled, TARGETS).collect() == []


def test_a_miss_is_reported(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_STEPS", 1)
    rng = np.random.default_rng(7)
    p = rng.dirichlet([0.5, 0.5], 40)
    frame = spark.createDataFrame([(10, x.tolist()) for x in p], "tokens long, p array<double>")
    targets, total = np.array([0.95, 0.05]), 200.0
    steps, miss = mixing.descent(frame, targets, total)
    rate = np.array([r[0] for r in frame.select(mixing._rate(steps)).collect()])
    have = (rate[:, None] * 10 * p).sum(0)
    assert len(steps) == 1 and miss == pytest.approx(np.abs(have - targets * total).max() / total) and miss > 1e-4


def test_domains_without_a_target_stay(tables):
    docs, labels = tables
    targets = {"en": 0.5, "de": 0.5}
    labelled = labelled_domains(docs, labels)
    rows = mixing.rates(docs, labelled, targets).collect()
    assert {r["rate"] for r in rows if r["domain"] not in targets} == {1.0}
    share = {d: sum(r["rate"] * r["n_tokens"] for r in rows if r["domain"] == d) for d in targets}
    assert share["en"] / sum(share.values()) == pytest.approx(0.5, abs=0.02)
    extra = docs.withColumn("_judged", F.lit("mine"))
    mixed = mixing.mix(extra, labelled, targets)
    assert mixed.count() == docs.count() and {r["_judged"] for r in mixed.select("_judged").collect()} == {"mine"}


def test_features_are_gathered_without_copies():
    """The driver once held the sampled rows four times: in two tables, as Python objects and as a matrix."""
    rng = np.random.default_rng(5)
    ids = rng.permutation(4000)
    rows = rng.random((4000, quality.BYTES + 16)).astype(np.float32)
    column = pa.array([r.tobytes() for r in rows], pa.binary())
    chunks = pa.chunked_array([column.slice(0, 1500), pa.array([], pa.binary()), column.slice(1500)])
    tracemalloc.start()
    made = quality._matrix(pa.chunked_array([ids[:100], ids[100:]]), chunks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(made, rows[np.argsort(ids)]) and peak < 1.5 * rows.nbytes
    assert quality._matrix(pa.chunked_array([], pa.int64()), pa.chunked_array([], pa.binary())).shape == (0, rows.shape[1])
