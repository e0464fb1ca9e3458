"""Each stage of the pipeline against what it must keep, on its own input."""

import re

import pytest

import corpus_pipeline
from tallyguard.llm import decontaminate, quality
from tallyguard.llm.queries import TARGETS

from .test_neardup import brute_classes, idf_function

MIDDLE = "/root/testdata/sf0.01"
SECRET = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}|AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}""", re.I)


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("pipeline") / str(k))
        stage(spark, out[-1], MIDDLE).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.select("doc_id", "text").collect()}


def test_columns_and_order(steps):
    assert [len(corpus_pipeline.STAGES)] + [s.columns for s in steps[1:5]] == [5] + [steps[0].columns] * 4
    assert steps[5].columns == [*steps[0].columns, "rate", "copies"]


def test_quality_keeps_the_good(spark, steps):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    kept = set(texts(steps[1]))
    assert len(good & kept) >= 0.97 * len(good) and len(bad & kept) <= 0.1 * len(bad)
    scored = quality.score_documents(steps[0], labels)
    assert kept == {r["doc_id"] for r in scored.where("predicted = 1").collect()}


def test_one_of_each_class_stays(steps):
    rows = list(texts(steps[1]).items())
    want = {c for _, c in brute_classes(rows, idf_function(steps[1]))}
    assert set(texts(steps[2])) == want


def test_no_item_stays(spark, steps):
    items = [r["text"].encode().split() for r in spark.read.parquet(f"{MIDDLE}/benchmark.parquet").collect()]

    def holds(text):
        have = decontaminate.shingles((text or "").encode().split())
        return any(len(decontaminate.shingles(w) & have) >= 0.8 * len(decontaminate.shingles(w)) for w in items)

    before = texts(steps[2])
    assert set(texts(steps[3])) == {d for d, t in before.items() if not holds(t)}


def test_secrets_are_blanked_and_nothing_else(steps):
    before, after = texts(steps[3]), texts(steps[4])
    assert set(before) == set(after)
    for d, t in before.items():
        found = SECRET.search(t or "")
        assert (after[d] != t) if found else (after[d] == t)
        assert "AKIA" not in (after[d] or "") and not re.search("[0-9a-f]{32}", after[d] or "")
    assert all(r["n_chars"] == len(r["text"]) for r in steps[4].collect())


def test_mix_keeps_every_document(steps):
    rows = steps[5].collect()
    assert {r["doc_id"] for r in rows} == set(texts(steps[4])) and min(r["copies"] for r in rows) >= 1
    tokens: dict[str, float] = {}
    for r in rows:
        tokens[r["lang"]] = tokens.get(r["lang"], 0) + r["rate"] * len((r["text"] or "").split())
    assert all(abs(tokens[d] / sum(tokens.values()) - share) < 0.02 for d, share in TARGETS.items())


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{MIDDLE}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
