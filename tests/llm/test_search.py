"""BM25 search and decontamination against brute force."""

import math
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tallyguard.llm import decontaminate, search
from tallyguard.llm.queries import ORACLE, QUERIES

from ..compare import connect, differences
from ..conftest import SMALL


def brute_search(rows, queries, k):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    n, mean = len(words), sum(len(w) for _, w in words) / max(1, len(words))
    df = Counter(w for _, ws in words for w in set(ws))
    out = []
    for q, text in queries:
        scores = []
        for i, ws in words:
            tf = Counter(ws)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in set((text or "").encode().split()) if tf[w])
            if s > 0 and i is not None:
                scores.append((-round(s, 6), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_search_matches_sql(spark):
    assert differences(QUERIES["op10_search"](spark, SMALL), connect(SMALL), ORACLE["op10_search"]) == []


@pytest.mark.parametrize("shard_docs", [3, 7, 10_000])
def test_search_against_brute_force(spark, monkeypatch, shard_docs):
    """Many small shards and blocks; frequent and rare words, ties, repeated rows, null ids."""
    rng = np.random.default_rng(shard_docs)
    rows = [(int(i), " ".join(f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(0, 60)) if x < 400)) for i in range(200)]
    rows += [(200, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (201, None), (202, ""), (203, "long " * 3000)]
    monkeypatch.setattr(search, "SHARD_DOCS", shard_docs)
    docs = spark.createDataFrame([(i, t, "x", None) for i, t in rows], "doc_id long, text string, rank string, terms int").coalesce(2)
    queries = docs.where("doc_id % 5 = 0 or doc_id is null")
    index = search.cut(search.build_index(docs), "test-index")
    got = search.search(index, queries.withColumnRenamed("doc_id", "query_id"), 4, block_words=300)
    want = brute_search(rows, [(i, t) for i, t in rows if i is not None and i % 5 == 0], 4)
    assert sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 4)) for r in got.collect()) == [(*w[:3], round(w[3], 4)) for w in want]


def test_index_is_read_in_small_parts(spark, monkeypatch):
    """However many documents one task indexes, the JVM reads a few MB of its file at a time."""
    cut, stored = search.cut, []
    monkeypatch.setattr(search, "cut", lambda *a, **o: stored.append(cut(*a, **o)) or stored[-1])
    words = "array_join(transform(sequence(1, 250), i -> concat('w', pmod(xxhash64(id, i), 60000))), ' ')"
    docs = spark.range(0, 12_000, 1, 1).selectExpr("id as doc_id", f"{words} as text")
    got = search.search_documents(docs, docs.where("doc_id % 4000 = 0"), 3).collect()
    assert sorted((r["query_id"], r["doc_id"]) for r in got if r["rank"] == 1) == [(i, i) for i in (0, 4000, 8000)]
    files = [pq.ParquetFile(f.removeprefix("file:")) for f in stored[0].inputFiles()]
    parts = [f.read_row_group(i).nbytes for f in files for i in range(f.num_row_groups)]
    assert len(parts) > 1 and max(parts) < 8e6


def test_small_pieces_and_blocks(spark, monkeypatch):
    """Shards of many pieces, blocks of few queries, texts longer than a piece."""
    rng = np.random.default_rng(5)
    rows = [(int(i), " ".join(f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(0, 60)) if x < 400)) for i in range(150)]
    rows += [(150, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (151, None), (152, ""), (153, " ".join(f"w{i}" for i in range(300)))]
    for name, value in {"PIECE_POSTINGS": 40, "SHARD_POSTINGS": 700, "BLOCK_QUERIES": 5}.items():
        monkeypatch.setattr(search, name, value)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = search.search_documents(docs, docs.where("doc_id % 5 = 0 or doc_id = 153 or doc_id is null"), 4)
    want = brute_search(rows, [(i, t) for i, t in rows if i is not None and (i % 5 == 0 or i == 153)], 4)
    assert sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 4)) for r in got.collect()) == [(*w[:3], round(w[3], 4)) for w in want]


def test_pieces_and_bounded_matrix(monkeypatch):
    """Pieces give back what they hold, joined ones are one shard, and the size of the matrix changes no hit."""
    rng = np.random.default_rng(6)
    texts = [[], *(rng.choice(rng.integers(-(2**63), 2**63 - 1, 50), rng.integers(1, 40), replace=False) for _ in range(3))]
    common = rng.integers(-(2**63), 2**63 - 1, 30)
    texts += [rng.choice(common, rng.integers(1, 30), replace=False) for _ in range(200)]
    texts, ids = [np.array(t, np.int64) for t in texts], [search._NO_ID, 2**63 - 1, -5, *range(201)]
    tfs = [rng.integers(1, 10, len(t)).astype(np.int32) for t in texts]
    rows = []
    for at in range(0, len(ids), 30):
        own = slice(at, at + 30)
        batch = search._pack(texts[own], tfs[own], ids[own], [int(t.sum()) for t in tfs[own]])
        rows.append((batch.column(0)[0].as_py(), batch.column(2)[0].as_py(), batch.column(3)[0].as_py()))
    (whole,) = search._shards(rows, 10**6, 10**6)
    assert whole["ids"].tolist() == ids and whole["lengths"].tolist() == [int(t.sum()) for t in tfs]
    assert (np.diff(whole["terms"]) > 0).all()
    want = {(int(t), i): int(n) for i, (text, some) in enumerate(zip(texts, tfs, strict=True)) for t, n in zip(text, some, strict=True)}
    assert dict(zip(zip(np.repeat(whole["terms"], whole["sizes"]).tolist(), whole["docs"].tolist(), strict=True), whole["tfs"].tolist(), strict=True)) == want
    starts = np.cumsum(whole["sizes"]) - whole["sizes"]
    assert all((np.diff(whole["docs"][at : at + n]) > 0).all() for at, n in zip(starts, whole["sizes"], strict=True))
    assert [len(s["ids"]) for s in search._shards(rows, 10**6, 60)] == [60, 60, 60, len(ids) - 180]

    vocabulary = np.sort(common)
    hits = []
    for cells in (10**6, 1000, 0):
        monkeypatch.setattr(search, "DENSE_CELLS", cells)
        shard = search.Shard(whole, 20.0, vocabulary, np.linspace(0.5, 3.0, 30))
        assert shard.dense.size <= cells
        found = shard.search([np.arange(30, dtype=np.int32), np.arange(0, 30, 4, dtype=np.int32)], 10, [0.0, 0.0])
        hits.append([[x.tolist() for x in search.best(*h, 10)] for h in found])
    assert hits[0] == hits[1] == hits[2] and all(len(h[0]) == 10 for h in hits[0])


def test_search_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(0, "a b"), (1, None)], "doc_id long, text string")
    assert search.search_documents(none, some).collect() == []
    assert search.search_documents(some, none).collect() == []
    assert [r["doc_id"] for r in search.search_documents(some, some).collect()] == [0]


def contained(item, text):
    have = decontaminate.shingles(text)
    size = min(5, len(item))
    have = {tuple(text[i : i + size]) for i in range(len(text) - size + 1)}
    want = decontaminate.shingles(item)
    return len(want & have) / len(want) if want else 0.0


def test_leaks_against_brute_force(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode().split() for r in docs.collect()}
    items = {r["item_id"]: r["text"].encode().split() for r in bench.collect()}
    want = {(d, i) for d, t in texts.items() for i, w in items.items() if contained(w, t) >= 0.8}
    assert got == want and want
    kept = {r["doc_id"] for r in decontaminate.drop_leaked(docs, bench).collect()}
    assert kept == set(texts) - {d for d, _ in want}


def test_leak_edges(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_ITEMS", 2)
    question = "what is the name of the tall grey bird that stands in the reeds all day"
    items = [(1, f"{question}? It is the heron of the northern lakes."), (1, f"{question}? It is the heron of the northern lakes."), (2, "one two"), (3, None), (4, " \n"), (None, "six words are enough for this")]
    bench = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, doc_id string")
    filler = " ".join(f"word{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, f"{filler} {items[0][1]} {filler}"), (3, f"{filler} {items[0][1]} {filler}"), (4, question), (None, "zero one two three"), (5, filler), (6, "six words are enough for this")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect())
    # The question alone is no leak.
    assert got == {(3, 1): 4, (None, 2): 1, (6, None): 1}
    assert decontaminate.drop_leaked(docs, bench).columns == ["doc_id", "text", "score"]
    assert decontaminate.drop_leaked(docs, bench).count() == 4
    assert decontaminate.find_leaks(docs, bench.limit(0)).collect() == []
    assert decontaminate.find_leaks(docs.limit(0), bench).collect() == []


def test_leaks_in_other_case_and_punctuation(spark):
    """Whole items in capitals, in title case, in quotation marks, and with other marks after the words."""
    item = "Which of the old harbour towns has the tallest lighthouse on the coast? It is the town of Straße-am-Meer, in the north."
    filler = " ".join(f"word{i}" for i in range(500))
    copies = [item, item.upper(), item.lower(), item.title(), f"\u201c{item}\u201d", item.replace(" ", ", "), item.replace(" ", " (")]
    docs = spark.createDataFrame([(i, f"{filler} {c} {filler}") for i, c in enumerate(copies)] + [(100, filler), (101, filler.upper())], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "ONLY three Words!"), (3, "?!")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()} == {(i, 1) for i in range(len(copies))}
    assert {r["doc_id"] for r in decontaminate.drop_leaked(docs, bench).collect()} == {100, 101}
    short = spark.createDataFrame([(1, "so: only THREE words"), (2, "what ?!")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(short, bench).collect()} == {(1, 2), (2, 3)}


def test_planted_item_in_capitals(spark):
    """An item of the table, in capitals inside a document of the table."""
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    clean = decontaminate.drop_leaked(docs, bench).orderBy("doc_id").first()["text"]
    items = [(r["item_id"], r["text"]) for r in bench.orderBy("item_id").limit(5).collect()]
    planted = spark.createDataFrame([(i, f"{clean} {t.upper()} {clean}") for i, t in items], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(planted, bench).collect()}
    assert got >= {(i, i) for i, _ in items}
