"""Nearest neighbours against comparison with all rows."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyguard.llm import neighbours

from ..conftest import SMALL

SCHEMA = "vec_id bigint, embedding array<float>"
def is_query():
    return F.col("vec_id") % 100 == 0



def found(df, k=10):
    out = defaultdict(list)
    for row in neighbours.search(df, is_query(), k).orderBy("query_id", "rank").collect():
        out[row.query_id].append((row["rank"], row.vec_id, row.score))
    return dict(out)


def brute(rows, k=10):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None})
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for place in np.flatnonzero(ids % 100 == 0):
        far = np.zeros(len(ids))
        for d in range(vectors.shape[1]):
            far += (vectors[place, d] - vectors[:, d]) ** 2
        order = [j for j in np.lexsort((ids, far)) if j != place][:k]
        if order:
            out[int(ids[place])] = [(n + 1, int(ids[j]), float(np.sqrt(far[j]))) for n, j in enumerate(order)]
    return out


def recall(got, want):
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in w}) for q, w in want.items())
    return hits / sum(len(w) for w in want.values())


def rows_of(df):
    return [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]


@pytest.mark.parametrize("table", [SMALL, SMALL.replace("0.001", "0.1")])
def test_recall_on_the_tables(spark, table):
    df = spark.read.parquet(f"{table}/embeddings.parquet")
    got, want = found(df), brute(rows_of(df))
    assert set(got) == set(want) and recall(got, want) >= 0.9
    exact = {(q, i): s for q, w in want.items() for _, i, s in w}
    for q, hits in got.items():
        assert [n for n, _, _ in hits] == list(range(1, 11))
        assert hits == sorted(hits, key=lambda h: (h[2], h[1]))
        assert all(s == exact[q, i] for _, i, s in hits if (q, i) in exact)


def test_clustered_vectors_need_small_windows(spark, monkeypatch):
    random = np.random.default_rng(5)
    centres = random.standard_normal((40, 16)) * 20
    rows = [(i, (centres[i % 40] + random.standard_normal(16)).tolist()) for i in range(4000)]
    seen, measure = [], neighbours._window
    monkeypatch.setattr(neighbours, "_window", lambda *a: seen.append(measure(*a)) or seen[-1])
    df = spark.createDataFrame(rows, SCHEMA)
    assert recall(found(df), brute(rows_of(df))) >= 0.9
    assert seen[0] < 200


def test_ties_go_to_the_smaller_id(spark):
    # One-hot vectors: all are equally far from each other.
    rows = [(i, [1.0 if j == i % 40 else 0.0 for j in range(40)]) for i in range(0, 120, 3)]
    rows += [(100, [0.0] * 39 + [5.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == brute(rows)


def test_large_groups_of_copies(spark):
    random = np.random.default_rng(6)
    copies = [[1.0, 2.0, 3.0], [4.0, 4.0, 4.0]]
    rows = [(i, copies[i % 2] if i % 3 else random.standard_normal(3).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got, want = found(df), brute(rows_of(df))
    assert recall(got, want) >= 0.9
    for q in want:
        if q % 3:
            assert got[q] == want[q]  # ten copies, smallest ids first


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(100, [1.0, 0.0]), (200, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [2.0, 2.0])]
    bad = [
        (300, None), (5, []), (6, [0.0, 0.0]), (400, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]),
        (None, [1.0, 1.0]), (500, [1.0, 2.0, 3.0]),
    ]
    got = found(spark.createDataFrame(good + bad, SCHEMA))
    assert got == brute(good) and set(got) == {100, 200}
    assert [len(v) for v in got.values()] == [3, 3]


def test_repeated_rows_and_ids(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [3.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0])]
    got = neighbours.search(spark.createDataFrame(rows, SCHEMA), is_query()).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [
        (100, 1, 7, 0.0), (100, 1, 7, 2.0), (100, 2, 100, 2.0), (100, 2, 100, 2.0),
    ]


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(100, [1.0, 2.0])], [(1, [1.0]), (2, [2.0])], [(100, None)]])
def test_tables_without_pairs(spark, rows):
    assert found(spark.createDataFrame(rows, SCHEMA)) == {}


def test_other_types_and_clashing_columns(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(0, 400, 20)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>").selectExpr(
        "*", "1 as point", "2 as idx", "3 as n", "4 as far", "5 as rank", "6 as v", "7 as length", "8 as curve"
    )
    assert found(df) == brute(rows)


def test_neighbouring_places_are_neighbouring_cells():
    """A Hilbert curve visits every cell once and moves by one cell at a time."""
    for dims, bits in ((1, 5), (2, 4), (3, 3), (4, 2)):
        axes = np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")
        cells = np.stack([a.ravel() for a in axes], axis=1)
        places = neighbours.hilbert_places(cells, bits)
        assert sorted(places) == list(range(len(cells)))
        path = cells[np.argsort(places)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
