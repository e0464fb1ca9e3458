"""Word-level substring deduplication against brute force."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyguard.llm import segments, substrings
from tallyguard.llm.queries import ORACLE, QUERIES

from ..compare import connect, differences
from ..conftest import SMALL


def brute(rows, width=50):
    listed = [(i, (t or "").encode().split()) for i, t in rows]
    first: dict[tuple, int] = {}
    for i, words in listed:
        if i is not None:
            for at in range(len(words) - width + 1):
                key = tuple(words[at : at + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, words in listed:
        gone = set()
        if i is not None:
            for at in range(len(words) - width + 1):
                if first[tuple(words[at : at + width])] < i:
                    gone |= set(range(at, at + width))
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out, key=str)


def made(frame):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeats(frame).collect()), key=str)


def random_rows(seed):
    rng = np.random.default_rng(seed)
    word = lambda n, kinds: [f"w{x}" for x in rng.integers(0, kinds, n)]
    passage, long = word(120, 50), word(400, 3)
    rows = []
    for i in range(40):
        parts = [word(int(rng.integers(0, 60)), 1000)]
        for _ in range(int(rng.integers(0, 4))):
            source = passage if rng.random() < 0.6 else long
            a = int(rng.integers(0, len(source) - 50))
            parts += [source[a : a + int(rng.integers(40, 120))], word(int(rng.integers(0, 30)), 1000)]
        if rng.random() < 0.3:
            parts += [["a"] * int(rng.integers(30, 200)), word(3, 9), ["x", "y"] * int(rng.integers(20, 80))]
        rows.append((int(i), " ".join(w for p in parts for w in p)))
    rows += [(100, rows[7][1]), (7, rows[7][1]), (7, rows[8][1]), (None, rows[7][1]), (101, None), (102, ""), (103, " \t\n"), (-5, rows[9][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(segments, "CHUNK", 500)
    rows = random_rows(seed)
    frame = spark.createDataFrame([(i, t, 1, None) for i, t in rows], "doc_id long, text string, seg int, kept string")
    assert made(frame) == brute(rows)


def test_very_long_text(spark):
    words = " ".join(f"v{i % 7001}" for i in range(150_000))
    rows = [(1, words), (2, words[1000:]), (3, "tail " + words[-5000:])]
    got = made(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [g[2] for g in got] == [w[2] for w in brute(rows)]


def test_empty(spark):
    assert made(spark.createDataFrame([], "doc_id long, text string")) == []


def test_query_matches_sql(spark):
    assert differences(QUERIES["op1_substrings"](spark, SMALL), connect(SMALL), ORACLE["op1_substrings"]) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=60, max_size=200), st.integers(0, 10), st.integers(0, 10))
def test_equal_windows_have_equal_anchors(core, left, right):
    """The same words in other surroundings give the same key and place for every window."""
    hashed = lambda xs: np.array([hash(("w", x)) & (2**64 - 1) for x in xs], np.uint64)
    plain, framed = hashed(core), hashed([7] * left + core + [9] * right)

    def keys(symbols):
        rows = substrings.anchored(symbols, np.array([len(symbols)]))
        return {int(lo) + k: int(key) for lo, n, key in zip(rows["lo"], rows["n"], rows["key"]) for k in range(n)}

    a, b = keys(plain), keys(framed)
    assert all(a[i] == b[i + left] for i in a)


def test_equal_symbols_in_different_places():
    h = substrings.word_hashes([b"a", b"b"] * 40)
    span = segments.SpanHashes(h)
    assert span(np.array([0]), np.array([50])) == span(np.array([10]), np.array([60]))
    assert span(np.array([0]), np.array([50])) != span(np.array([1]), np.array([51]))


def test_digest(spark):
    rows = spark.createDataFrame([(1, "a  b")], "doc_id long, text string")
    kept = substrings.remove_repeats(rows).select(F.sha2("kept", 256)).first()[0]
    assert kept == hashlib.sha256(b"a b").hexdigest()
