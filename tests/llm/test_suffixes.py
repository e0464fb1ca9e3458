"""Byte-level substring deduplication against brute force."""

from collections import Counter

import numpy as np
import pytest

from tallyguard.llm import segments, suffixes

from ..conftest import SMALL


def brute(rows, width=200):
    listed = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(d[at : at + width] for _, d in listed for at in range(len(d) - width + 1))
    out = []
    for i, d in listed:
        gone = np.zeros(len(d), bool)
        for at in range(len(d) - width + 1):
            if times[d[at : at + width]] > 1:
                gone[at : at + width] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(d) else 0
        out.append((i, len(d), int(gone.sum()), spans, np.frombuffer(d, np.uint8)[~gone].tobytes()))
    return sorted(out, key=str)


def made(frame):
    rows = suffixes.remove_repeats(frame).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows), key=str)


def random_rows(seed):
    rng = np.random.default_rng(seed)
    text = lambda n, kinds: "".join(chr(97 + x) if x < 25 else "é" for x in rng.integers(0, kinds, n))
    passage, long = text(700, 26), text(900, 2)
    rows = []
    for i in range(40):
        parts = [text(int(rng.integers(0, 300)), 26)]
        for _ in range(int(rng.integers(0, 4))):
            source = passage if rng.random() < 0.6 else long
            a = int(rng.integers(0, len(source) - 250))
            parts += [source[a : a + int(rng.integers(150, 450))], text(int(rng.integers(0, 50)), 26)]
        if rng.random() < 0.3:
            parts += ["a" * int(rng.integers(100, 500)), "xy" * int(rng.integers(80, 200))]
        rows.append((int(i), "".join(parts)))
    rows += [(100, rows[7][1]), (7, rows[7][1]), (None, rows[8][1]), (101, None), (102, ""), (103, "z" * 200), (104, "q" * 201)]
    return rows


@pytest.mark.parametrize("seed, group", [(1, 2048), (2, 3)])
def test_against_brute_force(spark, monkeypatch, seed, group):
    """The second case spreads every gram over several groups."""
    monkeypatch.setattr(segments, "CHUNK", 3000)
    monkeypatch.setattr(suffixes, "GROUP", group)
    rows = random_rows(seed)
    frame = spark.createDataFrame([(i, t, 1, None) for i, t in rows], "doc_id long, text string, seg int, kept string")
    assert made(frame) == brute(rows)


def test_whole_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert made(docs) == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_very_long_text(spark):
    rng = np.random.default_rng(3)
    long = "".join(map(chr, rng.integers(97, 123, 400_000)))
    rows = [(1, long), (2, long[5000:] + "!"), (3, "x" * 300_000)]
    got = made(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [g[1:4] for g in got] == [(400_000, 395_000, 1), (395_001, 395_000, 1), (300_000, 300_000, 1)]


def test_empty(spark):
    assert made(spark.createDataFrame([], "doc_id long, text string")) == []


def test_deep_shallow_order():
    rng = np.random.default_rng(4)
    data = bytes(rng.integers(97, 99, 3000, dtype=np.uint8))
    data = data + data[:900] + b"a" * 600
    starts = np.arange(len(data) - 200 + 1)
    got = [sorted(g) for g in suffixes.deep_shallow(data, starts)]
    groups: dict[bytes, list[int]] = {}
    for s in starts.tolist():
        groups.setdefault(data[s : s + 200], []).append(s)
    assert got == [g for _, g in sorted(groups.items()) if len(g) > 1]
