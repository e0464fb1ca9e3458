"""The Merkle manifest against a sequential build, and against its SQL on odd tables."""

import hashlib
import string
import zlib

import duckdb
import pytest

from tallyguard.llm import merkle, merkle_sql

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(digests):
    """The root and, per node, its siblings (left, right) on every level."""
    paths, at, nodes = [[] for _ in digests], list(range(len(digests))), digests
    while len(nodes) > 1:
        for i, place in enumerate(at):
            low = place // 16 * 16
            run = nodes[low : low + 16]
            paths[i].append(("".join(run[: place - low]), "".join(run[place - low + 1 :])))
            at[i] = place // 16
        nodes = [H("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def sequential(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[3], []).append((row[0], leaf(row, row[1]), row))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        members = sorted(sources[source], key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
        trees.append((members, *climb([m[1] for m in members])))
    if not trees:
        return []
    root, above = climb([subroot for _, subroot, _ in trees])
    out = []
    for (members, subroot, paths), rest in zip(trees, above):
        for (doc_id, digest, row), path in zip(members, paths):
            text = row[1]
            if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
                text = text.translate(LOWER)
            folded, way = leaf(row, text), path + rest
            for left, right in way:
                folded = H(left + folded + right)
            out.append((doc_id, digest, subroot, root, H("".join(a + b for a, b in way)), folded, folded == root))
    return sorted(out, key=str)


def rows_of(spark, rows):
    built = merkle.build(spark.createDataFrame(rows, SCHEMA))
    return sorted((tuple(r) for r in built.collect()), key=str)


def many(n, source):
    return [(i, f"Text {i} ÄÖ {source}", "en", source, i) for i in range(n)]


CASES = {
    "empty": [],
    "one row": [(5, "ABC", "en", "web", 3)],
    "one full run": many(16, "a"),
    "a run of one at the end": many(17, "a"),
    "three levels and a lone source": many(273, "hot") + [(9000, "x", None, None, None)],
    "many sources": [(i, "T" * (i % 7), "de", f"s{i % 40:02}", 1) for i in range(300)],
    "nulls": [(None, None, None, None, None), (None, "A", None, "z", 1), (7, None, "en", "z", None), (8, "", "", "", 0)],
    "repeated rows and ids": many(20, "a") + many(20, "a") + [(3, "other", "en", "a", 5)] * 2,
    "sources in byte order": [(i, "Q", "en", s, 1) for i, s in enumerate(["z", "Z", "ä", "", None, "\U0001f600", "￮"])],
    "a long text": [(i, "LONG word " * 50_000, "en", "a", 500_000) for i in range(30)],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_equals_sequential(spark, name):
    assert rows_of(spark, CASES[name]) == sequential(CASES[name])


@pytest.mark.parametrize("name", ["many sources", "nulls", "repeated rows and ids"])
def test_sql_equals_sequential(name):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", CASES[name])
    assert sorted(con.execute(merkle_sql.statement()).fetchall(), key=str) == sequential(CASES[name])


def test_only_changed_texts_fail(spark):
    rows = [(i, "UPPER" if i % 2 else "lower 1 ä", "en", f"s{i % 3}", 1) for i in range(200)]
    for doc_id, *_, verified in rows_of(spark, rows):
        tampered = zlib.crc32(str(doc_id).encode()) % 5 == 0 and doc_id % 2 == 1
        assert verified is not tampered


def test_clashing_columns_do_not_matter(spark):
    rows = many(40, "a")
    extra = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "1 as tree", "2 as idx", "'x' as n", "'y' as digest", "'z' as _salt", "3 as _at", "4 as run", "5 as tampered"
    )
    assert sorted((tuple(r) for r in merkle.build(extra).collect()), key=str) == sequential(rows)


def test_query_matches_sql_on_the_table(spark):
    from tallyguard.llm.queries import ORACLE, QUERIES

    from ..compare import connect, differences
    from ..conftest import SMALL

    assert differences(QUERIES["op12_merkle"](spark, SMALL), connect(SMALL), ORACLE["op12_merkle"]) == []
