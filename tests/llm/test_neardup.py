"""Near duplicates against all pairs on small tables."""

from collections import Counter

import numpy as np
import pytest

from tallyguard.llm import neardup

MIDDLE = "/root/testdata/sf0.01"


def vectors(rows):
    """Weighted shingles of each text, without the operator's code for shingles."""
    listed = [tuple((t or "").encode().split()) for _, t in rows]
    bags = [Counter(w[i : i + 5] for i in range(max(1, len(w) - 4))) if w else Counter() for w in listed]
    return listed, bags


def brute_classes(rows, idf_of):
    listed, bags = vectors(rows)
    weighted = [{s: n * idf_of(s) for s, n in bag.items()} for bag in bags]
    where: dict[tuple, set[int]] = {}
    for k, w in enumerate(weighted):
        for s in w:
            where.setdefault(s, set()).add(k)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, w in enumerate(weighted):
        for m in {m for s in w for m in where[s] if m < k}:
            if rows[k][0] is None or rows[m][0] is None:
                continue
            low = sum(min(w[s], weighted[m][s]) for s in w if s in weighted[m])
            if low / (sum(w.values()) + sum(weighted[m].values()) - low) >= 0.8:
                parent[max(root(k), root(m))] = min(root(k), root(m))
    groups: dict[int, list[int]] = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(k)
    out = []
    for group in groups.values():
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        out += [(rows[k][0], min(ids) if ids else None) for k in group]
    return sorted(out, key=str)


def idf_function(docs):
    idf = neardup.inverse_frequencies(*neardup.document_frequencies(docs))

    def of(shingle):
        made = neardup.Shingles([b" ".join(shingle)])
        return idf[made.buckets()[0]]

    return of


def classes(frame):
    return sorted(((r["doc_id"], r["class_id"]) for r in neardup.near_classes(frame).collect()), key=str)


def test_against_all_pairs(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got, want = classes(docs), brute_classes(rows, idf_function(docs))
    assert len(got) == len(rows)
    assert got == want and len({c for _, c in want}) < len(rows)


def edge_rows():
    rng = np.random.default_rng(8)
    base = [f"b{x}" for x in rng.integers(0, 5000, 300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 30):  # a family of near copies and some further off
        words = list(base)
        for _ in range(int(rng.integers(1, 9))):
            words[int(rng.integers(0, 300))] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    common = " ".join(f"c{i}" for i in range(60))  # a passage that unrelated texts share
    rows += [(i, " ".join(f"r{x}" for x in rng.integers(0, 10**6, 200)) + " " + common) for i in range(100, 130)]
    rows += [(200, "one two"), (201, "one  two"), (202, "one two three"), (203, None), (204, None), (205, ""), (206, " \n")]
    rows += [(0, rows[0][1]), (300, rows[0][1]), (None, rows[0][1]), (301, "word " * 40_000), (302, "word " * 30_000), (303, "word " * 10_000)]
    return rows


def test_edges_against_all_pairs(spark):
    rows = edge_rows()
    frame = spark.createDataFrame([(i, t, 1, None) for i, t in rows], "doc_id long, text string, node int, class string")
    want = brute_classes(rows, idf_function(frame))
    assert classes(frame) == want
    kept = [r["doc_id"] for r in neardup.keep_one(frame).collect()]
    assert neardup.keep_one(frame).columns == ["doc_id", "text", "node", "class"]
    assert sorted(k for k in kept if k is not None) == sorted({c for _, c in want if c is not None})


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert classes(none) == [] and neardup.keep_one(none).collect() == []


def test_collisions_follow_the_similarity():
    """Samples of two weighted sets agree about as often as the sets are similar."""
    rng = np.random.default_rng(2)
    sampler, agreed, similar = neardup.Sampler(), [], []
    for _ in range(60):
        n = int(rng.integers(50, 400))
        words = [b"w%d" % x for x in rng.integers(0, 10**7, n)]
        other = list(words)
        for i in rng.integers(0, n, max(1, n // 60)):
            other[i] = b"y%d" % rng.integers(0, 10**7)
        made = neardup.Shingles([b" ".join(words), b" ".join(other)])
        idf = 1 + (np.arange(1 << neardup.DF_BITS) % 7)
        weights = made.weights(idf)
        bands = sampler.bands(made, weights, 2)
        agreed.append((bands[0] == bands[1]).mean())
        side = [(made.shingle[made.text == k], weights[made.text == k]) for k in range(2)]
        similar.append(neardup.weighted_jaccard(*side) ** neardup.ROWS)
    assert np.mean(agreed) == pytest.approx(np.mean(similar), abs=0.05)


def test_components(spark):
    """A long chain in bad order, a star, and a lone node."""
    chain = [(i, i + 1) for i in range(0, 100)]
    links = spark.createDataFrame(chain + [(1000, 1000 + i) for i in range(1, 9)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(101), *range(1000, 1009), 5000]], "node long")
    got = {r["node"]: r["class"] for r in neardup.components(nodes, links).collect()}
    assert {got[i] for i in range(101)} == {0} and {got[i] for i in range(1000, 1009)} == {1000} and got[5000] == 5000


def bridged_rows():
    """24 families: near copies of a text, and a row of copies that are near the one before and the one after only."""
    rows, at = [], 0
    for family in range(24):
        base = [f"f{family}w{i}" for i in range(400)]
        # 33 of 400 words differ between steps, so only neighbouring steps are near each other.
        for k in range(3):  # the centre and near copies
            rows.append((at + k, " ".join(f"{w}c{k}" if i < k else w for i, w in enumerate(base))))
        for k in range(12):  # a row of copies, each a step further from the centre
            words = [f"s{family}x{i}" if i < 33 * (k + 1) else w for i, w in enumerate(base)]
            rows.append((at + 3 + k, " ".join(words)))
        at += 20
    return rows


def test_bridges_in_one_bucket(spark):
    """All texts in one bucket: members linked to leaders of different classes are compared too."""
    rows = bridged_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = dict(brute_classes(rows, counted_idf(rows)))
    signed, n = neardup.signatures(neardup.with_row_key(frame))
    texts = signed.select(neardup.F.col("doc_id").alias("node"), "packed", "df")
    nodes = frame.select(neardup.F.col("doc_id").alias("node"))
    members = nodes.select(neardup.F.lit(7).cast("long").alias("bucket"), "node")
    got = {r["node"]: r["class"] for r in neardup._links(members, texts, nodes, n).collect()}
    assert got == want and 24 <= len(set(want.values())) < len(rows)


def counted_idf(rows):
    """Inverse frequencies of shingles, counted here."""
    _, bags = vectors(rows)
    df = Counter(s for bag in bags for s in bag)
    return lambda shingle: np.log1p(len(rows) / df[shingle])


@pytest.mark.parametrize("chunk", [neardup.CHUNK_ROWS, 7])
def test_exact_frequencies(spark, monkeypatch, chunk):
    """The frequencies of every text and the classes, by plain counts; few large or many small chunks."""
    monkeypatch.setattr(neardup, "CHUNK_ROWS", chunk)
    rows = edge_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    signed, n = neardup.signatures(neardup.with_row_key(frame))
    listed, bags = vectors(rows)
    df = Counter(s for bag in bags for s in bag)
    texts, found = {i: t for i, t in rows if i is not None}, signed.collect()
    assert n == len(rows) and len(found) == sum(i is not None and bool(w) for (i, _), w in zip(rows, listed))
    for r in found:
        bag = Counter({s: 1 for s in vectors([(0, texts[r["doc_id"]])])[1][0]})
        assert sorted(neardup._numbers(r["df"], np.int64).tolist()) == sorted(df[s] for s in bag)
    assert classes(frame) == brute_classes(rows, counted_idf(rows))


def test_many_shingles_do_not_share_counts(spark):
    """Two texts share a common passage and have one rare shingle each; six million other shingles do not change their weights."""
    F = neardup.F
    passage = " ".join(f"p{i}" for i in range(54))
    rare = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(30_000)), lambda i: F.concat_ws("x", "id", i)), " ")
    filler = spark.range(200).repartition(8).select("id", F.concat(F.lit(passage + " "), rare).alias("text"))
    pair = spark.createDataFrame([(1000, passage + " one"), (1001, passage + " two")], "id long, text string")
    frame = filler.unionByName(pair).withColumnRenamed("id", "doc_id")
    # 50 shingles in all 202 texts and one in one: 50 ln 2 / (50 ln 2 + 2 ln 203) = 0.77.
    assert {d: c for d, c in classes(frame) if d >= 1000} == {1000: 1000, 1001: 1001}


def test_table_under_plain_counts(spark):
    """All pairs of the table under frequencies that are counted here."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert classes(docs) == brute_classes(rows, counted_idf(rows))


def apart_rows():
    """A family of near copies, and texts with a few words more of their own that can be linked to none of these."""
    base = [f"b{i}" for i in range(200)]
    near = [(i, " ".join(base[:199] + [f"n{i}"])) for i in range(12)]
    far = [(100 + i, " ".join(base[:192] + [f"o{i}x{k}" for k in range(8)])) for i in range(40)]
    return near + far


def test_pairs_ruled_out_by_weight_leave_the_bucket_join(spark, monkeypatch):
    """Only pairs that may be linked come out of the join on buckets, and each is compared."""
    F, rows, met = neardup.F, apart_rows(), []
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = dict(brute_classes(rows, counted_idf(rows)))
    signed, n = neardup.signatures(neardup.with_row_key(frame))
    signed = signed.withColumnRenamed("doc_id", "node").withColumn("copies", F.lit(1)).localCheckpoint()
    nodes = neardup.with_shareable(signed).select("node", "share", "weight")
    members = nodes.select(F.lit(7).cast("long").alias("bucket"), "node")
    cut = neardup.cut
    monkeypatch.setattr(neardup, "cut", lambda df, name: (met.append(df.count()) if name == "met-pairs" else None, cut(df, name))[1])
    monkeypatch.setattr(neardup, "KEPT", 300, raising=False)  # texts are dropped and made again
    got = {r["node"]: r["class"] for r in neardup._links(members, signed.select("node", "packed", "df"), nodes, n).collect()}
    assert got == want and len(set(want.values())) > 1
    facts = {r["node"]: (r["share"], r["weight"]) for r in nodes.collect()}

    def may_link(x, y):
        shared = min(facts[x][0], facts[y][0])
        return shared / (facts[x][1] + facts[y][1] - shared) >= neardup.SIMILARITY - 1e-6

    ids = [i for i, _ in rows]
    assert sum(met) <= sum(may_link(x, y) for x in ids for y in ids if x < y)


def test_small_merges_take_few_tasks(spark, monkeypatch):
    """Each task stays in the driver's memory; a table of some links once took one per shuffle partition."""
    files, cut = [], neardup.cut

    def counted(df, name):
        made = cut(df, name)
        files.append((name, len(made.inputFiles())))
        return made

    monkeypatch.setattr(neardup, "cut", counted)
    settings = {"spark.sql.shuffle.partitions": "31", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    nodes = spark.range(301).selectExpr("id as node", "id as class").coalesce(2)
    links = spark.range(1, 301).selectExpr("0L as a", "id as b").coalesce(2)
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        made = neardup.merged(nodes, links)
        assert max(n for _, n in files) <= spark.sparkContext.defaultParallelism, files
        # Links that are too many to be broadcast are joined by a shuffle.
        monkeypatch.setattr(neardup, "FEW_LINKS", 0)
        assert {r["class"] for r in made.collect()} == {0} and sorted(neardup.merged(nodes, links).collect()) == sorted(made.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
