"""Near-duplicate detection by improved consistent weighted sampling.

A text is a multiset of five-word shingles, weighted by count times inverse document
frequency.  Frequencies are exact: chunks of texts send the sorted 64-bit hashes of their shingles
to parts of the hash range, and each part answers a chunk with the counts of those that occur in two or more
documents; the others occur in one.  120 consistent samples per text, in 20 bands of 6, make texts of weighted
Jaccard similarity 0.8 share a band with probability 0.998, and texts that only share a passage
hardly ever; candidates are verified by their exact weighted similarity.

Texts with equal words form one node.  A shingle that no other node has cannot be shared, so a node
whose own shingles outweigh the rest has no link at all and takes no part (see ``linkable``); for two
others the weights that they can share bound their similarity.  Within a band's bucket not all pairs
are compared: leaders are compared with the members of other classes; members that are not similar
to any choose the next leaders, eight times as many as before, until every member is a leader or linked
to one, or the bucket is one class.  A few bands go first: they join most classes, and buckets of one class
are done.  Two members that are linked to leaders of different classes are then compared
unless the distances to their leaders rule a link out (see ``bridges``), so every pair that shares a bucket is
compared, of one class, or known to be too far apart.  Classes are the connected components of all verified links.

Defined cases: texts of one to four words are one shingle; null texts and texts without words are
classes of their own; rows with a null ``doc_id`` have a null class; rows equal in id and text are
one document; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ROWS_PER_TASK, cut, release
from .common import map_slices, mix, unpacked, with_row_key

SHINGLE, SIMILARITY = 5, 0.8
#: Share of its weight that a node must have in common with others to be linked to any, with room for rounding.
LEAST_SHARE = SIMILARITY - 1e-9
#: Distance of linked texts, with room for rounding.
NEAR = 1 - SIMILARITY + 1e-12
BANDS, ROWS = 20, 6
#: Bands that are joined before the others.
FIRST_BANDS = 4
#: Shingles that are sampled at a time.
SAMPLED = 1 << 18
#: Shingles of compared texts that a task keeps, as texts of one bucket meet again and again.
KEPT = 1 << 20
#: Rows of a table of links or hooks that is broadcast at most, by its count.
FEW_LINKS = 100_000
#: log2 of the size of a table of weights by the first bits of a hash (``Shingles.weights``).
DF_BITS = 18
#: Documents and bytes of text of a chunk at most (a longer text is one by itself), and bytes of text for each part of the hash range.
CHUNK_ROWS, CHUNK_BYTES, PART_BYTES = 2048, 8 << 20, 8 << 20


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of ``n`` equal shares."""
    x = np.logspace(-5, 1.7, 400_000)
    return np.interp((np.arange(n) + 0.5) / n, 1 - np.exp(-x) * (1 + x), x)


class Shingles:
    """Distinct shingles of some texts with their counts, in the order (text, shingle)."""

    def __init__(self, texts: list[bytes]):
        listed = [t.split() for t in texts]
        sizes = np.array([len(w) for w in listed], np.int64)
        words = [w for ws in listed for w in ws]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        self.words = [b" ".join(w) for w in listed]
        text = np.repeat(np.arange(len(sizes)), sizes)
        last = np.cumsum(sizes)[text] if len(sizes) else text
        place = np.arange(len(words))
        with np.errstate(over="ignore"):
            rolled = np.zeros(len(words), np.uint64)
            for k in range(SHINGLE):
                inside = place + k < last
                rolled[inside] = rolled[inside] * np.uint64(0x9E3779B97F4A7C15) + hashes[place[inside] + k] + np.uint64(k + 1)
            rolled = mix(rolled)
        # Whole shingles, and for short texts the one that starts with the first word.
        first = last - sizes[text]
        take = (place + SHINGLE <= last) | ((place == first) & (last - first < SHINGLE))
        text, rolled = text[take], rolled[take]
        order = np.lexsort((rolled, text))
        text, rolled = text[order], rolled[order]
        edge = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (rolled[1:] != rolled[:-1])]) if len(text) else np.zeros(0, np.int64)
        self.text, self.shingle = text[edge], rolled[edge]
        self.count = np.diff(np.append(edge, len(text)))

    def buckets(self) -> np.ndarray:
        """What document frequencies are counted by: the 64-bit hash of each shingle."""
        return self.shingle

    def weights(self, idf: np.ndarray) -> np.ndarray:
        """Weights under a table of ``1 << DF_BITS`` numbers by the first bits of the hash."""
        return self.count * idf[(self.shingle >> np.uint64(64 - DF_BITS)).astype(np.int64)]


def document_frequencies(docs: DataFrame) -> tuple[dict[int, int], int]:
    """Documents per shingle, and documents, over all rows of a small table, as one plain count on the driver.

    The operator counts in parts of the hash range instead (see ``signatures``).
    """

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = Shingles([(t or "").encode() for t in batch.column(0).to_pylist()])
            return pa.RecordBatch.from_arrays([pa.array(made.shingle.view(np.int64))], names=["shingle"])

        return each

    counted = map_slices(docs.select("text"), make, "shingle long").groupBy("shingle").count().toArrow()
    hashes = counted.column("shingle").to_numpy().view(np.uint64).tolist()
    return dict(zip(hashes, counted.column("count").to_pylist(), strict=True)), docs.count()


def inverse_frequencies(df: dict[int, int], n: int) -> dict[int, float]:
    return {shingle: float(np.log1p(n / count)) for shingle, count in df.items()}


class Sampler:
    """Consistent weighted samples; the random numbers come from a hash of the shingle."""

    def __init__(self):
        self.r = _gamma_quantiles(1 << 16)
        self.log_c = np.log(_gamma_quantiles(1 << 20))

    def bands(self, made: Shingles, weights: np.ndarray, n_texts: int) -> np.ndarray:
        """Band hashes, one row a text; texts without shingles are zero."""
        out = np.zeros((n_texts, BANDS), np.uint64)
        if not len(made.text):
            return out
        start = np.flatnonzero(np.r_[True, made.text[1:] != made.text[:-1]])
        owner = made.text[start]
        log_w = np.log(weights)
        place = np.arange(len(log_w), dtype=np.uint64)
        low16, low20 = np.uint64(0xFFFF), np.uint64(0xFFFFF)
        with np.errstate(over="ignore"):
            for band in range(BANDS):
                name = np.full(len(start), band + 1, np.uint64)
                for row in range(ROWS):
                    seed = np.uint64((band * ROWS + row + 1) * 0x9E3779B97F4A7C15 % 2**64)
                    u = mix(made.shingle + seed)
                    r = self.r[u & low16]
                    beta = ((u >> np.uint64(16)) & low16) / 65536.0
                    t = np.floor(log_w / r + beta)
                    log_a = self.log_c[(u >> np.uint64(32)) & low20] - r * (t - beta + 1)
                    # Order as unsigned numbers, with the place below; ties go to the lesser shingle.
                    bits = log_a.astype(np.float32).view(np.uint32)
                    bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
                    least = np.minimum.reduceat((bits.astype(np.uint64) << np.uint64(32)) | place, start)
                    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
                    sample = mix(made.shingle[at] + mix(t[at].astype(np.int64).view(np.uint64)))
                    name = mix(name * np.uint64(0xC2B2AE3D27D4EB4F) + sample)
                out[owner, band] = name
        return out


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    return zstandard.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T).tobytes(), 1)


def _numbers(blob: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _part_edges(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of the hashes starts in sorted ``hashes``, and the end."""
    return np.searchsorted((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))


def _chunks(keyed: DataFrame) -> DataFrame:
    """The rows in chunks of compressed texts, written once, as later steps refer to the chunks."""

    def make():
        def each(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out, start, held = [], 0, 0
            for at in range(len(texts) + 1):
                if at == len(texts) or (held and held + len(texts[at]) > CHUNK_BYTES):
                    own = [t.encode() for t in texts[start:at]]
                    rows = [[uuid.uuid4().int >> 65], [len(own)], [sum(map(len, own))]]
                    columns = [pa.array(x, pa.int64()) for x in rows] + [pa.array([batch.column(k).slice(start, at - start).to_pylist()], pa.list_(pa.int64())) for k in (0, 2)]
                    columns.append(pa.array([[zstandard.compress(t, 1) for t in own]], pa.list_(pa.binary())))
                    out.append(pa.RecordBatch.from_arrays(columns, names=["chunk", "n_rows", "n_bytes", "doc_ids", "row_keys", "packed"]))
                    start, held = at, 0
                if at < len(texts):
                    held += len(texts[at])
            return out

        return each

    rows = keyed.select("doc_id", "text", "row_key")
    schema = "chunk long, n_rows long, n_bytes long, doc_ids array<long>, row_keys array<long>, packed array<binary>"
    return cut(map_slices(rows, make, schema, CHUNK_ROWS), "near-chunks")


def _shared_counts(chunks: DataFrame, parts: int) -> DataFrame:
    """``chunk`` and ``answers(part, places, counts)``: exact document counts of two or more."""

    def make():
        def each(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
            out = []
            for chunk, blobs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes, counts = np.unique(Shingles([unpacked(x) for x in blobs]).shingle, return_counts=True)
                edges = _part_edges(hashes, parts)
                filled = [p for p in range(parts) if edges[p] < edges[p + 1]]
                sent = [(slice(edges[p], edges[p + 1])) for p in filled]
                columns = [
                    pa.array(filled, pa.int32()),
                    pa.array([chunk] * len(filled), pa.int64()),
                    pa.array([_squeezed(np.diff(hashes[x], prepend=np.uint64(0))) for x in sent], pa.binary()),
                    pa.array([_squeezed(counts[x].astype(np.uint32)) for x in sent], pa.binary()),
                ]
                out.append(pa.RecordBatch.from_arrays(columns, names=["part", "chunk", "hashes", "counts"]))
            return out

        return each

    def answer(table: pa.Table) -> pa.Table:
        hashes = [np.cumsum(_numbers(x, np.uint64), dtype=np.uint64) for x in table.column("hashes").to_pylist()]
        known, place = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.concatenate([_numbers(x, np.uint32) for x in table.column("counts").to_pylist()])
        df = np.bincount(place, counts, len(known)).astype(np.int64)[place]
        places, found = [], []
        for own in np.split(df, np.cumsum([len(x) for x in hashes])[:-1]):
            at = np.flatnonzero(own > 1)
            places.append(_squeezed(at.astype(np.uint32)))
            found.append(_squeezed(own[at]))
        return pa.table({"part": table.column("part"), "chunk": table.column("chunk"), "places": pa.array(places, pa.binary()), "counts": pa.array(found, pa.binary())})

    sent = map_slices(chunks.select("chunk", "packed"), make, "part int, chunk long, hashes binary, counts binary", 1)
    answers = sent.groupBy("part").applyInArrow(answer, "part int, chunk long, places binary, counts binary")
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("part", "places", "counts")).alias("answers"))


def _pieces_of(texts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of texts with a bounded number of shingles together, or one text each."""
    sizes, low, held = ends[texts + 1] - ends[texts], 0, 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + size > SAMPLED:
            yield texts[low:k]
            low, held = k, 0
        held += size
    if low < len(texts):
        yield texts[low:]


def signatures(keyed: DataFrame) -> tuple[DataFrame, int]:
    """``doc_id``, ``row_key``, node ``t0``/``t1`` (hashes of the words), bands, ``packed`` text and exact document frequencies
    ``df`` of its sorted shingles, the least of these with the weight of its shingles, and the whole weight, for rows
    with words and an id; and the number of documents."""
    chunks = _chunks(keyed)
    shape = chunks.agg(F.sum("n_rows"), F.sum("n_bytes")).first()
    n, parts = shape[0] or 0, max(16, -(-(shape[1] or 0) // PART_BYTES))
    joined = chunks.join(_shared_counts(chunks, parts), "chunk", "left").select("doc_ids", "row_keys", "packed", "answers")

    def make():
        sampler = Sampler()

        def each(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
            out = []
            for doc_ids, row_keys, blobs, answers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                texts = [unpacked(x) for x in blobs]
                made = Shingles(texts)
                hashes, place = np.unique(made.shingle, return_inverse=True)
                df, edges = np.ones(len(hashes), np.int64), _part_edges(hashes, parts)
                for x in answers or []:
                    df[edges[x["part"]] + _numbers(x["places"], np.uint32).astype(np.int64)] = _numbers(x["counts"], np.int64)
                own = df[place]
                weights = exact_weights(made, own, n)
                rarest, own_weight, weight = weight_sums(made, own, weights, len(texts))
                # A text that is nobody's copy and can share too little needs no samples.
                alone = (rarest == 1) & (weight - own_weight < weight * LEAST_SHARE)
                bands = np.zeros((len(texts), BANDS), np.uint64)
                ends = np.searchsorted(made.text, np.arange(len(texts) + 1))
                for some in _pieces_of(np.flatnonzero(~alone), ends):
                    at = np.concatenate([np.arange(ends[k], ends[k + 1]) for k in some])
                    sampled = SimpleNamespace(text=made.text[at], shingle=made.shingle[at])
                    bands[some] = sampler.bands(sampled, weights[at], len(texts))[some]
                names = [xxhash.xxh128_intdigest(w) for w in made.words]
                columns = [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(row_keys, pa.int64()),
                    pa.array(np.array([x >> 64 for x in names], np.uint64).view(np.int64)),
                    pa.array(np.array([x & (2**64 - 1) for x in names], np.uint64).view(np.int64)),
                    pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())),
                    pa.array(blobs, pa.binary()),
                    pa.array([_squeezed(own[i:j]) if i < j else b"" for i, j in zip(ends, ends[1:])], pa.binary()),
                    pa.array(rarest, pa.int64()),
                    pa.array(own_weight, pa.float64()),
                    pa.array(weight, pa.float64()),
                ]
                keep = pa.array([bool(w) and i is not None for w, i in zip(made.words, doc_ids, strict=True)])
                names = ["doc_id", "row_key", "t0", "t1", "bands", "packed", "df", "rarest", "rarest_weight", "weight"]
                out.append(pa.RecordBatch.from_arrays(columns, names=names).filter(keep))
            return out

        return each

    schema = """doc_id long, row_key long, t0 long, t1 long, bands array<long>, packed binary, df binary,
        rarest long, rarest_weight double, weight double"""
    return map_slices(joined, make, schema, 1), n


def exact_weights(made: Shingles, df: np.ndarray, n: int) -> np.ndarray:
    """Weights of the shingles of ``made``, which occur in ``df`` of ``n`` documents."""
    return made.count * np.log1p(n / df)


def weight_sums(made: Shingles, df: np.ndarray, weights: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the least frequency of a shingle, the weight of its shingles with that frequency, and of all."""
    rarest = np.full(n_texts, np.iinfo(np.int64).max)
    np.minimum.at(rarest, made.text, df)
    rare = df == rarest[made.text]
    return (
        rarest,
        np.bincount(made.text[rare], weights=weights[rare], minlength=n_texts),
        np.bincount(made.text, weights=weights, minlength=n_texts),
    )


def with_shareable(nodes: DataFrame) -> DataFrame:
    """Add ``share``, the weight of the shingles of a node that another node can have.

    A shingle that occurs in as many documents as the node has copies is the node's own.
    """
    return nodes.withColumn("share", F.col("weight") - F.when(F.col("rarest") <= F.col("copies"), F.col("rarest_weight")).otherwise(0.0))


def linkable(share: str = "share", weight: str = "weight") -> Column:
    """Whether anything can be similar to a node: what is shared of its weight bounds the similarity."""
    return F.col(share) >= F.col(weight) * LEAST_SHARE


def _least_distance(x: str, y: str) -> Column:
    """What the distance of two nodes (``x_share``, ``x_weight`` and so on) is at least: they share at most either's share."""
    shared = F.least(f"{x}_share", f"{y}_share")
    return 1 - shared / (F.col(f"{x}_weight") + F.col(f"{y}_weight") - shared) - F.lit(1e-9)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Similarity of two (sorted distinct shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


def _verified(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """The pairs ``a``, ``b`` with the distance ``d`` of their texts, one minus the similarity."""
    a, b = (texts.select(F.col("node").alias(k), F.struct("packed", "df").alias(f"text_{k}")) for k in ("a", "b"))
    joined = pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")

    def make():
        kept: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()  # the latest last
        held = 0

        def vector(node: int, text: pa.StructScalar) -> tuple[np.ndarray, np.ndarray]:
            nonlocal held
            if node in kept:
                kept.move_to_end(node)
                return kept[node]
            made = Shingles([unpacked(text["packed"].as_py())])
            kept[node] = found = made.shingle, exact_weights(made, _numbers(text["df"].as_py(), np.int64), n)
            held += len(found[0])
            while held > KEPT and len(kept) > 1:
                held -= len(kept.popitem(last=False)[1][0])
            return found

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            apart = []
            for x, y, text_x, text_y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                apart.append(1 - weighted_jaccard(vector(x, text_x), vector(y, text_y)))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(apart, pa.float64())], names=["a", "b", "d"])

        return each

    return map_slices(joined, make, "a long, b long, d double")


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, made of at most ``rows`` rows, in tasks that their number is worth: each one is driver memory and a file."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK)))


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of at most ``rows`` rows for an inner join or as the right side of a left one: broadcast if it is small."""
    return F.broadcast(df) if rows <= FEW_LINKS else df


def merged(labels: DataFrame, links: DataFrame, rows: int | None = None) -> DataFrame:
    """``labels(node, class)`` after joining the classes that ``links(a, b)``, at most ``rows``, connect.

    The least node names a class.  Classes hook onto lesser neighbours, and chains of hooks are
    shortened, so the number of steps grows with the logarithm of the longest chain.
    """
    rows = links.count() if rows is None else rows
    left = labels.select(F.col("node").alias("a"), F.col("class").alias("x"))
    right = labels.select(F.col("node").alias("b"), F.col("class").alias("y"))
    across = _sent(_sent(links, rows).join(left, "a"), rows).join(right, "b").select("x", "y")
    while True:
        across = across.where("x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
        across = cut(_few(across, rows), "class-links")
        rows = across.count()
        if not rows:
            return cut(labels, "classes")
        hooks = across.groupBy("x").agg(F.min("y").alias("to")).withColumnRenamed("x", "class")
        for _ in range(2):
            onward = hooks.select(F.col("class").alias("to"), F.col("to").alias("next"))
            hooks = hooks.join(_sent(onward, rows), "to", "left").select("class", F.coalesce("next", "to").alias("to"))
        hooks = cut(_few(hooks, rows), "hooks")
        labels = labels.join(_sent(hooks, rows), "class", "left").select("node", F.coalesce("to", "class").alias("class"))
        for end in ("x", "y"):
            onto = hooks.select(F.col("class").alias(end), "to")
            across = across.join(_sent(onto, rows), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node``, ``class``: the least node that each of ``nodes(node)`` is connected with."""
    return merged(nodes.select("node", F.col("node").alias("class")), links)


def _spanning(at: DataFrame) -> DataFrame:
    """Buckets of ``at(bucket, node, class)`` with more than one class."""
    return at.groupBy("bucket").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x != y").select("bucket")


def _named(nodes: DataFrame, side: str) -> DataFrame:
    """``node``, ``share`` and ``weight`` of ``nodes`` under the names that ``_least_distance`` reads."""
    return nodes.select("node", *[F.col(c).alias(f"{side}_{c}") for c in ("share", "weight")])


def _ruled_out(members: DataFrame, labels: DataFrame, leaders: DataFrame, own: DataFrame, nodes: DataFrame) -> DataFrame:
    """``leader``, ``node``, ``d`` for pairs of a bucket that their weights rule out, but not the links of a led member.

    Their least distance ``d`` stands for the distance.  Only leaders that members are linked to are asked for.
    """
    widest = own.groupBy("leader").agg(F.max("d").alias("widest"))
    led = leaders.join(widest, "leader").join(_named(nodes, "leader").withColumnRenamed("node", "leader"), "leader")
    led = led.join(labels.select(F.col("node").alias("leader"), F.col("class").alias("leader_class")), "leader")
    at = members.join(led.select("bucket").distinct(), "bucket", "left_semi").join(labels, "node").join(_named(nodes, "own"), "node")
    least = _least_distance("leader", "own")
    met = at.join(led, "bucket").where((F.col("class") != F.col("leader_class")) & (least > NEAR) & (least <= F.col("widest") + NEAR))
    return met.select("leader", "node", least.alias("d")).groupBy("leader", "node").agg(F.min("d").alias("d"))


def bridges(members: DataFrame, labels: DataFrame, leaders: DataFrame, checked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of linked members of different classes that may be similar and were not compared.

    Every member is a leader of its bucket or linked to one, and a leader was compared with all members
    of other classes that their weights allow to be linked.  One minus the weighted Jaccard similarity is a metric, so members as near as a link lie
    about as far from either one's leader: ``d(leader, other) <= d(leader, own) + NEAR``.
    A pair must hold this seen from both sides; no link is lost.
    """
    active = cut(_spanning(members.join(labels, "node")), "spanning-buckets")
    both = checked.unionByName(checked.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).where(F.col("d") <= 2 * NEAR)
    both = cut(both.select(F.col("a").alias("leader"), F.col("b").alias("node"), "d").distinct(), "judged-both-ways")
    own = leaders.join(active, "bucket", "left_semi").join(both.where(F.col("d") <= NEAR), "leader")
    own = own.join(members, ["bucket", "node"], "left_semi").select("leader", "node", "d").distinct()
    own = cut(own.join(labels, "node"), "led-members")
    others = both.join(own.select("leader").distinct(), "leader", "left_semi")
    if "share" in nodes.columns:
        others = others.unionByName(_ruled_out(members, labels, leaders.join(active, "bucket", "left_semi"), own, nodes))
    others = cut(others.join(labels, "node"), "judged-others")
    others = others.select("leader", F.col("node").alias("other"), F.col("d").alias("reach"), F.col("class").alias("other_class"))
    met = own.join(others, "leader").where((F.col("class") != F.col("other_class")) & (F.col("reach") <= F.col("d") + NEAR))
    seen = met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), (F.col("node") < F.col("other")).alias("up"))
    pairs = seen.groupBy("a", "b").agg(F.min("up").alias("x"), F.max("up").alias("y")).where("x != y").select("a", "b")
    return pairs.join(checked, ["a", "b"], "left_anti")


def _links(members: DataFrame, texts: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Classes of ``members(bucket, node)`` by rounds of leaders, then bridges between the classes of a bucket.

    ``nodes`` has ``node``, and ``share`` and ``weight`` where they are known.  Members may say with ``early`` which
    buckets go first.
    """
    spark = members.sparkSession
    labels = cut(nodes.select("node", F.col("node").alias("class")), "classes")
    checked = spark.createDataFrame([], "a long, b long, d double")  # all pairs compared so far
    led = spark.createDataFrame([], "bucket long, leader long")  # all leaders so far
    weighed = "share" in nodes.columns
    n_members = members.count()
    stages = [members.where("early"), members.where("not early")] if "early" in members.columns else [members]
    for part in stages:
        part = part.select("bucket", "node")
        open_ = part  # neither a leader nor linked to one
        turn = 0
        while True:
            at = part.join(labels, "node")
            open_ = cut(_few(open_.join(_spanning(at), "bucket", "left_semi"), n_members), "open-members")
            n_open = open_.count()
            if not n_open:
                break
            turn += 1
            order = Window.partitionBy("bucket").orderBy(F.xxhash64("node", F.lit(turn)) if turn > 1 else F.col("node"), "node")
            ranked = open_.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 8 ** (turn - 1))
            leaders = cut(_few(ranked.select("bucket", F.col("node").alias("leader")), n_open), "leaders")
            led = led.unionByName(leaders)
            about = [F.col(c).alias(f"leader_{c}") for c in ("share", "weight") if weighed]
            leader_facts = labels.join(nodes, "node").select(F.col("node").alias("leader"), F.col("class").alias("leader_class"), *about)
            with_leaders = leaders.join(leader_facts, "leader")
            apart = F.col("class") != F.col("leader_class")
            if weighed:
                at = at.join(_named(nodes, "own"), "node")
                apart = apart & (_least_distance("leader", "own") <= NEAR)
            met = at.join(with_leaders, "bucket").where(apart)
            met = met.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
            pairs = cut(met.join(checked, ["a", "b"], "left_anti"), "met-pairs")
            judged = cut(_verified(pairs, texts, n), "judged-pairs")
            checked = checked.unionByName(judged)
            links = checked.where(F.col("d") <= NEAR).select("a", "b")
            near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            covered = leaders.join(near, leaders.leader == near.a).select("bucket", F.col("b").alias("node"))
            covered = covered.unionByName(leaders.select("bucket", F.col("leader").alias("node")))
            open_ = open_.join(covered, ["bucket", "node"], "left_anti")
            labels = merged(labels, judged.where(F.col("d") <= NEAR).select("a", "b"), pairs.count())
            release(spark)
    left = cut(bridges(members.select("bucket", "node"), labels, led, checked, nodes), "bridges")
    if weighed:
        for side in ("a", "b"):
            left = left.join(nodes.select(F.col("node").alias(side), F.col("share").alias(f"{side}_share"), F.col("weight").alias(f"{side}_weight")), side)
        left = cut(left.where(_least_distance("a", "b") <= NEAR).select("a", "b"), "weighed-bridges")
    # A first share of the pairs joins most classes that have any link, and the rest of their pairs is spared.
    for share in (16, 1):
        if left.isEmpty():
            break
        across = left.join(labels.select(F.col("node").alias("a"), F.col("class").alias("x")), "a")
        across = across.join(labels.select(F.col("node").alias("b"), F.col("class").alias("y")), "b").where("x != y").select("a", "b")
        picked = F.pmod(F.xxhash64("a", "b"), F.lit(share)) == 0
        judged = cut(_verified(across.where(picked), texts, n), "judged-bridges")
        left = left.join(judged.select("a", "b"), ["a", "b"], "left_anti")
        labels = merged(labels, judged.where(F.col("d") <= NEAR).select("a", "b"))
    return labels


def near_classes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``row_key``, ``class_id`` (the least id of the class), ``kept`` for every row.

    ``kept`` marks the document of each class that stays, the one with the least id.
    """
    keyed = with_row_key(docs)
    signed, n = signatures(keyed)
    # What cannot be linked is not read again.
    compared = (F.col("rarest") > 1) | (F.col("weight") - F.col("rarest_weight") >= F.col("weight") * LEAST_SHARE)
    signed = cut(signed.withColumns({c: F.when(compared, F.col(c)) for c in ("bands", "packed", "df")}), "signatures")
    same = [F.first(c).alias(c) for c in ("bands", "rarest", "rarest_weight", "weight")]
    nodes = signed.groupBy("t0").agg(F.min(F.struct("doc_id", "row_key")).alias("first"), F.count("*").alias("copies"), *same)
    nodes = with_shareable(nodes).select(F.col("t0").alias("node"), "first", "bands", "share", "weight")
    nodes = cut(nodes, "near-nodes")
    banded = nodes.where(linkable()).select("node", F.posexplode("bands"))
    banded = banded.select("node", F.xxhash64("pos", "col").alias("bucket"), (F.col("pos") < FIRST_BANDS).alias("early"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = cut(banded.join(shared, "bucket").select("bucket", "node", "early"), "bucket-members")
    met = cut(nodes.select("node", "share", "weight").join(members.select("node").distinct(), "node", "left_semi"), "candidate-nodes")
    chosen = nodes.join(met, "node", "left_semi").select("node", F.col("first.row_key").alias("row_key")).alias("c")
    carried = signed.select("row_key", F.struct("packed", "df").alias("text")).alias("t")
    texts = carried.join(chosen, F.col("t.row_key") == F.col("c.row_key")).select("c.node", "t.text")
    texts = cut(texts.groupBy("node").agg(F.first("text").alias("text")).select("node", "text.*"), "candidate-texts")
    labels = _links(members, texts, met, n)
    classed = nodes.join(labels, "node", "left").select("node", "first", F.coalesce("class", "node").alias("class"))
    least = classed.groupBy("class").agg(F.min("first").alias("least"))
    by_node = classed.join(least, "class").select(F.col("node").alias("t0"), "least")
    rows = signed.select("doc_id", "row_key", "t0").join(by_node, "t0")
    found = rows.select("doc_id", "row_key", F.col("least.doc_id").alias("class_id"), (F.struct("doc_id", "row_key") == F.col("least")).alias("kept"))
    wordless = keyed.where(F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return found.unionByName(wordless.select("doc_id", "row_key", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, with the columns of ``docs``."""
    name = "_row_key"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    gone = near_classes(docs).where(~F.col("kept")).select(F.col("row_key").alias(name)).distinct()
    key = F.xxhash64(F.col("doc_id"), F.col("text"), F.col("text").isNull())
    return docs.withColumn(name, key).join(gone, name, "left_anti").dropDuplicates([name]).drop(name)
