"""Exact top-k search with BM25 over a sharded inverted index.

``build_index`` turns documents into pieces where they are read: a piece is one row with the
compressed posting lists of a few documents, small enough to pass through the JVM like any row.  A
task that searches joins its pieces into shards, closed at a bound of postings or documents, and
holds one shard at a time.  Queries come in blocks of bounded size.  For a block, one pass over the
pieces sums document frequencies, so all shards score with global statistics; a second pass searches
each shard with block-max WAND and keeps k hits per query and task, which are merged exactly.

In a shard, the part of the terms that are frequent there comes from one matrix product for many
queries.  Rare terms are taken by falling upper bound: once the bounds of the terms not yet
taken cannot lift a document that no earlier term has opened over the k-th best score so far,
no new candidates are opened (the pivot condition).  Blocks of 64 documents whose maximum is out of
reach are then skipped, and the other terms are looked up for what is left, which shrinks term
by term.  The first k-th best score comes from one shard, so that pruning works everywhere.

Defined cases: words are runs of characters other than white space, unchanged; a document's
score sums over the distinct words of the query; null and empty texts count in the statistics
and match nothing; ranks follow the score rounded to 6 decimals, then the id; rows with equal
ids are documents and queries of their own; a null id counts in the statistics and is never
returned; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

K1, B = 1.2, 0.75
SHARD_POSTINGS, SHARD_DOCS = 2_000_000, 16_384
#: Postings of one row of the index, about, and rows of one row group: what the JVM reads and writes at a time.
PIECE_POSTINGS, GROUP_ROWS = 262_144, 4
BLOCK_DOCS = 64
#: Words of the queries that one block holds, about, and queries; a block passes through the driver.
BLOCK_WORDS, BLOCK_QUERIES = 8_000_000, 32_768
INDEX = "n_docs int, n_words long, n_postings int, piece binary"
#: Arrays of a piece or shard, in the order they are packed; ``sizes`` are of the lists, ``docs`` places in ``ids``.
ARRAYS = {"terms": np.int64, "ids": np.int64, "lengths": np.int64, "sizes": np.int32, "docs": np.int32, "tfs": np.int32}
#: Queries whose frequent terms are scored in one product, and cells of its matrix of terms and documents at most.
QUERIES_AT_ONCE, DENSE_CELLS = 128, 8_000_000
_NO_ID = np.iinfo(np.int64).min
_SLACK = 1e-5


def term_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _pack(terms: list[np.ndarray], tfs: list[np.ndarray], ids: list[int], lengths: list[int]) -> pa.RecordBatch:
    """One row of the index."""
    docs = np.repeat(np.arange(len(terms), dtype=np.int32), [len(t) for t in terms])
    flat = np.concatenate(terms)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
    arrays = {
        # Steps between sorted hashes are smaller than the hashes.
        "terms": np.diff(flat[first].view(np.uint64), prepend=np.uint64(0)).view(np.int64),
        "ids": ids,
        "lengths": lengths,
        "sizes": np.diff(np.append(first, len(flat))),
        "docs": docs[order],
        "tfs": np.concatenate(tfs)[order],
    }
    # Equal bytes of all numbers stand together, as most of them are zero.
    planes = (np.asarray(arrays[name], kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes() for name, kind in ARRAYS.items())
    blob = b"".join([np.array([len(first), len(ids), len(flat)], np.int64).tobytes(), *planes])
    row = [len(ids)], [sum(lengths)], [len(flat)], [zstandard.compress(blob)]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["n_docs", "n_words", "n_postings", "piece"])


def _unpack(piece: pa.Buffer | bytes) -> dict[str, np.ndarray]:
    blob = zstandard.decompress(piece)
    n_terms, n_docs, n_postings = np.frombuffer(blob, np.int64, 3).tolist()
    counts = {"terms": n_terms, "ids": n_docs, "lengths": n_docs, "sizes": n_terms, "docs": n_postings, "tfs": n_postings}
    arrays, at = {}, 24
    for name, kind in ARRAYS.items():
        n, width = counts[name], np.dtype(kind).itemsize
        planes = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n)
        arrays[name] = planes.T.copy().reshape(-1).view(kind)
        at += n * width
    arrays["terms"] = np.cumsum(arrays["terms"].view(np.uint64), dtype=np.uint64).view(np.int64)
    return arrays


def _joined(packed: list[pa.Buffer | bytes]) -> dict[str, np.ndarray]:
    """The pieces' documents, one behind the other, as one shard."""
    pieces = [_unpack(p) for p in packed]
    behind = 0
    for p in pieces:
        p["docs"] += np.int32(behind)
        behind += len(p["ids"])
    out = {name: np.concatenate([p.pop(name) for p in pieces]) for name in ARRAYS}
    # Lists of one term become one list, in the order of the pieces; its documents stay sorted.
    order = np.argsort(out["terms"], kind="stable")
    terms, sizes = out["terms"][order], out["sizes"][order].astype(np.int64)
    ends, starts = np.cumsum(sizes), (np.cumsum(out["sizes"], dtype=np.int64) - out["sizes"])[order]
    place = np.arange(len(out["docs"]))
    place += np.repeat(starts - ends + sizes, sizes)
    for name in ("docs", "tfs"):
        out[name] = out[name][place]
    first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
    return out | {"terms": terms[first], "sizes": np.add.reduceat(sizes, first) if len(first) else sizes}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Buffer]]:
    for batch in batches:
        for n_docs, n_postings, piece in zip(*batch.columns, strict=True):
            yield n_docs.as_py(), n_postings.as_py(), piece.as_buffer()


def _shards(rows: Iterable[tuple[int, int, pa.Buffer | bytes]], max_postings: int, max_docs: int) -> Iterator[dict[str, np.ndarray]]:
    """The shards of a task, from rows of ``n_docs, n_postings, piece``."""
    pieces, docs, postings = [], 0, 0
    for n_docs, n_postings, piece in rows:
        if pieces and (docs + n_docs > max_docs or postings + n_postings > max_postings):
            yield _joined(pieces)
            pieces, docs, postings = [], 0, 0
        pieces.append(piece)
        docs, postings = docs + n_docs, postings + n_postings
    if pieces:
        yield _joined(pieces)


def build_index(docs: DataFrame) -> DataFrame:
    """The pieces of the index of ``docs(doc_id, text)``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, tfs, ids, lengths, postings = [], [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    counts = Counter(words)
                    terms.append(term_hashes(list(counts)))
                    tfs.append(np.fromiter(counts.values(), np.int32, len(counts)))
                    ids.append(_NO_ID if doc_id is None else doc_id)
                    lengths.append(len(words))
                    postings += len(counts)
                    if postings >= PIECE_POSTINGS or len(ids) >= SHARD_DOCS:
                        yield _pack(terms, tfs, ids, lengths)
                        terms, tfs, ids, lengths, postings = [], [], [], [], 0
        if ids:
            yield _pack(terms, tfs, ids, lengths)

    return docs.select("doc_id", "text").mapInArrow(run, INDEX)


class Shard:
    """One shard with its impacts under global statistics, ready to search for a block of queries.

    Frequent terms, in over a sixteenth of the documents, are also laid out as rows over
    documents, as many as a bounded matrix holds, so that their part of the scores of many
    queries is one matrix product.
    """

    def __init__(self, arrays: dict[str, np.ndarray], mean_length: float, vocabulary: np.ndarray, weights: np.ndarray):
        terms, self.sizes = arrays["terms"], arrays["sizes"]
        self.docs, self.ids, self.weights = arrays["docs"], arrays["ids"], weights
        self.starts = np.append(0, np.cumsum(self.sizes))
        norm = K1 * (1 - B + B * arrays["lengths"] / (mean_length or 1.0))
        below = norm[self.docs]
        below += arrays["tfs"]
        self.impacts = arrays["tfs"] * (K1 + 1)
        self.impacts /= below
        self.peaks = np.maximum.reduceat(self.impacts, self.starts[:-1]) if len(below) else below
        frequent = np.flatnonzero(self.sizes > len(self.ids) / 16)
        frequent = np.sort(frequent[np.argsort(-self.sizes[frequent], kind="stable")[: DENSE_CELLS // len(self.ids)]])
        self.row = np.full(len(terms), -1)
        self.row[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), len(self.ids)))
        for i, t in enumerate(frequent):
            own = slice(self.starts[t], self.starts[t + 1])
            self.dense[i, self.docs[own]] = self.impacts[own]
        self.edges = np.arange(0, len(self.ids), BLOCK_DOCS)
        # Where the vocabulary of the queries is in this shard.
        self.at = np.searchsorted(terms, vocabulary)
        self.at[self.at == len(terms)] = 0
        self.at[(terms[self.at] != vocabulary) if len(terms) else slice(None)] = -1

    def search(self, queries: list[np.ndarray], k: int, floors: list[float]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query (places in the vocabulary) what can be among the k best, given the k-th best so far."""
        known = [q[self.at[q] >= 0] for q in queries]
        weights = np.zeros((len(queries), len(self.dense)))
        for i, q in enumerate(known):
            rows = self.row[self.at[q]]
            weights[i, rows[rows >= 0]] = self.weights[q[rows >= 0]]
        frequent = weights @ self.dense
        return [self._one(q, frequent[i], floors[i]) for i, q in enumerate(known)]

    def _one(self, query: np.ndarray, scores: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """``scores`` hold the part of the frequent terms; rare ones are added as far as needed."""
        least = max(floor - _SLACK, 0.0)
        rare = query[self.row[self.at[query]] < 0]
        at, weights = self.at[rare], self.weights[rare]
        bounds = weights * self.peaks[at]
        order = np.argsort(-bounds, kind="stable")
        at, weights, bounds = at[order], weights[order], bounds[order]
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0.0)
        # The pivot: later terms cannot lift a document that no earlier term has opened.
        done = min(int(np.searchsorted(-(rest + scores.max(initial=0.0)), -least)), len(at))
        sizes = self.sizes[at[:done]]
        place = np.repeat(self.starts[at[:done]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        scores = scores + np.bincount(self.docs[place], self.impacts[place] * np.repeat(weights[:done], sizes), len(scores))
        # Blocks whose maximum is out of reach are skipped as a whole.
        live = np.flatnonzero(np.maximum.reduceat(scores, self.edges) + rest[done] > least)
        found = (live[:, None] * BLOCK_DOCS + np.arange(BLOCK_DOCS)).ravel()
        found = found[found < len(scores)]
        found = found[scores[found] + rest[done] > least]
        total = scores[found]
        for j in range(done, len(at)):
            reach = total + rest[j] > least
            found, total = found[reach], total[reach]
            if not len(found):
                break
            own = slice(self.starts[at[j]], self.starts[at[j] + 1])
            where = np.minimum(np.searchsorted(self.docs[own], found), self.sizes[at[j]] - 1)
            total = total + weights[j] * self.impacts[own][where] * (self.docs[own][where] == found)
        keep = (total > 0) & (self.ids[found] != _NO_ID)
        return self.ids[found[keep]], np.round(total[keep], 6)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search(index: DataFrame, queries: DataFrame, k: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``query_id``, ``rank``, ``doc_id``, ``score``: the k best of the index for each row of ``queries(query_id, text)``.

    ``index`` is a stored table.
    """
    spark = index.sparkSession
    n_docs, words = index.agg(F.sum("n_docs"), F.sum("n_words")).first()
    n_docs, mean_length = n_docs or 0, (words or 0) / max(1, n_docs or 0)
    # Each block reads them again.
    asked = cut(queries.select("query_id", "text").where(F.col("query_id").isNotNull() & F.col("text").isNotNull()), "bm25-queries")
    asked_words, n_asked = asked.agg(F.sum(F.length("text")), F.count("*")).first()
    n_blocks = 1 + max((asked_words or 0) // (6 * block_words), n_asked // BLOCK_QUERIES)
    results = [
        _search_block(index, asked.where(F.pmod(F.xxhash64("query_id", "text"), F.lit(n_blocks)) == block), block, k, n_docs, mean_length)
        for block in range(n_blocks)
    ]
    hits = reduce(DataFrame.unionByName, [r for r in results if r is not None] or [spark.createDataFrame([], "block int, query int, query_id long, doc_id long, score double")])
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("block", "query").orderBy(F.desc("score"), "doc_id")).cast("long"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _search_block(index: DataFrame, block: DataFrame, number: int, k: int, n_docs: int, mean_length: float) -> DataFrame | None:
    spark = index.sparkSession

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [np.sort(term_hashes(list(set(t.encode().split())))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.int64()))], names=["query_id", "terms"])

    table = block.mapInArrow(words, "query_id long, terms array<long>").toArrow()
    if not table.num_rows:
        return None
    listed = table.column("terms").combine_chunks()
    offsets = listed.offsets.to_numpy().astype(np.int64)
    vocabulary, flat = np.unique(listed.values.to_numpy()[offsets[0] : offsets[-1]], return_inverse=True)
    if not len(vocabulary):
        return None
    offsets -= offsets[0]
    query_ids = table.column("query_id").to_numpy()
    flat = flat.astype(np.int32)
    shared_vocabulary = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = shared_vocabulary.value, np.zeros(len(shared_vocabulary.value), np.int64)
        for batch in batches:
            for piece in batch.column(0):
                arrays = _unpack(piece.as_buffer())
                at = np.minimum(np.searchsorted(wanted, arrays["terms"]), len(wanted) - 1)
                known = wanted[at] == arrays["terms"]
                total[at[known]] += arrays["sizes"][known]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "df"])

    counted = index.select("piece").mapInArrow(frequencies, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).toArrow()
    shared_vocabulary.destroy()
    df = np.zeros(len(vocabulary))
    df[counted.column("at").to_numpy()] = counted.column("df").to_numpy()
    weights = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    shared = spark.sparkContext.broadcast((vocabulary, weights, flat, offsets, query_ids))

    # A k-th best score per query from one shard, whose size is bounded; queries are spread over tasks.
    rows, max_postings, max_docs = index.select("n_docs", "n_postings", "piece"), SHARD_POSTINGS, SHARD_DOCS
    sample = rows.take(-(-max_postings // PIECE_POSTINGS))
    if not sample:
        return None
    shared_sample = spark.sparkContext.broadcast([(r["n_docs"], r["n_postings"], bytes(r["piece"])) for r in sample])

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights, flat, offsets, _ = shared.value
        shard = Shard(next(_shards(shared_sample.value, max_postings, max_docs)), mean_length, vocabulary, weights)
        for batch in batches:
            asked, floors = batch.column(0).to_pylist(), []
            for at in range(0, len(asked), QUERIES_AT_ONCE):
                part = [flat[offsets[q] : offsets[q + 1]] for q in asked[at : at + QUERIES_AT_ONCE]]
                for hit in shard.search(part, k, [0.0] * len(part)):
                    _, scores = best(*hit, k)
                    floors.append(float(scores[-1]) if len(scores) == k else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(floors, pa.float64())], names=["query", "floor"])

    started = spark.range(0, len(query_ids), 1, spark.sparkContext.defaultParallelism).withColumnRenamed("id", "query")
    at_least = started.mapInArrow(lowest, "query long, floor double").toArrow().sort_by("query").column("floor").to_numpy()
    shared_sample.destroy()
    shared_floors = spark.sparkContext.broadcast(at_least)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights, flat, offsets, query_ids = shared.value
        floors, n = shared_floors.value, len(query_ids)
        ids, scores, have = np.zeros((n, k), np.int64), np.zeros((n, k)), np.zeros(n, np.int64)
        for arrays in _shards(_rows(batches), max_postings, max_docs):
            shard = Shard(arrays, mean_length, vocabulary, weights)
            for at in range(0, n, QUERIES_AT_ONCE):
                some = range(at, min(at + QUERIES_AT_ONCE, n))
                part = [flat[offsets[q] : offsets[q + 1]] for q in some]
                least = [max(floors[q], scores[q, -1] if have[q] == k else 0.0) for q in some]
                for q, more in zip(some, shard.search(part, k, least), strict=True):
                    if len(more[0]):
                        kept = best(np.append(ids[q, : have[q]], more[0]), np.append(scores[q, : have[q]], more[1]), k)
                        have[q] = len(kept[0])
                        ids[q, : have[q]], scores[q, : have[q]] = kept
        filled = np.arange(k) < have[:, None]
        at = np.repeat(np.arange(n, dtype=np.int32), have)
        columns = [np.full(len(at), number, np.int32), at, query_ids[at], ids[filled], scores[filled]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "query", "query_id", "doc_id", "score"])

    return rows.mapInArrow(hits, "block int, query int, query_id long, doc_id long, score double")


def search_documents(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of ``docs`` for each row of ``queries(doc_id, text)``."""
    index = cut(build_index(docs), "bm25-index", **{"parquet.block.row.count.limit": GROUP_ROWS})
    return search(index, queries.select(F.col("doc_id").alias("query_id"), "text"), k)
