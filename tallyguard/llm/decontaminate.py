"""Benchmark decontamination with BM25 and block-max WAND.

The inverted index is over the test items, and every passage of every training text is a
query.  Passages are twice as long as the longest item and start one longest item apart, so any stretch
as long as an item lies whole in a passage.  Scores are divided by what an item scores against
itself.  Upper bounds per block of items come from one running sum over a text; only blocks
whose bound passes the threshold are scored, and every item above it is retrieved.  A retrieved
item counts as leaked if the five-word shingles of the item, of its question and of its answer
occur in the passage to the required shares.

Words are compared without regard to case and to punctuation at their edges, in items and passages
alike (``words_of``), so a passage copied in capitals or in quotation marks is found.

The answer of an item is its last sentence, or the last third of its words if it has only one;
the question is the rest.

The index is cut into parts of a fixed number of items, each broadcast on its own, so its size
in memory is bounded however large the benchmark is.

Defined cases: null and empty texts and items match nothing; items of under five words are one
shingle; a null ``doc_id`` is carried through; repeated documents give repeated results, repeated
items one per row; other columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, map_slices
from .search import K1, B

THRESHOLD = 0.5
OVERLAP, PART_OVERLAP = 0.8, 0.5
SHINGLE = 5
PART_ITEMS, BLOCK_ITEMS = 1024, 4
#: Bounds (of words by blocks) that a task holds at a time, and words that it keeps the numbers of.
BOUND_CELLS, MOST_NUMBERS = 1 << 20, 1 << 20
_SENTENCE = re.compile(r"(?<=[.!?])[\x20\x09-\x0D]+")
#: Punctuation that is no part of a word it stands at the edge of.
EDGE = string.punctuation + "\u00a1\u00ab\u00b4\u00b7\u00bb\u00bf\u2010\u2011\u2012\u2013\u2014\u2015\u2018\u2019\u201a\u201c\u201d\u201e\u2026\u2039\u203a\u3001\u3002\u300c\u300d\uff01\uff0c\uff1f"
FOUND = "doc_id long, item_id long, start long, score double, overlap double, question_overlap double, answer_overlap double"


def raw_words(text: str) -> list[bytes]:
    """Words of a text, case folded."""
    return text.casefold().encode().split()


def bare(word: bytes) -> bytes:
    """A word without punctuation at the edges; one of punctuation only stays as it is."""
    return word.decode().strip(EDGE).encode() or word


def words_of(text: str) -> list[bytes]:
    """Words of a text, case folded and without punctuation at the edges."""
    return [bare(w) for w in raw_words(text)]


class Numbers(dict):
    """Numbers of words by their raw forms, each worked out when it is first met."""

    def __init__(self, at: dict[bytes, int]):
        super().__init__()
        self.at, self.unknown = at, len(at)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = self.at.get(bare(word), self.unknown)
        return number


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    size = min(SHINGLE, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    parts = [words_of(p) for p in _SENTENCE.split(text)]
    parts = [p for p in parts if p]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    third = len(words) // 3
    return words[: len(words) - third], words[len(words) - third :]


def _running(rows: np.ndarray) -> np.ndarray:
    """Sums of the rows before each place, and of all."""
    out = np.zeros((len(rows) + 1, rows.shape[1]))
    np.cumsum(rows, axis=0, dtype=np.float64, out=out[1:])
    return out


class ItemIndex:
    """Inverted index of some test items under the statistics of all of them."""

    def __init__(self, items: list[tuple[int, str]], df: dict[bytes, int], n_items: int, mean_length: float):
        self.ids = [i for i, _ in items]
        self.words = [words_of(t) for _, t in items]
        # Parts of under five words are covered by the shingles of the whole item.
        self.parts = [[{s for s in shingles(p) if len(s) == SHINGLE} for p in question_and_answer(t)] for _, t in items]
        self.whole = [shingles(w) for w in self.words]
        self.sizes = {min(SHINGLE, len(w)) for w in self.words} | {SHINGLE}
        self.stride = max((len(w) for w in self.words), default=1)
        self.at = {w: i for i, w in enumerate(sorted({w for words in self.words for w in words}))}
        self.numbers = Numbers(self.at)
        postings: list[list[tuple[int, float]]] = [[] for _ in self.at]
        for j, words in enumerate(self.words):
            counts = Counter(words)
            norm = K1 * (1 - B + B * len(words) / mean_length)
            gains = {w: np.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + norm) for w, tf in counts.items()}
            most = sum(gains.values())
            for w, gain in gains.items():
                postings[self.at[w]].append((j, gain / most))
        n_blocks = -(-len(items) // BLOCK_ITEMS)
        # The last row stands for all words that occur in no item.
        self.bounds = np.zeros((len(self.at) + 1, n_blocks), np.float32)
        rows: list[list[tuple[int, int, float]]] = [[] for _ in range(n_blocks)]
        for w, listed in enumerate(postings):
            for j, gain in listed:
                block = j // BLOCK_ITEMS
                self.bounds[w, block] = max(self.bounds[w, block], gain)
                rows[block].append((w, j % BLOCK_ITEMS, gain))
        self.blocks = []
        for listed in rows:
            terms = np.unique([w for w, _, _ in listed])
            impacts = np.zeros((len(terms) + 1, BLOCK_ITEMS))
            for w, j, gain in listed:
                impacts[np.searchsorted(terms, w), j] = gain
            self.blocks.append((terms, impacts))

    def passages(self, texts: list[str | None]) -> Iterator[tuple[int, int, list[bytes], np.ndarray, np.ndarray]]:
        """(text, start, raw words, known terms, bounds) of each passage with a bound at or above the threshold.

        All passages of a few texts are bounded at once, ``BOUND_CELLS`` cells at a time.
        """
        raw = [raw_words(t or "") for t in texts]
        sizes = np.array([len(r) for r in raw], np.int64)
        if not self.ids or not sizes.sum():
            return
        if len(self.numbers) > MOST_NUMBERS:
            self.numbers.clear()
        ids = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(raw)), np.int64, int(sizes.sum()))
        known = np.flatnonzero(ids < len(self.at))
        terms = ids[known]
        first = np.cumsum(sizes) - sizes
        # A word counts once in a passage, which is two cells of one stride: in its first cell if it did not
        # occur before in that cell, in its second one if it occurred in neither.
        order = np.argsort(terms, kind="stable")
        again = np.flatnonzero(terms[order][1:] == terms[order][:-1])
        before = np.full(len(known), -1)
        before[order[again + 1]] = known[order[again]]
        cell = known - (known - first[np.repeat(np.arange(len(raw)), sizes)[known]]) % self.stride
        fresh, fresh_pair = before < cell, before < cell - self.stride

        counts = np.where(sizes > 0, -(-np.maximum(1, sizes - self.stride) // self.stride), 0)
        owner = np.repeat(np.arange(len(raw)), counts)
        starts = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * self.stride
        begin, stops = first[owner] + starts, first[owner] + sizes[owner]
        low, middle, high = (
            np.searchsorted(known, np.minimum(begin + n * self.stride, stops)) for n in range(3)
        )
        width, at = self.bounds.shape[1], 0
        while at < len(owner):
            stop = max(at + 1, int(np.searchsorted(high, low[at] + BOUND_CELLS // width, side="right")))
            span = slice(low[at], high[stop - 1])
            gains = self.bounds[terms[span]]
            in_first, in_second = (_running(gains * mask[span, None]) for mask in (fresh, fresh_pair))
            x, y, z = (edge[at:stop] - low[at] for edge in (low, middle, high))
            bounds = in_first[y] - in_first[x] + in_second[z] - in_second[y]
            for p in np.flatnonzero(bounds.max(1) >= THRESHOLD - 1e-6):
                n, start = owner[at + p], int(starts[at + p])
                yield n, start, raw[n][start : start + 2 * self.stride], np.unique(terms[low[at + p] : high[at + p]]), bounds[p]
            at = stop

    def retrieve(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, float, list[bytes]]]:
        """(text, item, start, score, raw words) of each passage and item at or above the threshold."""
        for n, start, words, terms, bounds in self.passages(texts):
            for block in np.flatnonzero(bounds >= THRESHOLD - 1e-6):
                own, impacts = self.blocks[block]
                at = np.searchsorted(own, terms)
                at[at == len(own)] = 0
                scores = impacts[at[own[at] == terms]].sum(0)
                for j in np.flatnonzero(scores >= THRESHOLD):
                    yield n, block * BLOCK_ITEMS + int(j), start, float(scores[j]), words

    def leaks(self, texts: list[str | None]) -> list[list[tuple[int, int, float, float, float, float]]]:
        """Per text (item id, start, score, overlaps) of the items that it holds, by its best passage."""
        best: list[dict[int, tuple]] = [{} for _ in texts]
        last, have = None, set()
        for n, item, start, score, passage in self.retrieve(texts):
            if (n, start) != last:
                last, passage = (n, start), [bare(w) for w in passage]
                have = {tuple(passage[i : i + k]) for k in self.sizes for i in range(len(passage) - k + 1)}
            share = [len(s & have) / len(s) if s else 1.0 for s in (self.whole[item], *self.parts[item])]
            if share[0] >= OVERLAP and min(share[1:]) >= PART_OVERLAP:
                found = (score, -start, *share)
                best[n][item] = max(best[n].get(item, found), found)
        return [
            [(self.ids[j], -f[1], round(f[0], 6), *(round(x, 6) for x in f[2:])) for j, f in sorted(held.items())]
            for held in best
        ]


def item_indexes(benchmark: DataFrame) -> list[ItemIndex]:
    """Indexes of parts of the benchmark, each of at most ``PART_ITEMS`` items."""
    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            listed = [[w.decode() for w in words_of(t or "")] for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(listed, pa.list_(pa.string()))], names=["item_id", "text", "words"])

        return each

    items = map_slices(benchmark.select("item_id", "text"), make, "item_id long, text string, words array<string>").where(F.size("words") > 0)
    words = items.select(F.explode(F.array_distinct("words")).alias("w"))
    shape = items.agg(F.count("*"), F.avg(F.size("words"))).first()
    n_items, mean_length = shape[0], shape[1] or 1.0
    df = words.groupBy("w").count()
    n_parts = -(-n_items // PART_ITEMS)
    numbered = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n_parts))))
    indexes = []
    for part in range(n_parts):
        mine = numbered.where(F.col("part") == part)
        own = mine.select(F.explode("words").alias("w")).distinct()
        known = {r["w"].encode(): r["count"] for r in df.join(own, "w", "left_semi").collect()}
        listed = sorted((tuple(r) for r in mine.select("item_id", "text").collect()), key=lambda x: (x[0] is None, x))
        indexes.append(ItemIndex(listed, known, n_items, mean_length))
    return indexes


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and leaked item with the best passage, its score and overlaps."""
    spark = docs.sparkSession
    parts = []
    for index in item_indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def make(shared=shared):
            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                found = shared.value.leaks(batch.column(1).to_pylist())
                rows = [(doc_id, *leak) for doc_id, own in zip(batch.column(0).to_pylist(), found, strict=True) for leak in own]
                kinds = [pa.int64()] * 3 + [pa.float64()] * 4
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in FOUND.split(", ")])

            return each

        parts.append(map_slices(docs.select("doc_id", "text"), make, FOUND))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], FOUND)


def leaked(docs: DataFrame, benchmark: DataFrame) -> Column:
    """Whether ``text`` holds any item, as a column."""
    shared = [docs.sparkSession.sparkContext.broadcast(i) for i in item_indexes(benchmark)]

    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            held: list[bool] = []
            for at in range(0, len(texts), SLICE_ROWS):
                part = texts.iloc[at : at + SLICE_ROWS].tolist()
                found = [s.value.leaks(part) for s in shared]
                held += [any(own[i] for own in found) for i in range(len(part))]
            yield pd.Series(held, dtype="bool")

    return holds("text")


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any item of the benchmark, with their columns."""
    return docs.where(~leaked(docs, benchmark))
