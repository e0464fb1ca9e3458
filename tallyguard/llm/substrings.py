"""Substring deduplication over words by recompression.

Rounds rename neighbouring symbols: a pair round joins every symbol of the left class with a
following symbol of the right class, a run round joins repetitions of one symbol.  Names and
classes are hashes of the parts, so they are global across all tasks without a shared
dictionary: equal substrings get equal symbols wherever what a symbol depends on lies inside
both.  That dependence is tracked exactly for every symbol (its own words and the neighbours
that decided it).  A window of 50 words is anchored at a symbol of the highest level that
depends on nothing outside the window, the one with the least name.  Level 0 are the words
themselves, so every window has an anchor and no repeat can be missed.

Spark then finds shared anchors, compares segments as wholes, and verifies window by window with
128-bit hashes what shares an anchor but is not equal as a whole (``segments.py``).

Defined cases: null, empty and short texts have no windows and lose nothing; rows with a null
``doc_id`` neither give nor lose words; rows that share a ``doc_id`` count as one document for
the comparison "smaller"; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import map_slices, mix, packed, unpacked, with_row_key
from .segments import SpanHashes, batch_of, by_document, covered, pieces, removals, runs_of, segment_rows, whole

WIDTH = 50
ROUNDS = ("pair", "pair", "run", "pair", "pair")


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Level:
    """Symbols in text order: name, the words [low, high) it depends on, document, its ends."""

    def __init__(self, name, low, high, doc):
        self.name, self.low, self.high, self.doc = name, low, high, doc


def rename(level: Level, kind: str, salt: int, first: np.ndarray, last: np.ndarray) -> Level:
    """One round.  ``first`` and ``last`` bound the words of each document.

    A symbol decided by the end of its document depends on something outside of it.
    """
    name, low, high, doc = level.name, level.low, level.high, level.doc
    same = doc[1:] == doc[:-1]
    none = np.array([False])
    # What a symbol depends on if the decision also looked at its left or right neighbour.
    left_low = np.where(np.r_[none, same], np.r_[low[:1], low[:-1]], first[doc] - 1)
    right_high = np.where(np.r_[same, none], np.r_[high[1:], high[-1:]], last[doc] + 1)
    with np.errstate(over="ignore"):
        if kind == "pair":
            right = (mix(name + np.uint64(salt)) & np.uint64(1)).astype(bool)
            joins = same & ~right[:-1] & right[1:]  # the symbol and its successor become one
            head = ~np.r_[none, joins]
            opens = np.r_[joins, none]
            at = np.flatnonzero(head)
            end = np.minimum(at + opens[at], len(name) - 1)
            pair = opens[at]
            names = np.where(pair, mix(name[at] * np.uint64(0xC2B2AE3D27D4EB4F) + mix(name[end] + np.uint64(salt))), name[at])
            lows = np.where(pair | ~right[at], low[at], np.minimum(low[at], left_low[at]))
            highs = np.where(pair, high[end], np.where(right[at], high[at], np.maximum(high[at], right_high[at])))
        else:
            head = ~np.r_[none, same & (name[1:] == name[:-1])]
            at = np.flatnonzero(head)
            end = np.append(at[1:], len(name)) - 1
            length = (end - at + 1).astype(np.uint64)
            names = np.where(length > 1, mix(name[at] * np.uint64(0x165667B19E3779F9) + length), name[at])
            lows, highs = np.minimum(low[at], left_low[at]), np.maximum(high[end], right_high[end])
    return Level(names, lows, highs, doc[at])


def _least(names: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each range [start, stop] the leftmost symbol of least name (doubling tables)."""
    spans = stop - start + 1
    power = np.frexp(spans.astype(np.float64))[1] - 1
    tables = [np.arange(len(names))]
    for k in range(int(power.max(initial=0))):
        a, b = tables[-1][: -(1 << k)], tables[-1][1 << k :]
        tables.append(np.where(names[a] <= names[b], a, b))
    out = np.empty(len(start), np.int64)
    for k, table in enumerate(tables):
        mine = np.flatnonzero(power == k)
        a, b = table[start[mine]], table[stop[mine] - (1 << k) + 1]
        out[mine] = np.where(names[a] <= names[b], a, b)
    return out


def anchored(hashes: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray] | None:
    """Segments of the documents of a piece, with ``doc``, their place in the piece.

    ``lo`` counts from the start of the piece.
    """
    last = np.cumsum(sizes)
    first = last - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(hashes))
    windows = place[place + WIDTH <= last[doc]] if len(doc) else place
    if not len(windows):
        return None
    levels = [Level(hashes, place, place + 1, doc)]
    for salt, kind in enumerate(ROUNDS):
        levels.append(rename(levels[-1], kind, salt, first, last))
    chosen = np.full(len(windows), -1, np.int64)
    low, high = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
    open_ = np.arange(len(windows))
    for rank, level in enumerate(reversed(levels)):
        at = windows[open_]
        start = np.searchsorted(level.low, at, "left")
        stop = np.searchsorted(level.high, at + WIDTH, "right") - 1
        usable = start <= stop
        mine, j = open_[usable], _least(level.name, start[usable], stop[usable])
        chosen[mine] = j * len(levels) + rank
        low[mine], high[mine] = level.low[j], level.high[j]
        open_ = open_[~usable]
        if not len(open_):
            break
    rows = segment_rows(chosen, low, high, windows, WIDTH, SpanHashes(hashes))
    return rows | {"doc": doc[rows["lo"]]}


def find_segments(keyed: DataFrame) -> DataFrame:
    """All segments of ``keyed(doc_id, text, row_key)`` under documents with an id."""

    def make():
        def each(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
            ids, keys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            listed = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
            out = []
            for piece in pieces([len(w) for w in listed]):
                sizes = np.array([len(w) for w in listed[piece]], np.int64)
                words = [w for ws in listed[piece] for w in ws]
                rows = anchored(word_hashes(words), sizes)
                if rows is not None:
                    doc = rows["doc"]
                    start = np.cumsum(sizes) - sizes
                    out.append(
                        batch_of(
                            {
                                "key": rows["key"],
                                "seg": rows["seg"],
                                "doc_id": ids[piece][doc],
                                "row_key": keys[piece][doc],
                                "lo": (rows["lo"] - start[doc]).astype(np.int32),
                                "n": rows["n"].astype(np.int32),
                            }
                        )
                    )
            return out

        return each

    rows = keyed.where(F.col("doc_id").isNotNull()).select("doc_id", "text", "row_key")
    return map_slices(rows, make, "key long, seg long, doc_id long, row_key long, lo int, n int")


def _windows(texts: DataFrame) -> DataFrame:
    """128-bit hashes of the windows of the wanted segments of ``texts(doc_id, wanted, packed)``."""

    def make():
        def each(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
            out = []
            for doc_id, wanted, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                hashes = word_hashes(unpacked(blob).split())
                lo = np.array([w["lo"] for w in wanted])
                n = np.array([w["n"] for w in wanted])
                which = np.repeat(np.arange(len(n)), n)
                off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = lo[which] + off
                columns = {f"w{i}": SpanHashes(hashes, i)(at, at + WIDTH).view(np.int64) for i in range(2)}
                columns |= {name: np.array([w[name] for w in wanted])[which] for name in ("key", "seg")}
                out.append(batch_of(columns | {"off": off.astype(np.int32), "first": np.full(len(at), doc_id)}))
            return out

        return each

    return map_slices(texts, make, "w0 long, w1 long, key long, seg long, off int, first long")


def _runs(windows: DataFrame) -> DataFrame:
    """The first document of the windows of each distinct segment, as runs of offsets."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            runs = []
            for listed in batch.column(2).to_pylist():
                off, first = (np.array([x[f] for x in listed]) for f in ("off", "first"))
                runs.append([{"a": a, "b": b, "first": v} for a, b, v in runs_of(off, first)])
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("first", pa.int64())]))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, kind)], names=["key", "seg", "runs"])

        return each

    # A segment has at most as many windows as a window has words.
    grouped = windows.groupBy("key", "seg").agg(F.collect_set(F.struct("off", "first")).alias("listed"))
    return map_slices(grouped, make, "key long, seg long, runs array<struct<a: int, b: int, first: long>>", 4096)


def repeated_words(docs: DataFrame) -> DataFrame:
    """``row_key``, ``intervals``: words covered by a window that starts in a smaller document too."""
    keyed = with_row_key(docs)
    segments = cut(find_segments(keyed), "word-segments")
    shared = segments.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key")
    shared = cut(shared, "shared-word-keys")  # a plain table, so that a hot key's side of the join can be split
    repeated = cut(segments.join(shared, "key"), "shared-word-segments")
    distinct = repeated.groupBy("key", "seg").agg(F.min(F.struct("doc_id", "row_key", "lo", "n")).alias("r")).select("key", "seg", "r.*")
    distinct = cut(distinct, "distinct-word-segments")
    variants = distinct.groupBy("key").agg(F.count("*").alias("variants"))
    several = distinct.join(variants.where("variants > 1").select("key"), "key", "left_semi")
    wanted = by_document(several).alias("w")
    texts = packed(keyed.where(F.col("doc_id").isNotNull()), "doc_id", "row_key").alias("t")
    texts = texts.join(wanted, F.col("t.row_key") == F.col("w.row_key")).select("t.doc_id", "w.wanted", "t.packed")
    windows = cut(_windows(texts), "word-windows")
    firsts = windows.groupBy("w0", "w1").agg(F.min("first").alias("first"))
    runs = _runs(windows.drop("first").join(firsts, ["w0", "w1"]))
    decided = distinct.select("key", "seg", F.col("doc_id").alias("first")).join(runs, ["key", "seg"], "left")
    decided = cut(decided, "decided-word-segments")
    at = repeated.join(decided, ["key", "seg"])
    lo, n = F.col("lo"), F.col("n")
    plain = F.when(F.col("first") < F.col("doc_id"), F.array(whole(lo, n, WIDTH))).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))
    earlier = F.filter("runs", lambda r: r["first"] < F.col("doc_id"))
    mixed = F.transform(earlier, lambda r: F.struct((lo + r["a"]).alias("start"), (lo + r["b"] + WIDTH).alias("stop")))
    return removals(at.select("row_key", F.when(F.col("runs").isNull(), plain).otherwise(mixed).alias("intervals")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept``: the words that stay, joined by one space."""
    found = repeated_words(docs).alias("f")
    texts = packed(with_row_key(docs), "doc_id", "row_key").alias("t")
    joined = texts.join(found, F.col("t.row_key") == F.col("f.row_key"), "left").select("t.doc_id", "f.intervals", "t.packed")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_words, n_removed, kept = [], [], []
            for intervals, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = unpacked(blob).split()
                gone = covered(intervals, len(words))
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone, strict=True) if not g) if intervals else b" ".join(words))
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])

        return each

    return map_slices(joined, make, "doc_id long, n_words long, n_removed long, kept string")
