"""Repeated windows of sequences, found through anchored segments.

A window is a fixed number of consecutive symbols (words or bytes) of one document.  Each
window picks an anchor inside itself by its content alone, so equal windows pick the same
anchor at the same offset.  The consecutive windows that share an anchor form a segment:

``key``   hash of what surrounds the anchor and lies inside all these windows,
``seg``   hash of the whole segment and the place of its anchor,
``lo``    the first window, ``n`` the number of windows.

Equal windows have equal keys, and windows of segments with equal ``seg`` are equal one by one.
So keys that occur once can be dropped early, equal segments stand for each other, and only
distinct segments under one key have to be compared window by window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix

INTERVALS = "array<struct<start: int, stop: int>>"
#: Symbols that a task anchors at a time; a longer document is one piece.
CHUNK = 1 << 17

_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base**2 ... modulo 2**64."""
    out = np.empty(n + 1, np.uint64)
    out[0] = 1
    done = 1
    while done <= n:
        more = min(done, n + 1 - done)
        step = out[done - 1] * base
        out[done : done + more] = out[:more] * step
        done += more
    return out


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 2**64))


class SpanHashes:
    """Hashes of spans of symbols that do not depend on where the span stands."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        base = _BASE[which]
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(symbols) + 1, np.uint64)
            np.cumsum(symbols * _powers(base, len(symbols))[:-1], out=self.sums[1:])
            self.back = _powers(_inverse(base), len(symbols))

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            length = (stop - start).astype(np.uint64)
            return mix((self.sums[stop] - self.sums[start]) * self.back[start] + length * np.uint64(0xA24BAED4963EE407))


def segment_rows(
    chosen: np.ndarray, low: np.ndarray, high: np.ndarray, windows: np.ndarray, width: int, hashes: SpanHashes
) -> dict[str, np.ndarray]:
    """Segments out of the windows of a piece.

    ``windows`` are the first symbols of the windows in order, ``chosen`` identifies the
    anchor of each, and ``low``/``high`` bound what the anchor's choice rests on.
    """
    edge = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (windows[1:] != windows[:-1] + 1)])
    n = np.diff(np.append(edge, len(windows)))
    lo = windows[edge]
    key = hashes(low[edge], high[edge])
    with np.errstate(over="ignore"):
        place = (low[edge] - lo).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + n.astype(np.uint64)
        seg = mix(hashes(lo, lo + n + width - 1) ^ mix(place) ^ key)
    return {"key": key.view(np.int64), "seg": seg.view(np.int64), "lo": lo, "n": n}


def pieces(sizes: list[int]) -> Iterator[slice]:
    """Neighbouring documents in pieces of about ``CHUNK`` symbols."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > CHUNK:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def by_document(segments: DataFrame) -> DataFrame:
    """The chosen segments per row of the documents, to fetch their text once.

    A document has fewer segments than symbols, so the list is bounded by its text.
    """
    return segments.groupBy("row_key").agg(F.collect_set(F.struct("key", "seg", "lo", "n")).alias("wanted"))


def removals(found: DataFrame) -> DataFrame:
    """Intervals to remove per row of the documents, from rows with an array of them."""
    spread = found.select("row_key", F.explode("intervals").alias("i")).distinct()
    return spread.groupBy("row_key").agg(F.collect_list("i").alias("intervals"))


def covered(intervals: list[dict] | None, n: int) -> np.ndarray:
    """A mask of the ``n`` symbols inside any interval."""
    mask = np.zeros(n + 1, np.int32)
    if intervals:
        np.add.at(mask, [i["start"] for i in intervals], 1)
        np.add.at(mask, [i["stop"] for i in intervals], -1)
    return np.cumsum(mask[:-1]) > 0


def runs_of(offsets: np.ndarray, values: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, last, value) of neighbouring offsets with one value."""
    order = np.argsort(offsets, kind="stable")
    offsets, values = offsets[order], values[order]
    edge = np.flatnonzero(np.r_[True, (offsets[1:] != offsets[:-1] + 1) | (values[1:] != values[:-1])])
    last = np.append(edge[1:], len(offsets)) - 1
    return list(zip(offsets[edge].tolist(), offsets[last].tolist(), values[edge].tolist(), strict=True))


def whole(lo: Column, n: Column, width: int) -> Column:
    """The interval of symbols under ``n`` windows from ``lo``."""
    return F.struct(lo.cast("int").alias("start"), (lo + n + (width - 1)).cast("int").alias("stop"))


def batch_of(columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))
