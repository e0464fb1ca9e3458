"""Substring deduplication over bytes with sorted suffixes.

Sorting every suffix of the corpus is not needed to find strings of 200 bytes that occur twice.
A string picks the 48-byte gram of least hash inside it; strings whose gram occurs once are
alone, and neighbouring strings that pick one gram form a segment (``segments.py``).  Equal
segments stand for each other.  Where different segments share a gram, the suffixes that start
at their strings are sorted deep-shallow: multikey sorting by 8-byte characters down to a shallow
depth, then a blind trie for each group that still agrees, which orders the suffixes and joins
those that agree in all 200 bytes.

Spark partitions the sort by gram.  A gram with very many different segments is spread over
several groups.  Each group sorts its own and passes on one entry per different string (its 128-bit
hash and how often it occurred), packed and dealt by hash; a second step adds the entries of all
groups up and finds strings that are single in their group but not in all.

Defined cases: a null text is empty; texts under 200 bytes lose nothing; repeated rows and null
ids count like any other row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import map_slices, mix, packed, unpacked, with_row_key
from .segments import SpanHashes, batch_of, by_document, covered, pieces, removals, runs_of, segment_rows, whole

WIDTH, GRAM = 200, 48
#: Depth to which suffixes are sorted by multikey sorting, in bytes.
SHALLOW = 24
#: Different segments that one group sorts, about; and bytes that are sorted at a time.
GROUP, SORT_BYTES = 2048, 1 << 18
#: A string of a group that is spread: its hash, occurrences, and for single ones their place.
ENTRY = np.dtype([("w0", "<u8"), ("w1", "<u8"), ("seg", "<i8"), ("off", "<i4"), ("times", "<i4")])


def symbols(data: np.ndarray) -> np.ndarray:
    """Byte values as well-spread 64-bit symbols."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[data]


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


def anchored(data: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray] | None:
    """Segments of the documents of a piece, with ``doc``; ``lo`` counts from its start."""
    last = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(data))
    windows = place[place + WIDTH <= last[doc]] if len(doc) else place
    if not len(windows):
        return None
    hashes = SpanHashes(symbols(data))
    grams = place[: len(data) - GRAM + 1]
    ranked = (hashes(grams, grams + GRAM) & np.uint64(0xFFFFFFFF00000000)) | grams.astype(np.uint64)
    chosen = (_sliding_least(ranked, WIDTH - GRAM + 1)[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    rows = segment_rows(chosen, chosen, chosen + GRAM, windows, WIDTH, hashes)
    return rows | {"doc": doc[rows["lo"]]}


def find_segments(keyed: DataFrame) -> DataFrame:
    """All segments of ``keyed(text, row_key)``."""

    def make():
        def each(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
            keys = batch.column(1).to_numpy()
            listed = [(t or "").encode() for t in batch.column(0).to_pylist()]
            out = []
            for piece in pieces([len(d) for d in listed]):
                sizes = np.array([len(d) for d in listed[piece]], np.int64)
                rows = anchored(np.frombuffer(b"".join(listed[piece]), np.uint8), sizes)
                if rows is not None:
                    doc, start = rows["doc"], np.cumsum(sizes) - sizes
                    lo = (rows["lo"] - start[doc]).astype(np.int32)
                    out.append(batch_of({"key": rows["key"], "seg": rows["seg"], "row_key": keys[piece][doc], "lo": lo, "n": rows["n"].astype(np.int32)}))
            return out

        return each

    return map_slices(keyed.select("text", "row_key"), make, "key long, seg long, row_key long, lo int, n int", 64)


class BlindTrie:
    """Orders suffixes that agree on ``depth`` bytes, up to ``WIDTH``.

    Inner nodes hold the depth at which their suffixes part; an insertion compares bytes
    with one leaf only.  A leaf holds the suffixes that agree in all bytes.
    """

    def __init__(self, data: bytes, depth: int):
        self.data, self.depth, self.root = data, depth, None

    def agree(self, a: int, b: int) -> int:
        skip, size = self.depth, WIDTH - self.depth
        x = int.from_bytes(self.data[a + skip : a + WIDTH], "big") ^ int.from_bytes(self.data[b + skip : b + WIDTH], "big")
        return WIDTH if not x else skip + (8 * size - x.bit_length()) // 8

    def insert(self, at: int) -> None:
        if self.root is None:
            self.root = [at]
            return
        node = self.root
        while isinstance(node, tuple):
            depth, children = node
            node = children.get(self.data[at + depth]) or next(iter(children.values()))
        common = self.agree(at, node[0])
        if common == WIDTH:
            node.append(at)
            return
        old = self.data[node[0] + common]
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < common:
            parent, node = node, node[1][self.data[at + node[0]]]
        if isinstance(node, tuple) and node[0] == common:
            node[1][self.data[at + common]] = [at]
            return
        inner = (common, {old: node, self.data[at + common]: [at]})
        if parent is None:
            self.root = inner
        else:
            parent[1][self.data[at + parent[0]]] = inner

    def leaves(self) -> Iterator[list[int]]:
        """The groups of equal suffixes in order."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                yield node


def deep_shallow(data: bytes, starts: np.ndarray) -> Iterator[list[int]]:
    """Groups of suffixes at ``starts`` that agree in ``WIDTH`` bytes, in order; only groups of two or more."""
    raw = np.frombuffer(data, np.uint8)
    wide = np.lib.stride_tricks.sliding_window_view(raw, 8)
    group = np.zeros(len(starts), np.int64)
    for depth in range(0, SHALLOW, 8):
        # The next 8 bytes as one character; every group is split three ways and more at once.
        character = np.ascontiguousarray(wide[starts + depth]).view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((character, group))
        starts, group, character = starts[order], group[order], character[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (character[1:] != character[:-1])]
        group = np.cumsum(new) - 1
        alone = np.bincount(group)[group] == 1
        starts, group = starts[~alone], group[~alone]
        if not len(starts):
            return
    edge = np.append(np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group))
    listed = starts.tolist()
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        trie = BlindTrie(data, SHALLOW)
        for at in listed[a:b]:
            trie.insert(at)
        yield from (leaf for leaf in trie.leaves() if len(leaf) > 1)


SORTED = "key long, seg long, a int, b int, part int, entries binary"


def _sorted_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SORTED.split(", ")])


def _runs(key: int, seg: int, hit: np.ndarray) -> list[tuple]:
    return [(key, seg, a, b, None, None) for a, b, _ in runs_of(hit, np.zeros(len(hit), np.int64))] if len(hit) else []


def _sort_groups(rows: list[tuple]) -> pa.RecordBatch:
    """Repeated strings of whole groups of (key, salts, seg, times, text)."""
    data = b"".join(r[4] for r in rows)
    sizes = np.array([len(r[4]) for r in rows])
    base = np.cumsum(sizes) - sizes
    n = sizes - WIDTH + 1
    which = np.repeat(np.arange(len(rows)), n)
    starts = base[which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    again, spread = np.zeros(len(data), bool), np.array([r[1] for r in rows]) > 1
    owner = np.zeros(len(data), np.int64)
    owner[starts] = which
    entries: list[tuple[int, int]] = []  # (a suffix, its occurrences) for repeated strings of spread groups
    for leaf in deep_shallow(data, starts):
        again[leaf] = True
        if spread[owner[leaf[0]]]:
            entries.append((leaf[0], sum(rows[owner[at]][3] for at in leaf)))
    out = [x for i in range(len(rows)) for x in _runs(rows[i][0], rows[i][2], np.flatnonzero(again[base[i] : base[i] + n[i]]))]
    if spread.any():
        symbol = symbols(np.frombuffer(data, np.uint8))
        hashes = [SpanHashes(symbol, k) for k in range(2)]
        single = starts[spread[which] & ~again[starts]]
        at = np.append(single, np.array([e[0] for e in entries], np.int64)).astype(np.int64)
        made = np.zeros(len(at), ENTRY)
        made["w0"], made["w1"] = (h(at, at + WIDTH) for h in hashes)
        seg, times = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        made["seg"], made["off"] = seg[owner[at]], at - base[owner[at]]
        made["times"] = np.append(times[owner[single]], [e[1] for e in entries])
        made["off"][len(single) :] = -1
        key, salts = np.array([r[0] for r in rows])[owner[at]], np.array([r[1] for r in rows])[owner[at]]
        part = (made["w0"] % salts.astype(np.uint64)).astype(np.int64)
        order = np.lexsort((part, key))
        edge = np.flatnonzero(np.r_[True, (key[order][1:] != key[order][:-1]) | (part[order][1:] != part[order][:-1])])
        for own in np.split(order, edge[1:]):
            out.append((int(key[own[0]]), None, None, None, int(part[own[0]]), made[own].tobytes()))
    return _sorted_batch(out)


def _across_groups(spread: DataFrame) -> DataFrame:
    """Strings that are single in their group and occur in another group of the same gram."""

    def joined(key: int, blobs: list[bytes]) -> list[tuple]:
        made = np.frombuffer(b"".join(blobs), ENTRY)
        made = made[np.lexsort((made["w1"], made["w0"]))]
        edge = np.flatnonzero(np.r_[True, (made["w0"][1:] != made["w0"][:-1]) | (made["w1"][1:] != made["w1"][:-1])])
        total = np.repeat(np.add.reduceat(made["times"].astype(np.int64), edge), np.diff(np.append(edge, len(made))))
        hit = made[(total > 1) & (made["off"] >= 0)]
        hit = hit[np.lexsort((hit["off"], hit["seg"]))]
        out = []
        for own in np.split(np.arange(len(hit)), np.flatnonzero(hit["seg"][1:] != hit["seg"][:-1]) + 1):
            out += _runs(key, int(hit["seg"][own[0]]), hit["off"][own].astype(np.int64)) if len(own) else []
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for key, part, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, part) != at and held:
                    yield _sorted_batch(joined(at[0], held))
                    held = []
                at = (key, part)
                held.append(blob)
        if held:
            yield _sorted_batch(joined(at[0], held))

    dealt = spread.select("key", "part", "entries").repartition("key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(run, SORTED)


def _sorted_strings(texts: DataFrame) -> DataFrame:
    """Deep-shallow sorting of ``texts(key, salt, salts, seg, times, text)``, group by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at, size = None, 0
        for batch in batches:
            for key, salt, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, salt) != at and size > SORT_BYTES:
                    yield _sort_groups(held)
                    held, size = [], 0
                at = (key, salt)
                held.append((key, *row))
                size += len(row[3])
        if held:
            yield _sort_groups(held)

    dealt = texts.repartition("key", "salt").sortWithinPartitions("key", "salt")
    return dealt.select("key", "salt", "salts", "seg", "times", "text").mapInArrow(run, SORTED)


def _segment_texts(texts: DataFrame) -> DataFrame:
    """The bytes of the wanted segments of ``texts(wanted, packed)``."""

    def make():
        def each(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
            out = []
            for wanted, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = unpacked(blob)
                cuts = [data[w["lo"] : w["lo"] + w["n"] + WIDTH - 1] for w in wanted]
                out.append(batch_of({"key": pa.array([w["key"] for w in wanted], pa.int64()), "seg": pa.array([w["seg"] for w in wanted], pa.int64()), "text": pa.array(cuts, pa.binary())}))
            return out

        return each

    return map_slices(texts, make, "key long, seg long, text binary")


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """``row_key``, ``intervals``: bytes covered by a string that also starts elsewhere."""
    keyed = with_row_key(docs)
    segments = cut(find_segments(keyed), "byte-segments")
    shared = segments.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
    shared = cut(shared, "shared-byte-keys")  # a plain table, so that a hot key's side of the join can be split
    repeated = cut(segments.join(shared, "key"), "shared-byte-segments")
    distinct = repeated.groupBy("key", "seg").agg(F.count("*").alias("times"), F.min(F.struct("row_key", "lo", "n")).alias("r"))
    distinct = cut(distinct.select("key", "seg", "times", "r.*"), "distinct-byte-segments")
    # A segment that occurs twice is repeated as a whole; the others need comparison.
    open_keys = distinct.groupBy("key").agg(F.count("*").alias("variants"), F.min("times").alias("least"))
    open_keys = open_keys.where("variants > 1 and least = 1").select("key", F.ceil(F.col("variants") / GROUP).cast("int").alias("salts"))
    several = distinct.join(open_keys, "key").select("key", "seg", "times", "salts", "row_key", "lo", "n")
    wanted = by_document(several).alias("w")
    texts = packed(keyed, "row_key").alias("t").join(wanted, F.col("t.row_key") == F.col("w.row_key")).select("w.wanted", "t.packed")
    # Rows that are equal share a key and give the same texts: one of them is enough.
    texts = _segment_texts(texts).groupBy("key", "seg").agg(F.first("text").alias("text"))
    texts = texts.join(several.select("key", "seg", "times", "salts"), ["key", "seg"]).withColumn("salt", F.pmod("seg", "salts").cast("int"))
    sorted_ = cut(_sorted_strings(texts), "sorted-strings")
    runs = sorted_.where("entries is null").unionByName(_across_groups(sorted_.where("entries is not null")))
    runs = runs.select("key", "seg", "a", "b")
    # A segment has at most as many runs as strings.
    runs = runs.groupBy("key", "seg").agg(F.collect_set(F.struct("a", "b")).alias("runs"))
    decided = distinct.select("key", "seg", "times").join(runs, ["key", "seg"], "left").where("times > 1 or runs is not null")
    decided = cut(decided, "decided-byte-segments")
    at = repeated.join(decided, ["key", "seg"])
    lo = F.col("lo")
    parts = F.transform("runs", lambda r: F.struct((lo + r["a"]).alias("start"), (lo + r["b"] + WIDTH).alias("stop")))
    return removals(at.select("row_key", F.when(F.col("times") > 1, F.array(whole(lo, F.col("n"), WIDTH))).otherwise(parts).alias("intervals")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept``: the bytes that stay."""
    found = repeated_bytes(docs).alias("f")
    texts = packed(with_row_key(docs), "doc_id", "row_key").alias("t")
    joined = texts.join(found, F.col("t.row_key") == F.col("f.row_key"), "left").select("t.doc_id", "f.intervals", "t.packed")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for intervals, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = unpacked(blob)
                gone = covered(intervals, len(data))
                n_bytes.append(len(data))
                n_removed.append(int(gone.sum()))
                n_spans.append(int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0)
                kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes() if intervals else data)
            numbers = [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)]
            return pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

        return each

    return map_slices(joined, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
