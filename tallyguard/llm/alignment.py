"""Alignment of the tokens of two tokenizers over the same bytes.

Tokenizer spans: the character offsets of a ``tokenizers`` model (A) and the spans of a
``sentencepiece`` proto (B) are coarse cuts of the text's bytes.  Where they do not fall on the end
of a token - inside a multibyte character, or among byte-fallback tokens, which share one span - the
decoded bytes of the tokens refine them.  Offsets where both end a token cut the tokens into groups,
and every pair of tokens with a byte in common is a link.

Texts are aligned in units, cut at single spaces where neither tokenizer can join what stands on both
sides (``UNIT``).  A unit that a task has met before is not encoded again: what it holds is known.

Links of a corpus are counted per slab (a bounded run of documents of one task): a slab passes on its
distinct id pairs, their counts are added up over the corpus and come back to the slab, and the
documents of a slab meet them there.  No document-sized list of pairs is shuffled, and a frequent
pair is one row a slab.

Defined results
---------------
Null and empty texts, and texts whose tokens do not spell a space and the text, have no tokens.
Repeated rows and ids are documents of their own; a null id stays null.  Ties for the highest count
are all best.  Columns besides ``doc_id`` and ``text`` are ignored.  A long text needs memory for its
units only, except for a long run of text without any place to cut.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"

#: Characters of text that a task encodes at a time, and that make up one slab.
BATCH_CHARS = 1 << 18
SLAB_CHARS = 1 << 22
#: Links of known units that a task keeps; beyond it, it starts to learn anew.
KNOWN_LINKS = 1 << 22
#: A single space between two characters that are no white space.  A starts a new word at such a space
#: before it merges anything, and no piece of B goes on with a space after another character.
UNIT = re.compile(r" (?=\S)(?<=\S )")

_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_refined")
#: Documents with their units; the last row of a slab has its units' pairs and the pairs themselves.
_DOC_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("slab", "doc_id", *_COUNTS)]
    + [("groups_sha256", pa.string()), ("units", pa.binary()), ("unit_pairs", pa.binary()), ("pairs", pa.binary())]
)
_DOC = f"""slab bigint, doc_id bigint, {', '.join(f'{n} bigint' for n in _COUNTS)}, groups_sha256 string,
    units binary, unit_pairs binary, pairs binary"""
_RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, n_refined bigint"
_RESULT_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    + [("groups_sha256", pa.string()), ("n_refined", pa.int64())]
)
#: Bits of a document's number above those of a unit.
_UNIT_BITS = 40


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves, the others for the characters from 256 on, in order.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """What each id spells, and its decimal text with the separators that can follow it."""

    def __init__(self, spelled: list[bytes], end: str):
        self.bytes = spelled
        self.lengths = np.array([len(b) for b in spelled], np.int64)
        self.inside = np.array([f"{i}," for i in range(len(spelled))], object)
        self.closing = np.array([f"{i}{end}" for i in range(len(spelled))], object)

    def spell(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class Tokens:
    """Ids of several parts, the coarse byte end of each, and the part that it belongs to."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, counts: np.ndarray):
        self.ids, self.ends, self.counts = ids, ends, counts
        self.part = np.repeat(np.arange(len(counts)), counts)

    def spells(self, vocabulary: Vocabulary, whole: bytes, sizes: np.ndarray) -> np.ndarray:
        """Per part whether its tokens spell it; ``whole`` is all parts joined, ``sizes`` their bytes."""
        if vocabulary.spell(self.ids.tolist()) == whole:
            lengths = np.bincount(self.part, weights=vocabulary.lengths[self.ids], minlength=len(sizes))
            if (lengths == sizes).all():
                return np.ones(len(sizes), bool)
        ends, stops = np.cumsum(sizes).tolist(), np.cumsum(self.counts).tolist()
        out, ids, at, low = [], self.ids.tolist(), 0, 0
        for end, stop in zip(ends, stops):
            out.append(vocabulary.spell(ids[low:stop]) == whole[at:end])
            at, low = end, stop
        return np.array(out, bool)


class Aligner:
    """Both tokenizers, loaded once per Python worker."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        alphabet = byte_level_alphabet()
        tokens = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_ids = Vocabulary([bytes(alphabet.get(c, 32) for c in t) for t in tokens], "|")

        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        self.b_ids = Vocabulary(
            [
                bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in enumerate(pieces)
            ],
            ";",
        )
        # A piece with a space after another character would span the places where texts are cut.
        self.can_cut = not any(re.search("[^▁]▁", p) for p in pieces)

    def units(self, text: str) -> list[str]:
        """Parts of a text that can be encoded apart; each stands for a space and itself."""
        return UNIT.split(text) if self.can_cut else [text]

    def encode(self, parts: list[str]) -> tuple[Tokens, Tokens]:
        """Ids and coarse byte ends of the parts (each with its space), by A and by B."""
        found = self.a.encode_batch(parts, add_special_tokens=False)
        sizes = np.array([len(p) for p in parts], np.int64)
        ids = [e.ids for e in found]
        counts = np.array([len(x) for x in ids], np.int64)
        ends = np.array([end for e in found for _, end in e.offsets], np.int64)
        # From characters of a part to bytes of all parts.
        ends = _bytes_before("".join(parts))[ends + np.repeat(np.cumsum(sizes) - sizes, counts)]
        a = Tokens(_flat(ids), ends, counts)
        del found, ids

        # B adds the space itself and counts bytes from after it.
        protos = self.b.encode([p[1:] for p in parts], return_type="proto", num_threads=1)
        ids = [[t.id for t in p.pieces] for p in protos]
        counts = np.array([len(x) for x in ids], np.int64)
        ends = np.array([t.end for p in protos for t in p.pieces], np.int64)
        base = np.concatenate([[0], np.cumsum([len(p.encode()) for p in parts])]).astype(np.int64)
        return a, Tokens(_flat(ids), ends + 1 + np.repeat(base[:-1], counts), counts)


    def encode_together(self, parts: list[str]) -> tuple[Tokens, Tokens] | None:
        """The same for parts that end where neither tokenizer joins, as one text; None if that does not hold."""
        if not self.can_cut or any(p[1:2].isspace() or p[-1:].isspace() for p in parts):
            return None
        whole = "".join(parts)
        data, stops = whole.encode(), np.cumsum([len(p.encode()) for p in parts])
        found = self.a.encode(whole, add_special_tokens=False)
        a_ends = _bytes_before(whole)[np.array([end for _, end in found.offsets], np.int64)]
        pieces = self.b.encode(whole[1:], return_type="proto").pieces
        out = []
        for ids, ends, vocabulary in (
            (found.ids, a_ends, self.a_ids),
            ([t.id for t in pieces], np.array([t.end for t in pieces], np.int64) + 1, self.b_ids),
        ):
            if vocabulary.spell(ids) != data:
                return None
            flat = np.array(ids, np.int64)
            spelled = np.cumsum(vocabulary.lengths[flat])
            last = np.searchsorted(spelled, stops)
            if (spelled[last] != stops).any():
                return None
            out.append(Tokens(flat, ends, np.diff(last, prepend=-1)))
        return out[0], out[1]


@lru_cache(maxsize=2)
def load(byte_bpe: str, piece_bpe: str) -> Aligner:
    return Aligner(byte_bpe, piece_bpe)


def _bytes_before(text: str) -> np.ndarray:
    """Bytes before each character, and in all."""
    if text.isascii():
        return np.arange(len(text) + 1)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    widths = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64)
    return np.concatenate([[0], np.cumsum(widths)])


def refine(coarse: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ends of tokens from coarse ends and decoded lengths, and which ones were refined.

    A coarse end holds where the decoded bytes up to it agree.  After the last such end the decoded
    bytes of the following tokens place their ends.
    """
    spelled = np.cumsum(lengths)
    holds = coarse == spelled
    last = np.maximum.accumulate(np.where(holds, np.arange(len(coarse)), -1))
    known = np.where(last >= 0, coarse[last], 0)
    since = spelled - np.where(last >= 0, spelled[last], 0)
    return np.where(holds, coarse, known + since), ~holds


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64)


class Batch:
    """Aligned tokens of a few texts, each after a space, end to end on one byte axis.

    A text whose tokens do not spell it is ``bad`` and has no tokens.
    """

    def __init__(self, aligner: Aligner, texts: list[str]):
        parts = [" " + text for text in texts]
        sizes = np.array([len(p.encode()) for p in parts], np.int64)
        if together := aligner.encode_together(parts):
            of_a, of_b = together
            self.bad = np.zeros(len(parts), bool)
        else:
            of_a, of_b = aligner.encode(parts)
            whole = "".join(parts).encode()
            self.bad = ~(of_a.spells(aligner.a_ids, whole, sizes) & of_b.spells(aligner.b_ids, whole, sizes))
        gone = np.cumsum(np.where(self.bad, sizes, 0))

        def side(tokens: Tokens, vocabulary: Vocabulary):
            kept = ~self.bad[tokens.part]
            ids, part = tokens.ids[kept], tokens.part[kept]
            # Bytes of bad texts before a token are not on the axis.
            cuts, refined = refine(tokens.ends[kept] - gone[part], vocabulary.lengths[ids])
            return ids, cuts, refined, part

        self.a, a_cuts, a_refined, self.a_doc = side(of_a, aligner.a_ids)
        self.b, b_cuts, b_refined, self.b_doc = side(of_b, aligner.b_ids)
        self.size = rows = len(texts)
        self.refined = np.bincount(self.a_doc[a_refined], minlength=rows) + np.bincount(
            self.b_doc[b_refined], minlength=rows
        )
        # Places where both end a token close a group.
        meets = np.searchsorted(b_cuts, a_cuts)
        self.a_last = b_cuts[meets] == a_cuts if len(a_cuts) else np.zeros(0, bool)
        self.b_last = np.zeros(len(self.b), bool)
        self.b_last[meets[self.a_last]] = True
        # Between two neighbouring ends of either side lies exactly one pair of tokens.
        ends = np.sort(np.concatenate([a_cuts, b_cuts]))
        ends = ends[np.diff(ends, prepend=-1) > 0]
        self.link_a = np.searchsorted(a_cuts, ends)
        self.link_b = np.searchsorted(b_cuts, ends)
        self.aligner = aligner

    def counts(self) -> np.ndarray:
        """Per text its tokens of A and B, groups, links and refined tokens."""
        def of(rows: np.ndarray) -> np.ndarray:
            return np.bincount(rows, minlength=self.size)

        return np.stack(
            [of(self.a_doc), of(self.b_doc), of(self.a_doc[self.a_last]), of(self.a_doc[self.link_a]), self.refined], 1
        )

    def pairs(self) -> np.ndarray:
        """The id pair of each link, text by text."""
        return self.a[self.link_a] * len(self.aligner.b_ids.bytes) + self.b[self.link_b]

    def group_texts(self) -> list[str]:
        """Per text its groups, written out."""
        a_ids, b_ids = self.aligner.a_ids, self.aligner.b_ids
        a_group = np.cumsum(self.a_last) - self.a_last
        b_group = np.cumsum(self.b_last) - self.b_last
        groups = int(self.a_last.sum())
        b_before = np.concatenate([[0], np.cumsum(np.bincount(b_group, minlength=groups))])
        a_up_to = np.cumsum(np.bincount(a_group, minlength=groups))
        words = np.empty(len(self.a) + len(self.b), object)
        words[np.arange(len(self.a)) + b_before[a_group]] = np.where(
            self.a_last, a_ids.closing[self.a], a_ids.inside[self.a]
        )
        words[np.arange(len(self.b)) + a_up_to[b_group]] = np.where(
            self.b_last, b_ids.closing[self.b], b_ids.inside[self.b]
        )
        ends = np.cumsum(np.bincount(self.a_doc, minlength=self.size) + np.bincount(self.b_doc, minlength=self.size))
        words, at, out = words.tolist(), 0, []
        for end in ends.tolist():
            out.append("".join(words[at:end])[:-1])
            at = end
        return out

    def spans(self) -> list[tuple[list[int], list[int]]]:
        """The groups as lists of ids, for callers that want them whole."""
        out, a_at, b_at = [], 0, 0
        for a_end, b_end in zip(np.flatnonzero(self.a_last) + 1, np.flatnonzero(self.b_last) + 1):
            out.append((self.a[a_at:a_end].tolist(), self.b[b_at:b_end].tolist()))
            a_at, b_at = a_end, b_end
        return out


class Known:
    """Units that a task has aligned: their places, counts, written groups and id pairs."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.place: dict[str, int] = {}
        self.texts: list[str] = []
        self.bad: set[int] = set()
        self._counts: list[np.ndarray] = []
        self._pairs: list[np.ndarray] = []
        self.links = 0

    def places(self, units: list[str]) -> np.ndarray:
        """The places of units, aligning those that are new."""
        new = [u for u in dict.fromkeys(units) if u not in self.place]
        # Units at the edge of white space are not encoded together with others.
        edges = [u for u in new if u[:1].isspace() or u[-1:].isspace()]
        for some in ([u for u in new if not (u[:1].isspace() or u[-1:].isspace())], edges):
            at = 0
            while at < len(some):
                size, low = 0, at
                while at < len(some) and (size < BATCH_CHARS or at == low):
                    size += len(some[at])
                    at += 1
                self._learn(some[low:at])
        return np.fromiter(map(self.place.__getitem__, units), np.int64, len(units))

    def _learn(self, units: list[str]) -> None:
        first, batch = len(self.place), Batch(self.aligner, units)
        self.place.update(zip(units, range(first, first + len(units))))
        self.texts += batch.group_texts()
        self.bad.update((first + np.flatnonzero(batch.bad)).tolist())
        self._counts.append(batch.counts())
        self._pairs.append(batch.pairs())
        self.links += len(self._pairs[-1])

    def counts(self) -> np.ndarray:
        self._counts = [np.concatenate(self._counts)] if self._counts else [np.zeros((0, len(_COUNTS)), np.int64)]
        return self._counts[0]

    def pairs_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of some units, unit by unit, and how many each has."""
        self._pairs = [np.concatenate(self._pairs)] if self._pairs else [np.zeros(0, np.int64)]
        links = self.counts()[:, _COUNTS.index("n_links")]
        starts, sizes = np.cumsum(links) - links, links[places]
        shift = np.repeat(starts[places] - (np.cumsum(sizes) - sizes), sizes)
        return self._pairs[0][shift + np.arange(int(sizes.sum()))], sizes


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), kind)


class Slab:
    """The rows of a run of documents, closed when it has taken in enough text."""

    def __init__(self, number: int, known: Known):
        self.number, self.known = number, known
        self.chars, self.rows, self.units = 0, [], []

    def add(self, ids: list[int | None], texts: list[str | None]) -> None:
        known = self.known
        split = [known.aligner.units(t) if t else [] for t in texts]
        places = known.places([u for units in split for u in units])
        counts, at, docs = known.counts(), 0, []
        for doc_id, units in zip(ids, split):
            own = places[at : at + len(units)]
            at += len(units)
            spelled = own.tolist()
            if known.bad and not known.bad.isdisjoint(spelled):
                own, spelled = own[:0], []
            sha = hashlib.sha256(";".join(map(known.texts.__getitem__, spelled)).encode()).hexdigest() if spelled else ""
            self.rows.append((doc_id, *counts[own].sum(0).tolist(), sha))
            docs.append(own | ((len(self.rows) - 1) << _UNIT_BITS))
        # Once a document and unit, with how often.
        self.units.append(np.unique(np.concatenate(docs), return_counts=True))
        self.chars += sum(len(t) for t in texts if t)

    def close(self) -> pa.RecordBatch:
        """A row per document with its units, and a row with the pairs of the slab's units."""
        keys = np.concatenate([k for k, _ in self.units])
        times = np.concatenate([c for _, c in self.units])
        units, place = np.unique(keys & ((1 << _UNIT_BITS) - 1), return_inverse=True)
        used = np.bincount(place, weights=times, minlength=len(units)).astype(np.int64)
        ends = np.searchsorted(keys >> _UNIT_BITS, np.arange(len(self.rows)), side="right").tolist()
        rows, at = [], 0
        for row, end in zip(self.rows, ends):
            packed = _pack(place[at:end].astype(np.int32), times[at:end].astype(np.int32))
            rows.append((self.number, *row, packed, None, None))
            at = end
        links, sizes = self.known.pairs_of(units)
        pairs, spot = np.unique(links, return_inverse=True)
        totals = np.bincount(spot, weights=np.repeat(used, sizes), minlength=len(pairs)).astype(np.int64)
        own = _pack(np.array([len(units)], np.int32), sizes.astype(np.int32), spot.astype(np.int32))
        rows.append((self.number, *[None] * (2 + len(_COUNTS)), None, own, _pack(pairs, totals)))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows), _DOC_ARROW)], schema=_DOC_ARROW
        )


def _encode(docs: DataFrame, byte_bpe: str, piece_bpe: str, slab_chars: int) -> DataFrame:
    """Slabs of encoded documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(load(byte_bpe, piece_bpe))
        # Tasks number their slabs apart.
        slab = Slab(TaskContext.get().partitionId() << 32, known)
        ids, texts, size = [], [], 0
        for arrow in batches:
            for doc_id, text in zip(arrow.column(0), arrow.column(1)):
                ids.append(doc_id.as_py())
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= min(BATCH_CHARS, slab_chars) or len(ids) >= 4096:
                    slab.add(ids, texts)
                    ids, texts, size = [], [], 0
                    if slab.chars >= slab_chars or len(slab.rows) >= 1 << 16:
                        yield slab.close()
                        if known.links > KNOWN_LINKS:
                            known = Known(known.aligner)
                        slab = Slab(slab.number + 1, known)
        if ids:
            slab.add(ids, texts)
        if slab.rows:
            yield slab.close()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, _DOC)


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for slab, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            pairs, links = _unpack(packed.as_py(), np.int64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(pairs), slab)), pa.array(pairs), pa.array(links)], names=["slab", "pair", "links"]
            )


def _judge(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of one slab with the corpus-wide counts of its pairs."""
    order = np.argsort(counts.column("pair").to_numpy())
    n = counts.column("n").to_numpy()[order]
    best = counts.column("best").to_numpy().astype(np.int64)[order]
    own = pc.is_valid(docs.column("unit_pairs"))
    packed = _unpack(docs.filter(own).column("unit_pairs")[0].as_py(), np.int32)
    sizes, spot = packed[1 : 1 + packed[0]], packed[1 + packed[0] :]
    ends = np.cumsum(sizes, dtype=np.int64)

    def per_unit(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values[spot])]).astype(np.int64)
        return total[ends] - total[ends - sizes]

    unit_best, unit_sum = per_unit(best), per_unit(n)
    docs = docs.filter(pc.invert(own))
    n_best, count_sum = [], []
    for units in docs.column("units"):
        place, times = _unpack(units.as_py(), np.int32).reshape(2, -1).astype(np.int64)
        n_best.append(int((times * unit_best[place]).sum()))
        count_sum.append(int((times * unit_sum[place]).sum()))
    named = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
    return pa.Table.from_arrays(
        [named[f.name] if f.name in named else docs.column(f.name).combine_chunks() for f in _RESULT_ARROW],
        schema=_RESULT_ARROW,
    )


def align(
    docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, slab_chars: int = SLAB_CHARS
) -> DataFrame:
    """Per document the sizes of its alignment, its links' standing in the corpus, and its groups' hash.

    The paths name vocabulary files that every executor can open.
    """
    encoded = cut(_encode(docs, byte_bpe, piece_bpe, slab_chars), "aligned")
    known = encoded.where("pairs is not null").select("slab", "pairs")
    pairs = known.mapInArrow(_pairs_of, "slab bigint, pair bigint, links bigint")
    counts = cut(pairs.groupBy("pair").agg(F.sum("links").alias("n")), "pair_counts")
    size = _piece_count(piece_bpe)
    of_b = F.col("pair") % size
    # One row per id of B: the size of its vocabulary bounds it.
    most = counts.groupBy(of_b.alias("b")).agg(F.max("n").alias("most"))
    judged = counts.withColumn("b", of_b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    back = pairs.select("slab", "pair").join(judged, "pair")
    return encoded.drop("pairs").groupBy("slab").cogroup(back.groupBy("slab")).applyInArrow(_judge, _RESULT)


def _piece_count(piece_bpe: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe).get_piece_size()
