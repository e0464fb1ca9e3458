"""Token alignment against plain loops over decoded tokens."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyguard.llm import alignment

from ..conftest import SMALL

SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(alignment.BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)


def decoded(models, text):
    """(id, bytes) of the tokens of both models."""
    a, b = models
    alphabet = alignment.byte_level_alphabet()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    of_a = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in ids_a]
    of_b = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        of_b.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    return of_a, of_b


def ranges(tokens):
    out, at = [], 0
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def brute(models, rows):
    links, sides = [], []
    for _, text in rows:
        of_a, of_b = decoded(models, text) if text else ([], [])
        raw = (" " + text).encode() if text else b""
        if b"".join(d for _, d in of_a) != raw or b"".join(d for _, d in of_b) != raw:
            of_a, of_b = [], []
        of_a, of_b = ranges(of_a), ranges(of_b)
        links.append([(x, y) for x, s, e in of_a for y, t, f in of_b if s < f and t < e])
        sides.append((of_a, of_b))
    count = Counter(pair for own in links for pair in own)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for (doc_id, _), own, (of_a, of_b) in zip(rows, links, sides):
        ends = sorted({e for _, _, e in of_a} & {e for _, _, e in of_b})
        groups, low = [], 0
        for end in ends:
            inside = [",".join(str(i) for i, s, e in side if low <= s and e <= end) for side in (of_a, of_b)]
            groups.append("|".join(inside))
            low = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        n_best = sum(count[p] == best[p[1]] for p in own)
        out.append((doc_id, len(of_a), len(of_b), len(ends), len(own), n_best, sum(count[p] for p in own), digest))
    return sorted(out, key=str)


def aligned(spark, rows):
    result = alignment.align(spark.createDataFrame(rows, SCHEMA)).drop("n_refined")
    return sorted((tuple(r) for r in result.collect()), key=str)


ODD = [
    (1, "Hello world, hello  worlds"),
    (2, "héllo ﬁ 漢字𝕏 x<|endoftext|>\n▁a"),
    (3, ""),
    (4, None),
    (5, " "),
    (6, "  two  spaces "),
    (7, "<s> </s> <unk> <0x0A> <0xFF>"),
    (8, "tab\tnul\x00 line\r\n\r\n end"),
    (9, "\U0001f468‍\U0001f469‍\U0001f467 é ö   x"),
    (10, "1234567890 12.5e-7 don't we'll"),
    (11, "Hello world, hello  worlds"),
    (None, "no id"),
    (11, "again"),
    (12, "a" * 300),
    (13, "漢字" * 50),
]


def test_equals_loops_on_odd_texts(spark, models):
    assert aligned(spark, ODD) == brute(models, ODD)


def test_equals_loops_on_the_table(spark, models):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy(F.length("text")).limit(120)
    rows = [tuple(r) for r in docs.collect()]
    assert aligned(spark, rows) == brute(models, rows)


def test_empty_table(spark):
    assert aligned(spark, []) == []


def test_many_slabs_count_together(spark, models):
    rows = [(i, f"word{i % 7} and the other {i % 3} words ÄÖ") for i in range(60)]
    # Every task closes a slab after each document.
    result = alignment.align(spark.createDataFrame(rows, SCHEMA), slab_chars=1).drop("n_refined")
    assert sorted((tuple(r) for r in result.collect()), key=str) == brute(models, rows)


@pytest.mark.parametrize(
    "text",
    ["some words of a text, ÄÖ 漢字 and more. " * 40, "x y z " * 300, "don't 's  two 12 3.5 (a) <b> ... \n c\t d " * 50],
)
def test_units_change_nothing(text):
    loaded = alignment.load(alignment.BYTE_BPE, alignment.PIECE_BPE)
    units = loaded.units(text)
    assert " ".join(units) == text and len(units) > 100
    whole, parts = alignment.Batch(loaded, [text]), alignment.Batch(loaded, units)
    assert whole.spans() == parts.spans()
    assert whole.group_texts()[0] == ";".join(parts.group_texts())
    assert whole.counts().sum(0).tolist() == parts.counts().sum(0).tolist()


def test_learning_anew_changes_nothing(spark, models):
    rows = [(i, f"word{i} and word{i + 1} again \U0001f600{i}") for i in range(40)]
    loaded = alignment.load(alignment.BYTE_BPE, alignment.PIECE_BPE)
    known, fresh = alignment.Known(loaded), []
    for _, text in rows:
        own = alignment.Known(loaded)
        places = known.places(loaded.units(text))
        again = own.places(loaded.units(text))
        assert [known.texts[p] for p in places] == [own.texts[p] for p in again]
        assert (known.counts()[places] == own.counts()[again]).all()
        for mine, other in zip(known.pairs_of(places), own.pairs_of(again)):
            assert mine.tolist() == other.tolist()
        fresh.append(len(own.place))
    assert len(known.place) < sum(fresh)


def test_long_text(spark):
    text = "a long text of many words with numbers 123 and ümläuts. " * 60_000  # over 3 MB
    (row,) = alignment.align(spark.createDataFrame([(1, text)], SCHEMA)).collect()
    assert row.n_links == row.n_a + row.n_b - row.n_groups and row.n_a > 500_000


def test_refinement_happens_where_spans_are_coarse():
    ends, refined = alignment.refine(np.array([2, 8, 8, 9]), np.array([2, 2, 4, 1]))
    assert ends.tolist() == [2, 4, 8, 9] and refined.tolist() == [False, True, False, False]


def test_spans_spell_the_text(models):
    loaded = alignment.load(alignment.BYTE_BPE, alignment.PIECE_BPE)
    text = "Ein Text mit 漢字, Zahlen 1234 und\nZeilen"
    groups = alignment.Batch(loaded, [text]).spans()
    for a, b in groups:
        assert loaded.a_ids.spell(a) == loaded.b_ids.spell(b)
    assert b"".join(loaded.a_ids.spell(a) for a, _ in groups) == (" " + text).encode()


def test_clashing_columns_do_not_matter(spark, models):
    extra = spark.createDataFrame(ODD[:5], SCHEMA).selectExpr("*", "1 as slab", "2 as pair", "3 as links", "'x' as pairs", "0 as n")
    got = sorted((tuple(r) for r in alignment.align(extra).drop("n_refined").collect()), key=str)
    assert got == brute(models, ODD[:5])
