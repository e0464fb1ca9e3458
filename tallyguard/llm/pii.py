"""Personal data by anchor expansion.

An Aho-Corasick automaton walks every whole text once and reports anchors: at-signs, plus
signs, schemes, digits and identifier cues.  At each anchor a deterministic local parser
expands to the boundary of one candidate and checks it.  Parsers of one kind never go back
over what that kind has consumed, so the work is linear in the text.

Defined cases: a null or empty text has no spans; a null ``doc_id`` is carried through;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import flat_spans, map_slices, sha256_hex

#: The order of kinds that start at the same place; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "account", "login")
BASE = KINDS[:4]
CUES = ("account", "acct", "iban", "passport", "ssn", "social security")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOTTED = re.compile(r"[0-9.]+")
_ACCOUNT = re.compile(r"(?:[\x20]?(?:number|no\.?|nr\.?|id))?[\x20]?[:#=]?[\x20]?([A-Za-z]{0,2}[0-9](?:[\x20-]?[0-9]|[A-Za-z]){4,33})(?![A-Za-z0-9])", re.I | re.A)
_LOGIN = re.compile(r"[A-Za-z0-9._%+-]{1,256}:[^\s@/]{1,256}@[A-Za-z0-9.-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for anchor in ("@", "+", "://", *"0123456789", *CUES):
        found.add_word(anchor, anchor)
    found.make_automaton()
    return found


def _addresses(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Four dotted numbers each, taken from the left of a run of digits and dots."""
    found, group, at = [], [], start
    for part in text[start:end].split("."):
        if part:
            group.append((at, at + len(part)))
            if len(group) == 4:
                if all(e - s <= 3 or not text[s : e - 3].strip("0") for s, e in group) and all(
                    int(text[s:e][-3:]) <= 255 for s, e in group
                ):
                    found.append((group[0][0], group[3][1]))
                group = []
        else:
            group = []
        at += len(part) + 1
    return found


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str, int]]:
    """All spans of one text as (start, rank, kind, end)."""
    spans: list[tuple[int, int, str, int]] = []
    email_end = dotted_end = card_end = phone_end = account_end = login_end = 0

    def add(kind: str, start: int, end: int) -> None:
        spans.append((start, KINDS.index(kind), kind, end))

    lowered = text.lower()
    # Lower case can change the length of a text; cues are then looked for as written.
    for last, anchor in anchors.iter(lowered if len(lowered) == len(text) else text):
        at = last - len(anchor) + 1
        if anchor == "@":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                add("email", start, m.end())
                email_end = m.end()
        elif anchor == "+":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 10 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15:
                    add("phone", at, phone_end)
        elif anchor == "://":
            if at >= login_end and (m := _LOGIN.match(text, last + 1)):
                login_end = m.end()
                add("login", m.start(), login_end)
        elif len(anchor) == 1:
            if at >= dotted_end:
                dotted_end = _DOTTED.match(text, at).end()
                for start, end in _addresses(text, at, dotted_end):
                    add("ip", start, end)
            if at >= card_end and (m := _CARD.match(text, at)):
                card_end = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    add("card", at, card_end)
        elif at >= account_end and (m := _ACCOUNT.match(text, last + 1)):
            if sum(c.isdigit() for c in m.group(1)) >= 5:
                account_end = m.end(1)
                add("account", m.start(1), account_end)
    return spans


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, ``base_sha256``, ``spans`` for every row.

    Spans are ``kind:start:end`` in code points, end exclusive.  ``base_sha256`` covers the
    base kinds only; ``spans`` also holds accounts after a cue and logins in addresses.
    """

    def make():
        anchors = automaton()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: dict[str, list[int]] = {kind: [] for kind in BASE}
            digests, joined = [], []
            for text in batch.column(1).to_pylist():
                spans = find(text, anchors) if text else []
                base = [s for s in spans if s[2] in BASE]
                for kind in BASE:
                    counts[kind].append(sum(s[2] == kind for s in base))
                digests.append(sha256_hex(flat_spans(base).encode()))
                joined.append(flat_spans(spans))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests), pa.array(joined)],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

        return each

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return map_slices(docs.select("doc_id", "text"), make, schema)
