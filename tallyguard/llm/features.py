"""Numeric features of texts, computed from the whole text.

A null text counts as empty.  All functions are pure and bounded by one text at a time.
"""

from __future__ import annotations

from operator import eq

import numpy as np

BYTES = 256


def byte_shares(texts: list[str | None]) -> np.ndarray:
    """Square roots of the shares of the 256 byte values."""
    out = np.zeros((len(texts), BYTES), np.float32)
    for row, text in zip(out, texts, strict=True):
        if text:
            counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=BYTES)
            row[:] = np.sqrt(counts / counts.sum())
    return out


def shape(text: str | None) -> list[float]:
    """Lengths, repetition and line structure of one text."""
    data = (text or "").encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    distinct, distinct_lines = len(set(words)), len(set(lines))
    return [
        np.log1p(len(data)),
        np.log1p(len(words)),
        len(data) / n_words / 10,
        distinct / n_words,
        distinct / np.sqrt(n_words) / 10,
        sum(map(eq, words, words[1:])) / n_words,
        sum(map(eq, words, words[2:])) / n_words,
        distinct_lines / n_lines,
        np.log1p(n_lines),
        np.log1p(len(lines) - distinct_lines),
        n_words / n_lines / 50,
        max(map(len, words), default=0) / 50,
        sum(x.endswith((b".", b"!", b"?")) for x in lines) / n_lines,
        len(words) == 0,
        len(words) < 5,
        len(words) < 20,
    ]


def quality_features(texts: list[str | None]) -> np.ndarray:
    shapes = np.array([shape(t) for t in texts], np.float32).reshape(len(texts), -1)
    return np.hstack([byte_shares(texts), shapes]) if len(texts) else np.zeros((0, BYTES + 16), np.float32)


class Scaler:
    """Centres and scales columns as in the rows it was made from; far values are clipped."""

    def __init__(self, rows: np.ndarray):
        self.mean, self.width = rows.mean(0), rows.std(0) + 1e-3

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.width, -8, 8)
