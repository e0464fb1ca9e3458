"""Quality by positive-unlabelled learning.

A logistic model over text features minimises the non-negative unbiased risk

    prior * E_pos[loss(+1)] + max(0, E_unl[loss(-1)] - prior * E_pos[loss(-1)])

from trusted positives (labelled 1), unlabelled web text, and a class prior that is estimated
as the share of positives among all labelled rows of the training folds.  Positives and
unlabelled texts are bounded samples, chosen by a hash of the id; counts, the prior and the
scores cover all rows.  Rows of the held-out fold take no part in training.

Defined cases: null and empty texts get a score like any text; a null ``doc_id`` is never
held out; ids that are labelled repeatedly are positive if all their labels are 1; without
positives or without texts every score is the prior (0.5 if there are no labels); other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_slices
from .features import BYTES, Scaler, quality_features

#: Bounds of the training samples.
POSITIVES, UNLABELLED = 10_000, 20_000
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
_SPACE = 2**32


@dataclass(frozen=True)
class Model:
    scaler: Scaler | None
    weights: np.ndarray | None
    bias: float

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), _sigmoid(self.bias))
        rows = self.scaler(quality_features(texts)).astype(np.float64)
        # Row by row, so that a score does not depend on the rows beside it.
        return np.round(_sigmoid((rows * self.weights).sum(1) + self.bias), 6)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    fold = F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % FOLDS
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def _chosen(rows: DataFrame, bound: int) -> DataFrame:
    """About ``bound`` ids by hash, all of them if there are fewer."""
    total = rows.count()
    share = min(1.0, bound / max(1, total))
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(_SPACE)) < int(share * _SPACE) + 1)


def _features(docs: DataFrame, bound: int) -> np.ndarray:
    """Features of one row per id, at most twice ``bound`` rows, in the order of ids."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = quality_features(batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "row"]
            )

        return each

    made = map_slices(docs.select("doc_id", "text"), make, "doc_id long, row binary")
    table = made.groupBy("doc_id").agg(F.min("row").alias("row")).limit(2 * bound).toArrow()
    return _matrix(table.column("doc_id"), table.column("row"))


def _matrix(ids: pa.ChunkedArray, rows: pa.ChunkedArray) -> np.ndarray:
    """The rows of features in the order of ``ids``; their bytes are read where they lie, so the driver holds them twice at most."""
    out = np.zeros((len(ids), BYTES + 16), np.float32)
    place = np.empty(len(ids), np.int64)
    place[np.argsort(ids.to_numpy())] = np.arange(len(ids))
    done = 0
    for chunk in rows.cast(pa.binary()).chunks:
        if len(chunk):
            start = np.frombuffer(chunk.buffers()[1], np.int32, 1, 4 * chunk.offset)[0]
            own = np.frombuffer(chunk.buffers()[2], np.float32, len(chunk) * out.shape[1], start)
            out[place[done : done + len(chunk)]] = own.reshape(len(chunk), -1)
        done += len(chunk)
    return out


def descend(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk with logistic loss; full batches, so no random numbers."""
    width = positive.shape[1]
    theta, mean, square = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        margin_p = positive @ theta[:-1] + theta[-1]
        margin_u = unlabelled @ theta[:-1] + theta[-1]

        def slope(rows: np.ndarray, residual: np.ndarray) -> np.ndarray:
            return np.append(rows.T @ residual, residual.sum()) / len(rows)

        as_negative = np.logaddexp(0, margin_u).mean() - prior * np.logaddexp(0, margin_p).mean()
        up = prior * slope(positive, _sigmoid(margin_p) - 1)
        down = slope(unlabelled, _sigmoid(margin_u)) - prior * slope(positive, _sigmoid(margin_p))
        gradient = up + down if as_negative >= 0 else -down
        gradient[:-1] += 1e-4 * theta[:-1]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        rate = 0.05 if step < 0.75 * steps else 0.01
        theta -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    trusted = (
        labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    prior = trusted.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    prior = 0.5 if prior is None else min(max(prior, 1e-3), 1 - 1e-3)
    web = docs.select("doc_id", "text").where(~held_out() & F.col("doc_id").isNotNull())
    # The chosen ids are bounded by the parameter, so they can be broadcast.
    ids = _chosen(trusted.where(F.col("quality") == 1).select("doc_id"), positives).limit(2 * positives)
    positive = _features(web.join(F.broadcast(ids), "doc_id"), positives)
    background = _features(_chosen(web, unlabelled), unlabelled)
    if not len(positive) or not len(background):
        return Model(None, None, float(np.log(prior / (1 - prior))))
    pa.default_memory_pool().release_unused()
    scaler = Scaler(background)
    positive, background = scaler(positive), scaler(background)  # the unscaled rows go
    weights, bias = descend(positive, background, prior)
    return Model(scaler, weights.astype(np.float64), bias)


def score(model: Model, text: str | Column = "text") -> Column:
    """The model as a column over texts."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [model(texts.iloc[at : at + 512].tolist()) for at in range(0, len(texts), 512)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return scored(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (6 decimals), ``predicted`` for every row."""
    scored = docs.select("doc_id", held_out().alias("held_out"), score(fit(docs, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with their columns."""
    return docs.where(score(fit(docs, labels), "text") >= THRESHOLD)
