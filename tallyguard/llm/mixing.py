"""Mixing domains to target weights with soft membership.

A softmax model, fitted on a labelled table, gives every document a posterior over domains.
Rates ``r >= 0`` per document are then fitted so that the expected tokens of each domain,
``sum(r * tokens * posterior)``, meet the targets: projected gradient descent on the least
squares of the misses, started at one, so that rates move no further than they must.  The
gradient of a document depends on its posterior only; an iteration is one distributed sum of
as many numbers as there are domains, and rates are a column expression over the steps so far.

The misses are measured in the inverse of ``H = sum(tokens * posterior * posterior')``, and a
rate moves in proportion to its posterior; in that metric the curvature is 1, so the step of 1
always descends.

Defined cases: null and empty texts have no tokens and keep a rate; rows with a null domain or
text teach nothing; without labelled rows or without tokens every rate is 1; a domain
with a target but no tokens cannot be met and is left out of the sum; documents of a domain without a
target (the likeliest one counts, the first of equally likely ones) keep the rate 1 and count for nothing;
repeated rows count as often as they occur; other columns are kept by :func:`mix` and ignored by
:func:`rates`, which reports the largest remaining miss, as a share of all tokens, as ``miss``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import map_slices
from .features import Scaler, byte_shares

#: Bound of the labelled sample.
LABELLED = 20_000
#: The descent ends when no domain misses its tokens by more than this share of all, or after so many steps;
#: what it still misses then is reported.
TOLERANCE, MAX_STEPS = 1e-9, 30
_SPACE = 2**32


@dataclass(frozen=True)
class Classifier:
    domains: list[str]
    scaler: Scaler
    weights: np.ndarray

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        rows = self.scaler(byte_shares(texts)).astype(np.float64)
        logits = np.stack([(rows * w[:-1]).sum(1) + w[-1] for w in self.weights.T], axis=1)
        odds = np.exp(logits - logits.max(1, keepdims=True))
        return np.round(odds / odds.sum(1, keepdims=True), 9)


def fit_classifier(labelled: DataFrame, bound: int = LABELLED, steps: int = 200) -> Classifier | None:
    """Softmax regression on ``labelled(doc_id, text, domain)``, at most about ``bound`` rows by hash."""
    known = labelled.select("doc_id", "text", "domain").where(F.col("text").isNotNull() & F.col("domain").isNotNull())
    share = min(1.0, bound / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit("domain")), F.lit(_SPACE)) < int(share * _SPACE) + 1)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = byte_shares(batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([r.tobytes() for r in rows], pa.binary())],
                names=["doc_id", "domain", "row"],
            )

        return each

    made = map_slices(sample, make, "doc_id long, domain string, row binary")
    # A repeated id teaches once.
    made = made.groupBy("doc_id").agg(F.min(F.struct("domain", "row")).alias("one")).select("doc_id", "one.*")
    table = made.limit(2 * bound).toArrow().sort_by("doc_id")
    if not table.num_rows:
        return None
    rows = np.array([np.frombuffer(r, np.float32) for r in table.column("row").to_pylist()])
    names = table.column("domain").to_pylist()
    domains = sorted(set(names))
    scaler = Scaler(rows)
    inputs = np.hstack([scaler(rows), np.ones((len(rows), 1), np.float32)]).astype(np.float64)
    truth = np.array([[n == d for d in domains] for n in names], np.float64)
    weights, mean, square = (np.zeros((inputs.shape[1], len(domains))) for _ in range(3))
    for step in range(1, steps + 1):
        logits = inputs @ weights
        odds = np.exp(logits - logits.max(1, keepdims=True))
        gradient = inputs.T @ (odds / odds.sum(1, keepdims=True) - truth) / len(rows) + 1e-3 * weights
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        weights -= 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Classifier(domains, scaler, weights)


def posteriors(model: Classifier, text: str | Column = "text") -> Column:
    """``struct(tokens, p)``: white-space tokens of the text and its posterior."""

    @F.pandas_udf("struct<tokens: long, p: array<double>>")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            listed = texts.tolist()
            p = [x for at in range(0, len(listed), 512) for x in model(listed[at : at + 512])]
            yield pd.DataFrame({"tokens": [len((t or "").encode().split()) for t in listed], "p": p})

    return judged(text)


def _rate(steps: list[np.ndarray], p: str | Column = "p") -> Column:
    """The rate after projected steps from one."""
    p = F.col(p) if isinstance(p, str) else p
    if not steps:
        return F.lit(1.0)
    moves = F.array(*(F.array(*(F.lit(float(g)) for g in step)) for step in steps))

    def descend(rate: Column, step: Column) -> Column:
        move = sum((p[i] * step[i] for i in range(len(steps[0]))), F.lit(0.0))
        return F.greatest(F.lit(0.0), rate - move)

    return F.aggregate(moves, F.lit(1.0), descend)


def solve(judged: DataFrame, targets: np.ndarray, total: float | None = None) -> list[np.ndarray]:
    """The steps of :func:`descent`."""
    return descent(judged, targets, total)[0]


def descent(judged: DataFrame, targets: np.ndarray, total: float | None = None) -> tuple[list[np.ndarray], float]:
    """Steps that bring ``judged(tokens, p)`` to the targets, which follow the domains, and the remaining miss.

    ``total`` is the number of tokens to aim at.  By default it is the least for which every
    domain is repeated rather than thinned out, so that no document has to go.
    """
    n = len(targets)

    def sums(values: list[Column]) -> np.ndarray:
        row = judged.agg(*(F.sum(v).alias(f"s{i}") for i, v in enumerate(values))).first()
        return np.array([x or 0.0 for x in row])

    p = [F.col("p")[i] for i in range(n)]
    first = sums([F.col("tokens") * a for a in p] + [F.col("tokens") * a * b for a in p for b in p])
    have, curvature = first[:n], first[n:].reshape(n, n)
    if not have.sum():
        return [], 0.0
    targets = np.where(have > 0, targets, 0.0)
    if not targets.sum():
        return [], 0.0
    targets = targets / targets.sum()
    goal = targets * (total if total is not None else max(h / t for h, t in zip(have, targets, strict=True) if t > 0))
    inverse = np.linalg.pinv(curvature)
    while True:
        steps: list[np.ndarray] = []
        at = have
        while len(steps) < MAX_STEPS and np.abs(at - goal).max() > TOLERANCE * goal.sum():
            steps.append(inverse @ (at - goal))
            at = sums([_rate(steps) * F.col("tokens") * a for a in p])
        miss = float(np.abs(at - goal).max() / goal.sum())
        if total is not None or not steps:
            return steps, miss
        least = judged.agg(F.min(_rate(steps))).first()[0]
        if least >= 1 or least <= 0:
            return steps, miss
        goal = goal / least * (1 + 1e-6)  # posteriors overlap a little: aim as much higher


def copies(rate: Column, *key: str) -> Column:
    """A whole number of copies with mean ``rate``, fixed by a hash of the key."""
    draw = F.pmod(F.xxhash64(*key, F.lit("copies")), F.lit(_SPACE)) / _SPACE
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def _likeliest(model: Classifier, p: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, model.domains)), F.array_position(p, F.array_max(p)).cast("int"))


def _rated(judged: DataFrame, model: Classifier, targets: dict[str, float], column: str) -> tuple[Column, float]:
    """The rate of each row of ``judged``, whose ``column`` has tokens and posteriors, and the remaining miss."""
    aimed = [i for i, d in enumerate(model.domains) if d in targets]
    if not aimed:
        return F.lit(1.0), 0.0
    counts = _likeliest(model, F.col(f"{column}.p")).isin([model.domains[i] for i in aimed])
    p = F.array(*(F.col(f"{column}.p")[i] for i in aimed))
    seen = judged.select(F.when(counts, F.col(f"{column}.tokens")).otherwise(0).alias("tokens"), p.alias("p"))
    steps, miss = descent(seen.where("tokens > 0"), np.array([targets[model.domains[i]] for i in aimed]))
    return F.when(counts, _rate(steps, p)).otherwise(1.0), miss


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``domain`` (likeliest), ``posterior``, ``rate``, ``copies``, ``miss`` for every row."""
    model = fit_classifier(labelled)
    if model is None:
        plain = docs.select("doc_id", F.lit(None).cast("long").alias("n_tokens"), F.lit(None).cast("string").alias("domain"))
        plain = plain.select("*", F.array().cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"))
        return plain.withColumn("miss", F.lit(None).cast("double"))
    judged = cut(docs.select("doc_id", posteriors(model).alias("j")), "domain-posteriors")
    rate, miss = _rated(judged, model, targets, "j")
    best = _likeliest(model, F.col("j.p")).alias("domain")
    rated = judged.select("doc_id", F.col("j.tokens").alias("n_tokens"), best, F.col("j.p").alias("posterior"), rate.alias("rate"))
    return rated.withColumn("copies", copies(F.col("rate"), "doc_id")).withColumn("miss", F.lit(miss))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """``docs`` with ``rate`` and ``copies``; rows whose rate gives no copy go.

    Columns of these names in ``docs`` are replaced.
    """
    plain = docs.drop("rate", "copies")
    model = fit_classifier(labelled)
    if model is None:
        return plain.withColumn("rate", F.lit(1.0)).withColumn("copies", F.lit(1).cast("long"))
    name = "_judged"
    while name in {c.lower() for c in plain.columns}:
        name += "_"
    judged = cut(plain.select("*", posteriors(model).alias(name)), "mixed-documents")
    rate, _ = _rated(judged, model, targets, name)
    rated = judged.select(*plain.columns, rate.alias("rate"))
    return rated.withColumn("copies", copies(F.col("rate"), "doc_id")).where(F.col("copies") > 0)
