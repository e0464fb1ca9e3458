"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions, once per curve, by random orthonormal directions with a
random shift, and ordered by their place on a Hilbert curve.  The orders are made by range
partitioning in Spark.  A query looks at the rows within a window of places around its own on every
curve; the finds of all windows are merged and ranked by their exact distance.

How wide the windows are is measured, not guessed: for a bounded sample of queries the nearest rows
are found by comparison with all rows, and the window is the least one that holds ``RECALL`` of these
on at least one curve.  On data with structure it is small; on directions without any (the worst case
for every index of this kind) it is a share of the table, and the work grows with its square.

Defined results
---------------
Vectors that are null, empty, zero, or hold a null or non-finite component, and rows without an id,
take no part; neither do vectors whose length is not the most frequent one (the greater on a tie).
Rows equal in id and vector count once.  Rows with one id and different vectors are rows of their own:
a query then meets its other rows, but never itself.  Equal vectors are one point on the curves,
however many there are, and come back as rows with the smallest ids first, so a large group of copies
neither fills a window nor a task.  Ties in distance go to the smaller id.  Fewer rows than asked for
are all returned; an empty table gives none.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ordering import numbered

CURVES = 8
#: Dimensions of a projection, and bits of a cell's place in each.
PROJECTED = 8
CELL_BITS = 7
#: Rows that projections are scaled by, and queries that windows are measured with.
SCALE_SAMPLE = 4096
QUERY_SAMPLE = 200
#: Share of the sample's nearest rows that the windows have to hold.
RECALL = 0.96
#: The least window, in places to both sides: a small table is compared as a whole.
LEAST_WINDOW = 128
#: Places of a curve that one task compares at a time.
BLOCK = 2048
#: Rows that a task compares with the sample at a time.
SLICE = 4096


def _points(vectors: DataFrame) -> DataFrame:
    """One row per (``vec_id``, ``point``): a point is a distinct vector, named by a 128-bit hash."""
    v = F.col("embedding").cast("array<double>")
    usable = (
        F.col("vec_id").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where(usable)
    lengths = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1)
    halves = [F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64("v"), F.xxhash64(F.lit(1), "v"))]
    rows = rows.withColumn("length", F.size("v")).join(F.broadcast(lengths.select("length")), "length")
    return rows.select("vec_id", F.unhex(F.concat(*halves)).alias("point"), "v")


def hilbert_places(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of cells (rows of whole numbers below ``2**bits``) on a Hilbert curve.

    Skilling's transposition: undo the rotations and flips of each level from the top, Gray-decode,
    then interleave the bits of all dimensions.  ``bits`` times dimensions is 63 at most.
    """
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        below = level - 1
        for d in range(dims):
            turned = (x[d] & level) != 0
            swap = np.where(turned, 0, (x[0] ^ x[d]) & below)
            x[0] = np.where(turned, x[0] ^ below, x[0] ^ swap)
            x[d] ^= swap
        level >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        flip ^= np.where((x[-1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= flip
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            place = (place << 1) | ((x[d] >> bit) & 1)
    return place


class Curves:
    """Projections, scales and shifts, fitted on a bounded sample of points."""

    def __init__(self, sample: np.ndarray, curves: int, seed: int = 13):
        random = np.random.default_rng(seed)
        length = sample.shape[1]
        self.dims = min(PROJECTED, length)
        self.middle = sample.mean(0)
        self.axes, self.low, self.width = [], [], []
        for _ in range(curves):
            axes = np.linalg.qr(random.standard_normal((length, self.dims)))[0]
            seen = (sample - self.middle) @ axes
            # Twice the spread of the sample, moved by up to one spread; what lies outside keeps to the edge.
            spread = max(float(np.ptp(seen, axis=0).max()), 1e-12)
            self.axes.append(axes)
            self.width.append(2 * spread)
            self.low.append(seen.min(0) - random.random(self.dims) * spread)

    def places(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Per curve, the places of ``vectors``."""
        out, cells = [], 1 << CELL_BITS
        for axes, low, width in zip(self.axes, self.low, self.width):
            at = ((vectors - self.middle) @ axes - low) / width
            out.append(hilbert_places(np.clip(np.floor(at * cells), 0, cells - 1).astype(np.int64), CELL_BITS))
        return out


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _squares(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squared distances by a matrix product; close ones are off by rounding only."""
    return (queries**2).sum(1)[:, None] + (rows**2).sum(1)[None, :] - 2 * queries @ rows.T


def _nearest(points: DataFrame, sample: list, k: int) -> DataFrame:
    """The ``k`` nearest points of each sampled query among all points, by comparison with all."""
    names = [bytes(r.point) for r in sample]
    queries = np.array([r.v for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                far = _squares(queries, _matrix(part.column("v")))
                own = part.column("point").to_pylist()
                place = {name: i for i, name in enumerate(own)}
                for q, name in enumerate(names):
                    if name in place:
                        far[q, place[name]] = np.inf
                least = np.argsort(far, axis=1, kind="stable")[:, :k]
                q = np.repeat(np.arange(len(names)), least.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[i] for i in q], pa.binary()),
                        pa.array([own[i] for i in least.ravel()], pa.binary()),
                        pa.array(np.take_along_axis(far, least, 1).ravel()),
                    ],
                    names=["query", "point", "far"],
                )

    near = points.select("point", "v").mapInArrow(run, "query binary, point binary, far double")
    order = Window.partitionBy("query").orderBy("far", "point")
    return near.where(F.col("far") != float("inf")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _window(near: DataFrame, places: DataFrame) -> int:
    """The least window that holds ``RECALL`` of the sample's nearest points on some curve."""
    near = near.select("query", "point")  # at most QUERY_SAMPLE times k rows
    names = near.select("point").union(near.select("query")).distinct()
    own = cut(places.join(F.broadcast(names), "point").select("curve", "point", "idx"), "sample_places")
    apart = (
        near.join(own.select("curve", F.col("point").alias("query"), F.col("idx").alias("at")), "query")
        .join(own, ["curve", "point"])
        .groupBy("query", "point")
        .agg(F.min(F.abs(F.col("idx") - F.col("at"))).alias("apart"))
    )
    need = apart.agg(F.percentile("apart", RECALL)).first()[0]
    return max(int(np.ceil(need or 0)) + 1, LEAST_WINDOW)


def _exact_squares(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squared distances summed in order, so equal ones come out equal."""
    total = np.zeros(len(rows))
    for q, column in zip(query, rows.T):
        total += (q - column) * (q - column)
    return total


def _compare(k: int, window: int):
    """Per block of a curve: the ``k`` nearest points of each query, of those within its window."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        vectors, at = _matrix(rows.column("v")), rows.column("idx").to_numpy()
        ids, names = rows.column("first_id").to_numpy(), rows.column("point").to_pylist()
        owners, points, first, far = [], [], [], []
        # As many queries at a time as keep the matrix small.
        for low in range(0, queries.num_rows if rows.num_rows else 0, 256):
            part = queries.slice(low, 256)
            own, centre, vector = part.column("query").to_pylist(), part.column("centre").to_numpy(), _matrix(part.column("q"))
            apart = np.abs(centre[:, None] - at[None, :])
            rough = _squares(vector, vectors)
            rough[(apart > window) | (apart == 0)] = np.inf
            # The matrix product rounds: what may still be among the k nearest is measured exactly.
            slack = 1e-9 * ((vector**2).sum(1) + (vectors**2).sum(1).max())
            kth = np.partition(rough, k - 1, axis=1)[:, k - 1] if rough.shape[1] >= k else np.full(len(own), np.inf)
            for i, name in enumerate(own):
                near = np.flatnonzero(np.isfinite(rough[i]) & (rough[i] <= kth[i] + slack[i]))
                exact = _exact_squares(vector[i], vectors[near])
                best = np.lexsort((ids[near], exact))[:k]
                owners += [name] * len(best)
                points += [names[j] for j in near[best]]
                first += ids[near[best]].tolist()
                far += exact[best].tolist()
        columns = [pa.array(owners, pa.binary()), pa.array(points, pa.binary()), pa.array(first, pa.int64()), pa.array(far, pa.float64())]
        return pa.Table.from_arrays(columns, names=["query", "point", "first_id", "far"])

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, curves: int = CURVES) -> DataFrame:
    """The ``k`` nearest rows found for each row of ``vectors`` (``vec_id``, ``embedding``) that is a query.

    ``is_query`` is a condition on ``vec_id``.
    """
    rows = _points(vectors)
    points = cut(
        rows.groupBy("point").agg(
            F.first("v").alias("v"), F.min("vec_id").alias("first_id"), F.bool_or(is_query).alias("is_query")
        ),
        "points",
    )
    ids = cut(rows.groupBy("vec_id", "point").agg(F.first(is_query).alias("is_query")), "ids")
    by_hash = points.orderBy(F.xxhash64("point"), "point")
    sample = by_hash.select("v").limit(SCALE_SAMPLE).collect()
    if not sample:
        return _ranked(ids, points, None, k)

    fitted = Curves(np.array([r.v for r in sample]), curves)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for curve, place in enumerate(fitted.places(_matrix(batch.column("v")))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(place), curve, np.int32)), pa.array(place), batch.column("point")],
                    names=["curve", "place", "point"],
                )

    placed = points.select("point", "v").mapInArrow(locate, "curve int, place bigint, point binary")
    places = cut(numbered(placed, ["curve"], ["place", "point"]).drop("place", "n"), "places")

    asked = by_hash.where("is_query").select("point", "v").limit(QUERY_SAMPLE).collect()
    if not asked:
        return _ranked(ids, points, None, k)
    window = _window(_nearest(points, asked, k), places)

    block = F.floor(F.col("idx") / BLOCK)
    on_curves = places.join(points, "point")
    dealt = on_curves.select("curve", block.alias("block"), "idx", "point", "first_id", "v")
    reach = F.sequence(
        F.floor(F.greatest(F.col("idx") - window, F.lit(0)) / BLOCK), F.floor((F.col("idx") + window) / BLOCK)
    )
    looking = on_curves.where("is_query").select(
        F.col("curve").alias("line"),
        F.explode(reach).alias("part"),
        F.col("idx").alias("centre"),
        F.col("point").alias("query"),
        F.col("v").alias("q"),
    )
    found = (
        dealt.groupBy("curve", "block")
        .cogroup(looking.groupBy("line", "part"))
        .applyInArrow(_compare(k, window), "query binary, point binary, first_id bigint, far double")
    )
    # Windows of several curves find the same pair.
    merged = found.groupBy("query", "point").agg(F.min("first_id").alias("first_id"), F.min("far").alias("far"))
    order = Window.partitionBy("query").orderBy("far", "first_id", "point")
    close = merged.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    return _ranked(ids, points, close.select("query", "point", "far"), k)


def _ranked(ids: DataFrame, points: DataFrame, close: DataFrame | None, k: int) -> DataFrame:
    """Rows from points: the point of a query itself, and the points found, with their smallest ids."""
    pairs = points.where("is_query").select(F.col("point").alias("query"), "point", F.lit(0.0).alias("far"))
    if close is not None:
        pairs = pairs.unionByName(close)
    # More than k + 1 rows of one point are never needed: the query itself and its k nearest.
    first = Window.partitionBy("point").orderBy("vec_id")
    few = ids.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1).select("vec_id", "point")
    order = Window.partitionBy("query").orderBy("far", "vec_id", "point")
    best = pairs.join(few, "point").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    lists = best.groupBy("query").agg(
        F.array_sort(F.collect_list(F.struct("nth", "vec_id", "point", F.sqrt("far").alias("score")))).alias("best")
    )
    asked = ids.where("is_query").select(F.col("vec_id").alias("query_id"), F.col("point").alias("query"))
    others = F.filter("best", lambda b: ~((b["vec_id"] == F.col("query_id")) & (b["point"] == F.col("query"))))
    return (
        asked.join(lists, "query")
        .select("query_id", F.posexplode(F.slice(others, 1, k)).alias("pos", "hit"))
        .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
    )
