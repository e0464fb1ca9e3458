"""Helpers that several training-data operators share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task turns into Python objects at a time.
SLICE_ROWS = 256

M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def map_slices(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | list[pa.RecordBatch]]],
    schema: str,
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """``mapInArrow`` over slices of ``rows`` rows; ``make`` builds the function once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = each(batch.slice(at, rows))
                yield from out if isinstance(out, list) else [out]

    return df.mapInArrow(run, schema)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``text`` as compressed UTF-8 in ``packed`` (null text: null).

    A shuffle that has to carry whole texts moves less than half of the bytes this way.
    """

    def make():
        compressor = zstandard.ZstdCompressor(level=1)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            blobs = [None if t is None else compressor.compress(t.encode()) for t in texts]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            return pa.RecordBatch.from_arrays([*kept, pa.array(blobs, pa.binary())], names=[*columns, "packed"])

        return each

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return map_slices(docs.select(*columns, "text"), make, f"{fields}, packed binary")


def unpacked(blob: bytes | None) -> bytes:
    return b"" if blob is None else zstandard.decompress(blob)


def with_row_key(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``row_key``, equal only for rows equal in both.

    Ids may repeat; joins back to texts use this key.
    """
    return docs.select(
        "doc_id", "text", F.xxhash64(F.col("doc_id"), F.col("text"), F.col("text").isNull()).alias("row_key")
    )


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat_spans(spans: list[tuple[int, int, str, int]]) -> str:
    """(start, rank of the kind, kind, end) as ``kind:start:end``, comma-joined in order."""
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))
