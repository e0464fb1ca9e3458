"""Payload shapes per provider."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..session import cut, small_enough

# Distinct shape keys that may be broadcast; above it paths are read row by row.
MAX_BROADCAST_SHAPES = 100_000


def with_paths(df: DataFrame) -> DataFrame:
    """Add the path list and its text for a shape_key column; for distinct shapes."""
    return df.withColumn("paths", F.expr(paths.paths_of_key("shape_key"))).withColumn(
        "fingerprint", F.expr(paths.fingerprint_text("paths"))
    )


def attach_paths(df: DataFrame) -> DataFrame:
    """Add path list and fingerprint to a large table that has a shape_key column."""
    keys = cut(with_paths(df.select("shape_key").distinct()), "shapes")
    if small_enough(keys, MAX_BROADCAST_SHAPES):
        return df.join(F.broadcast(keys), "shape_key", "left")
    return with_paths(df)


def payload_paths(df: DataFrame, payload: str) -> DataFrame:
    """Per row, the payload's sorted path set and fingerprint, read row by row."""
    return (
        df.withColumn("_doc", F.expr(f"try_parse_json({payload})"))
        .withColumn("paths", F.expr(paths.path_set("_doc")))
        .withColumn("fingerprint", F.expr(paths.fingerprint_text("paths")))
        .drop("_doc")
    )


def known_shapes(corpus: DataFrame, group: str = "provider", order: str = "seq") -> DataFrame:
    """Per provider and fingerprint: first position and number of stored payloads.

    Grouped by the cheap key first; paths are read for the few remaining rows only.
    """
    keys = corpus.groupBy(group, "shape_key").agg(F.min(order).alias("first_seq"), F.count("*").alias("n"))
    return with_paths(keys).groupBy(group, "fingerprint").agg(
        F.min("first_seq").alias("first_seq"),
        F.sum("n").cast("bigint").alias("n"),
        F.first("paths").alias("paths"),
        F.min_by("shape_key", "first_seq").alias("shape_key"),
    )


def known_paths(shapes: DataFrame, group: str = "provider", order: str = "first_seq") -> DataFrame:
    """Union of the paths of all shapes of a provider, with where each was first stored."""
    return (
        shapes.select(group, F.explode(F.split("fingerprint", "\n")).alias("path"), order)
        .groupBy(group, "path")
        .agg(F.min(order).alias("since"))
    )


def dominant_shape(shapes: DataFrame, group: str = "provider") -> DataFrame:
    """The shape with the most stored payloads per provider; ties go to the smaller text."""
    order = F.struct(-F.col("n"), "fingerprint")
    return shapes.groupBy(group).agg(
        F.min_by("fingerprint", order).alias("fingerprint"),
        F.min_by("paths", order).alias("paths"),
        F.min_by("shape_key", order).alias("shape_key"),
        F.max("n").alias("n"),
    )
