"""Payload health at scale: normalization, drift detection and replay as Spark jobs."""

__version__ = "0.1.0"
