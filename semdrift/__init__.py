"""Semantic drift analytics over captured chat traffic, on Spark DataFrames."""

from semdrift.config import DetectorConfig

__all__ = ["DetectorConfig"]
