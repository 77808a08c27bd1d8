"""Spark-native discovery and resolution of near-duplicate media files."""

__all__ = ["session", "catalog"]
