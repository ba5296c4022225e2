"""docstrata: a Spark-native analytics engine for structured document corpora."""

from .ship import ship

__all__ = ["ship"]
