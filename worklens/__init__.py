"""Spark-native audit analytics for public-works spending."""

from worklens.params import PUBLISHED, Params

__all__ = ["Params", "PUBLISHED"]
