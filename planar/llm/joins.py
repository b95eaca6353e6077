"""Joins whose large side may have a third of its rows under one key."""

from pyspark.sql import DataFrame

from planar.plans import lookup
from planar.plans.lookup import HOT_ROWS

__all__ = ["HOT_ROWS", "attach", "fits_broadcast"]


def fits_broadcast(small: DataFrame) -> bool:
    """Whether ``attach`` sends ``small`` to every task."""
    return lookup.fits_broadcast(small)


def attach(rows: DataFrame, small: DataFrame, *options, **named) -> DataFrame:
    """``planar.plans.lookup.attach``."""
    return lookup.attach(rows, small, *options, fits=fits_broadcast, **named)
