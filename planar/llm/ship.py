"""Making this package importable on the executors."""

from planar.plans.ship import ship_code

__all__ = ["ship_code"]
