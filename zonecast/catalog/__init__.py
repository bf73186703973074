"""Every inventory operator as a query on the driver tables."""

from zonecast.catalog import explorer, features, panel, scores, shapes, study, weather  # noqa: F401
from zonecast.catalog.registry import QUERIES

__all__ = ["QUERIES"]
