"""DuckDB SQL for the registered queries, written independently of the Spark plans.

Modules load in the order in which their shared CTEs build on each other.
"""

from importlib import import_module

from zonecast.oracles.parts import SQL

for part in ("panel", "features", "study", "weather", "shapes", "explorer"):
    import_module(f"zonecast.oracles.{part}")

__all__ = ["SQL"]
