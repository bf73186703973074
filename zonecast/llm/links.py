"""Connected components of a link table, by contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.llm.store import saved


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every id in ``links`` (``a``, ``b``): the smallest id reachable, itself included.

    In each round every id points at its smallest neighbour, pointers are followed twice, and links are
    rewritten between what they point at. Stars are gone after one round, and a round at least halves the ids
    that still have links. A hub meets its neighbours as partial minima and by joins that can be split, never
    as one list. No links give no rows.
    """
    links = saved(links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    ids = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    found = ids.select("id", F.col("id").alias("component"))
    while not links.isEmpty():
        ends = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = saved(ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")), "pointers")
        for _ in range(2):
            further = points.select(F.col("a").alias("_via"), F.col("to").alias("_to"))
            points = points.join(further, F.col("to") == F.col("_via")).select("a", F.col("_to").alias("to"))
        points = saved(points, "pointers")
        of_a = points.select("a", F.col("to").alias("_a"))
        of_b = points.select(F.col("a").alias("b"), F.col("to").alias("_b"))
        moved = links.join(of_a, "a").join(of_b, "b").where("_a != _b")
        links = saved(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "links")
        here = points.select(F.col("a").alias("component"), F.col("to").alias("_to"))
        found = saved(found.join(here, "component", "left").select("id", F.coalesce("_to", "component").alias("component")), "components")
    return found
