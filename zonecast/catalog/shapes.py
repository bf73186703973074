"""Queries of polygon neighbours on a grid of squares."""

from pyspark.sql import functions as F

from zonecast import bindings as b
from zonecast.catalog.registry import query
from zonecast.operators import adjacency

MINIMUM_M = 500.0


def pairs(spark, sf):
    return adjacency.boundary_pairs(b.squares(spark, sf), 1.0, MINIMUM_M)


def nodes(spark, sf):
    return adjacency.zone_nodes(b.squares(spark, sf), pairs(spark, sf), b.square_zones(spark, sf))


@query
def geometry_identity(spark, sf):
    """The lookup is the suppliers here, so most shapes lie outside it."""
    return adjacency.geometry_identity(b.squares(spark, sf), b.zones(spark, sf))


@query
def boundary_pairs(spark, sf):
    return pairs(spark, sf)


@query
def adjacency_edges(spark, sf):
    return adjacency.adjacency_edges(pairs(spark, sf))


@query
def zone_nodes(spark, sf):
    return nodes(spark, sf)


@query
def graph_summary(spark, sf):
    return adjacency.graph_summary(pairs(spark, sf), nodes(spark, sf))


@query
def isolated_zones(spark, sf):
    """Suppliers' squares that share no full side with a square to the right or above."""
    full = pairs(spark, sf).where(F.col("shared_boundary_m") > 999).select(
        "zone_id", F.col("zone_id").alias("neighbor_id")
    )
    return adjacency.isolated_zones(b.square_zones(spark, sf), full)


@query
def check_borough_agreement(spark, sf):
    """Customer squares against supplier boroughs of the same id."""
    return adjacency.check_borough_agreement(b.squares(spark, sf), b.zones(spark, sf))
