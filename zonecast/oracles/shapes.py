"""Check queries of polygon neighbours: the squares are boxes, so box arithmetic is enough."""

from zonecast.oracles.parts import check, checks, cte, r

cte(
    "x_boxes",
    """SELECT "LocationID" AS zone_id, "Borough" AS borough, "Zone", ("LocationID" % 100) * 1000.0::DOUBLE AS x0,
    ("LocationID" // 100) * 1000.0::DOUBLE + CASE WHEN ("LocationID" % 100) % 3 = 1 THEN 400.0::DOUBLE ELSE 0.0::DOUBLE END AS y0
  FROM x_lookup""",
)
cte(
    "x_pairs",
    """SELECT a.zone_id, b.zone_id AS neighbor_id,
    CASE WHEN abs(a.x0 - b.x0) = 1000 THEN greatest(0.0::DOUBLE, 1000 - abs(a.y0 - b.y0))
      ELSE greatest(0.0::DOUBLE, 1000 - abs(a.x0 - b.x0)) END AS shared
  FROM x_boxes a JOIN x_boxes b ON a.zone_id < b.zone_id AND abs(a.x0 - b.x0) <= 1000 AND abs(a.y0 - b.y0) <= 1000""",
)
check(
    "geometry_identity",
    """SELECT (SELECT count(*) FROM x_boxes)::BIGINT AS rows, (SELECT count(*) FROM x_boxes) AS unique_zone_ids,
    0::BIGINT AS duplicate_ids,
    (SELECT count(*) FROM x_zones WHERE zone_id NOT IN (SELECT zone_id FROM x_boxes)) AS missing_ids,
    (SELECT count(*) FROM x_boxes WHERE zone_id NOT IN (SELECT zone_id FROM x_zones)) AS outside_ids,
    0::BIGINT AS empty,
    (SELECT count(*) = 0 FROM x_zones WHERE zone_id NOT IN (SELECT zone_id FROM x_boxes)) AS one_to_one""",
)
check("boundary_pairs", f"SELECT zone_id, neighbor_id, {r('shared')} AS shared_boundary_m, shared >= 500 AS qualifies FROM x_pairs")
check("adjacency_edges", f"SELECT zone_id, neighbor_id, {r('shared')} AS shared_boundary_m, true AS qualifies FROM x_pairs WHERE shared >= 500")
cte(
    "x_nodes",
    """SELECT b.zone_id, b.borough, b."Zone", coalesce(d.n, 0)::INTEGER AS neighbor_count FROM x_boxes b LEFT JOIN (
    SELECT z, count(*) AS n FROM (SELECT zone_id AS z FROM x_pairs WHERE shared >= 500
      UNION ALL SELECT neighbor_id FROM x_pairs WHERE shared >= 500) GROUP BY 1) d ON d.z = b.zone_id""",
)
check("zone_nodes", 'SELECT zone_id, borough, "Zone", 1.0::DOUBLE AS area_km2, neighbor_count FROM x_nodes')
check(
    "graph_summary",
    """SELECT (SELECT count(*) FROM x_pairs WHERE shared >= 500)::BIGINT AS undirected_edges, (SELECT count(*) FROM x_pairs)::BIGINT AS touching_pairs,
    (SELECT count(*) FROM x_nodes WHERE neighbor_count = 0) AS isolated_zones, (SELECT max(neighbor_count) FROM x_nodes) AS max_degree""",
)
check(
    "isolated_zones",
    "SELECT zone_id FROM x_boxes WHERE zone_id NOT IN (SELECT zone_id FROM x_pairs WHERE shared > 999)",
)
check(
    "check_borough_agreement",
    checks(
        ("unknown_zone", "SELECT count(*) FROM x_boxes WHERE zone_id NOT IN (SELECT zone_id FROM x_zones)"),
        ("borough_mismatch", "SELECT count(*) FROM x_boxes b JOIN x_zones z ON z.zone_id = b.zone_id WHERE z.borough <> b.borough"),
    ),
)
