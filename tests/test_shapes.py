import math

import pytest

from zonecast.operators import adjacency


def squares(spark, degrees=0.0, n=5):
    """An n x n grid of 1000-unit squares, the last one lifted by 400."""
    turn = math.radians(degrees)
    rows = []
    for zone in range(n * n):
        cx, cy = zone % n, zone // n
        lift = 400.0 if zone == n * n - 1 else 0.0
        for seq, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))):
            x, y = (cx + dx) * 1000.0, (cy + dy) * 1000.0 + lift
            rows.append((zone, "Queens", 0, seq, x * math.cos(turn) - y * math.sin(turn), x * math.sin(turn) + y * math.cos(turn)))
    return spark.createDataFrame(rows, "zone_id int, borough string, ring int, seq int, x double, y double")


@pytest.mark.parametrize("degrees", [0.0, 17.3, 30.0, 45.0, 90.0, 179.99999])
def test_shared_boundaries_in_any_direction(spark, degrees):
    pairs = adjacency.boundary_pairs(squares(spark, degrees), 1.0, 1.0).collect()
    lengths = sorted(round(r.shared_boundary_m, 3) for r in pairs)
    # 24 has lost its lower side and half of its corner contact, and keeps 600 of its left side.
    assert lengths.count(1000.0) == 38 and lengths.count(600.0) == 1
    assert all(length in (0.0, 600.0, 1000.0) for length in lengths)
    assert {(r.zone_id, r.neighbor_id) for r in pairs if r.shared_boundary_m == 0} >= {(0, 6), (1, 5)}


def test_corner_on_an_edge_touches(spark):
    rows = [(1, 0, i, x, y) for i, (x, y) in enumerate([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)])]
    rows += [(2, 0, i, x, y) for i, (x, y) in enumerate([(5, 10), (8, 14), (2, 14), (5, 10)])]
    frame = spark.createDataFrame([(z, "Q", r, s, float(x), float(y)) for z, r, s, x, y in rows], "zone_id int, borough string, ring int, seq int, x double, y double")
    row = adjacency.boundary_pairs(frame).first()
    assert (row.zone_id, row.neighbor_id, row.shared_boundary_m, row.qualifies) == (1, 2, 0.0, False)


def test_nodes_areas_and_identity(spark):
    frame = squares(spark, 30.0)
    zones = spark.createDataFrame([(z, "Queens", f"z{z}") for z in range(26)], "zone_id int, borough string, Zone string")
    pairs = adjacency.boundary_pairs(frame)
    nodes = {r.zone_id: r for r in adjacency.zone_nodes(frame, pairs, zones).collect()}
    assert nodes[12].neighbor_count == 4 and nodes[12].area_km2 == pytest.approx(1.0)
    assert nodes[25].neighbor_count == 0
    row = adjacency.geometry_identity(frame, zones).first()
    assert (row.unique_zone_ids, row.missing_ids, row.one_to_one) == (25, 1, False)


def test_a_diagonal_takes_only_the_cells_that_it_crosses(spark):
    rows = [(1, 0, 0, 0.0, 0.0, 1000.0, 1000.5), (2, 0, 0, 0.0, 900.0, 1000.0, 0.0), (3, 0, 0, 5.5, 0.0, 5.5, 40.0), (4, 0, 0, 0.0, 7.0, 60.0, 7.0)]
    segments = spark.createDataFrame(rows, "zone_id int, ring int, seq int, x1 double, y1 double, x2 double, y2 double")
    made = adjacency.in_cells(segments, 1.0, 0.01)
    counts = {r.zone_id: r["count"] for r in made.groupBy("zone_id").count().collect()}
    assert counts[1] < 4000 and counts[2] < 4000 and counts[3] < 90 and counts[4] < 130
    held = {(r.zone_id, r.cx, r.cy) for r in made.collect()}
    for zone, _, _, x1, y1, x2, y2 in rows:
        for i in range(5001):
            t = i / 5000
            assert (zone, int((x1 + t * (x2 - x1)) // 1), int((y1 + t * (y2 - y1)) // 1)) in held


def zigzag(zone, n, side):
    """A ring whose lower edge is a line of ``n`` short pieces, shared with the ring on its other side."""
    line = [(i * 0.02, 0.0) for i in range(n + 1)]
    return [(zone, "Q", 0, i, x, y) for i, (x, y) in enumerate([*line, (n * 0.02, side * 500.0), (0.0, side * 500.0), line[0]])]


def test_many_short_pieces_in_one_place(spark):
    n = 50_000
    rows = zigzag(1, n, 1) + zigzag(2, n, -1)
    far = [(3, "Q", 0, i, x, y) for i, (x, y) in enumerate([(1000.0, 0.0), (9000.0, 0.0), (9000.0, 90.0), (1000.0, 90.0), (1000.0, 0.0)])]
    frame = spark.createDataFrame(rows + far, "zone_id int, borough string, ring int, seq int, x double, y double")
    pairs = {(r.zone_id, r.neighbor_id): r.shared_boundary_m for r in adjacency.boundary_pairs(frame).collect()}
    # The line ends at x = 1000, where the far box begins: it shares its left side with the upper ring.
    assert pairs == {(1, 2): pytest.approx(1000.0), (1, 3): pytest.approx(90.0), (2, 3): 0.0}
    leveled = adjacency.sized(adjacency.ring_segments(frame), 0.01)
    assert adjacency.line_candidates(leveled, 0.01).count() < 200 * n
    assert adjacency.point_candidates(leveled, 0.01).count() < 60 * n


def test_long_and_short_pieces_share_a_line(spark):
    n = 2000
    rows = zigzag(1, n, 1) + [(2, "Q", 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (40.0, 0.0), (40.0, -9.0), (0.0, -9.0), (0.0, 0.0)])]
    frame = spark.createDataFrame(rows, "zone_id int, borough string, ring int, seq int, x double, y double")
    assert adjacency.boundary_pairs(frame).first().shared_boundary_m == pytest.approx(40.0)


def test_pieces_shorter_than_the_tolerance_count(spark):
    line = [(i * 0.004, 0.0) for i in range(501)]
    rows = [(z, "Q", 0, i, x, y) for z, s in ((1, 1), (2, -1)) for i, (x, y) in enumerate([*line, (2.0, s * 3.0), (0.0, s * 3.0), line[0]])]
    frame = spark.createDataFrame(rows, "zone_id int, borough string, ring int, seq int, x double, y double")
    assert adjacency.boundary_pairs(frame).first().shared_boundary_m == pytest.approx(2.0, rel=1e-6)


def test_no_job_runs_before_the_pairs_are_asked_for(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "lazy")
    adjacency.boundary_pairs(squares(spark))
    assert not tracker.getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
