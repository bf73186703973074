"""Polygon neighbours from a vertex table ``zone_id, borough, ring, seq, x, y`` (closed rings).

Boundary pieces lie in cells about as large as they are long, and reach up through the larger cells around them. Two pieces meet
in a cell of the longer one, on a key of direction and distance to the cell centre, so only pieces that lie on the same
stretch of the same line become candidates, however dense the map is there. Exact geometry decides.
"""

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonecast.functions.tables import count_true
from zonecast.operators.contracts import check_rows

ANGLE_STEP = 1e-3
# Cells of a level are so many times as wide as those of the level below.
LEVEL_FACTOR = 4.0


def geometry_identity(vertices: DataFrame, zones: DataFrame, allow_outside: bool = True) -> DataFrame:
    """Id counts of the shapes against the lookup; never guesses a mapping.

    A shape is one ``(zone_id, borough)`` group here; an id with several groups is a duplicate.
    """
    shapes = vertices.groupBy("zone_id", "borough").agg(
        F.count("x").alias("points"), count_true(F.col("x").isNull() | F.col("y").isNull()).alias("holes")
    )
    ids = shapes.groupBy("zone_id").agg(
        F.count(F.lit(1)).alias("copies"),
        count_true((F.col("points") < 4) | (F.col("holes") > 0)).alias("empty"),
    )
    listed = zones.select("zone_id").distinct().withColumn("listed", F.lit(True))
    totals = ids.join(listed, "zone_id", "full_outer").agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        count_true(F.col("copies").isNotNull()).alias("unique_zone_ids"),
        count_true(F.col("copies") > 1).alias("duplicate_ids"),
        count_true(F.col("copies").isNull()).alias("missing_ids"),
        count_true(F.col("listed").isNull()).alias("outside_ids"),
        F.coalesce(F.sum("empty"), F.lit(0)).alias("empty"),
    )
    one = (F.col("duplicate_ids") == 0) & (F.col("missing_ids") == 0)
    if not allow_outside:
        one = one & (F.col("outside_ids") == 0)
    return totals.withColumn("one_to_one", one)


def ring_segments(vertices: DataFrame) -> DataFrame:
    """Consecutive vertex pairs of each ring."""
    along = Window.partitionBy("zone_id", "ring").orderBy("seq")
    return (
        vertices.select(
            "zone_id",
            "ring",
            "seq",
            F.col("x").alias("x1"),
            F.col("y").alias("y1"),
            F.lead("x").over(along).alias("x2"),
            F.lead("y").over(along).alias("y2"),
        )
        .where(F.col("x2").isNotNull())
        .where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))
    )


def cell_width(level) -> Column:
    return F.pow(F.lit(LEVEL_FACTOR), level.cast("double"))


def sized(segments: DataFrame, tolerance: float) -> DataFrame:
    """Adds ``own``: the level whose cells are just as wide as the segment is long, and wider than the tolerance."""
    length = F.greatest(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), F.lit(16 * tolerance))
    return segments.withColumn("own", F.ceil(F.log(LEVEL_FACTOR, length)).cast("int"))


def at_levels(leveled: DataFrame) -> DataFrame:
    """Each segment once per ``level`` of the table; these are a few numbers, however many rows it has, and a subquery of the plan."""
    present = leveled.agg(F.array_sort(F.collect_set("own"))).scalar()
    return leveled.withColumn("level", present).withColumn("level", F.explode("level"))


def cells_of(low, high, cell, tolerance: float):
    """Cell numbers of a coordinate interval, with a margin of the tolerance."""
    return F.sequence(
        F.floor((low - tolerance) / cell).cast("bigint"), F.floor((high + tolerance) / cell).cast("bigint")
    )


def in_cells(segments: DataFrame, cell, tolerance: float) -> DataFrame:
    """Each segment once per cell that it crosses, with a margin of the tolerance.

    Columns of cells are walked, and in each only the rows that the segment reaches there: a diagonal through n
    columns takes about 2n cells, not n * n.
    """
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    columns = segments.withColumn("cx", F.explode(cells_of(left, right, cell, tolerance)))
    clip = lambda v, a, b: F.least(F.greatest(v, a), b)
    slope = F.try_divide(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    at = lambda x: F.col("y1") + (clip(x, left, right) - F.col("x1")) * slope
    begin, end = at(F.col("cx") * cell - 2 * tolerance), at((F.col("cx") + 1) * cell + 2 * tolerance)
    upright = F.col("x1") == F.col("x2")
    bottom = F.when(upright, low).otherwise(clip(F.least(begin, end), low, high))
    top = F.when(upright, high).otherwise(clip(F.greatest(begin, end), low, high))
    return columns.withColumn("cy", F.explode(cells_of(bottom, top, cell, tolerance)))


def line_keys(placed: DataFrame, cell, tolerance: float) -> DataFrame:
    """Direction and offset buckets. Each value enters its bucket and the next, so near values
    always share one; a direction close to the wrap-around enters from both ends."""
    angle = F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    folded = F.when(angle < 0, angle + pi).when(angle >= pi, angle - pi).otherwise(angle)
    offset = (F.col("y1") - (F.col("cy") + 0.5) * cell) * F.cos("angle") - (
        F.col("x1") - (F.col("cx") + 0.5) * cell
    ) * F.sin("angle")
    # Half a bucket must exceed what the angle step cannot see; the exact test is still to come.
    step = 8 * tolerance
    both = F.array(
        F.struct(F.col("angle").alias("a"), F.col("offset").alias("o")),
        F.struct((F.col("angle") - pi).alias("a"), (-F.col("offset")).alias("o")),
    )
    ways = F.when(F.col("angle") > pi - 2 * ANGLE_STEP, both).otherwise(F.slice(both, 1, 1))
    near = lambda v, s: F.array(F.floor(v / s), F.floor(v / s) + 1)
    return (
        placed.withColumn("angle", folded)
        .withColumn("offset", offset)
        .select("*", F.inline(ways))
        .withColumn("ka", F.explode(near(F.col("a"), ANGLE_STEP)))
        .withColumn("ko", F.explode(near(F.col("o"), step)))
        .drop("angle", "offset", "a", "o")
    )


def side(frame: DataFrame, tag: str) -> DataFrame:
    return frame.select(
        "level",
        "cx",
        "cy",
        *[c for c in ("ka", "ko") if c in frame.columns],
        *[F.col(c).alias(f"{tag}_{c}") for c in ("own", "zone_id", "ring", "seq", "x1", "y1", "x2", "y2")],
    )


def line_candidates(leveled: DataFrame, tolerance: float) -> DataFrame:
    """Pairs of pieces of two zones in one cell of the longer one, on one line. Of equally long ones the smaller zone is ``a``.

    A piece as long as a cell leaves room for few others beside it on its line, so a piece meets a few longer ones per level, and no
    number of short pieces in a place makes them all meet.
    """
    upward = at_levels(leveled).where("level >= own")
    cell = cell_width(F.col("level"))
    keyed = line_keys(in_cells(upward, cell, tolerance), cell, tolerance)
    longer = side(keyed.where("level = own"), "a")
    apart = (F.col("a_own") > F.col("b_own")) & (F.col("a_zone_id") != F.col("b_zone_id"))
    alike = (F.col("a_own") == F.col("b_own")) & (F.col("a_zone_id") < F.col("b_zone_id"))
    return longer.join(side(keyed, "b"), ["level", "cx", "cy", "ka", "ko"]).where(apart | alike)


def shared_lengths(leveled: DataFrame, tolerance: float) -> DataFrame:
    """``zone_id, neighbor_id, length`` of collinear overlaps."""
    pairs = line_candidates(leveled, tolerance)
    dx, dy = F.col("a_x2") - F.col("a_x1"), F.col("a_y2") - F.col("a_y1")
    size = F.hypot(dx, dy)
    along = lambda x, y: ((F.col(x) - F.col("a_x1")) * dx + (F.col(y) - F.col("a_y1")) * dy) / size
    away = lambda x, y: F.abs(
        (F.col(x) - F.col("a_x1")) * dy - (F.col(y) - F.col("a_y1")) * dx
    ) / size
    first, second = along("b_x1", "b_y1"), along("b_x2", "b_y2")
    # Pieces that only meet at their ends overlap by rounding; pieces may be shorter than the tolerance themselves.
    least = F.least(F.lit(tolerance), size / 2, F.abs(second - first) / 2)
    length = F.least(size, F.greatest(first, second)) - F.greatest(F.lit(0.0), F.least(first, second))
    hits = pairs.where(
        (away("b_x1", "b_y1") <= tolerance) & (away("b_x2", "b_y2") <= tolerance)
    ).withColumn("length", length).where(F.col("length") > least)
    # The same two segments can meet under several keys; count them once.
    once = hits.groupBy(
        "a_zone_id", "a_ring", "a_seq", "b_zone_id", "b_ring", "b_seq"
    ).agg(F.max("length").alias("length"))
    return once.groupBy(
        F.least("a_zone_id", "b_zone_id").alias("zone_id"), F.greatest("a_zone_id", "b_zone_id").alias("neighbor_id")
    ).agg(F.sum("length").alias("length"))


def point_candidates(leveled: DataFrame, tolerance: float) -> DataFrame:
    """Each vertex with the pieces of other zones that have about their own length to it."""
    corners = at_levels(leveled).select(
        F.col("zone_id").alias("p_zone_id"),
        F.col("x1").alias("px"),
        F.col("y1").alias("py"),
        "level",
        F.floor(F.col("x1") / cell_width(F.col("level"))).cast("bigint").alias("cx"),
        F.floor(F.col("y1") / cell_width(F.col("level"))).cast("bigint").alias("cy"),
    )
    pieces = in_cells(leveled.withColumn("level", F.col("own")), cell_width(F.col("level")), tolerance)
    return corners.join(side(pieces, "s"), ["level", "cx", "cy"]).where(F.col("p_zone_id") != F.col("s_zone_id"))


def touching_points(leveled: DataFrame, tolerance: float) -> DataFrame:
    """Zone pairs where a vertex of one lies on the boundary of the other."""
    near = point_candidates(leveled, tolerance)
    dx, dy = F.col("s_x2") - F.col("s_x1"), F.col("s_y2") - F.col("s_y1")
    at = ((F.col("px") - F.col("s_x1")) * dx + (F.col("py") - F.col("s_y1")) * dy) / (dx * dx + dy * dy)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), at))
    gap = F.hypot(
        F.col("px") - F.col("s_x1") - share * dx, F.col("py") - F.col("s_y1") - share * dy
    )
    return near.where(gap <= tolerance).select(
        F.least("p_zone_id", "s_zone_id").alias("zone_id"),
        F.greatest("p_zone_id", "s_zone_id").alias("neighbor_id"),
    ).distinct()


def boundary_pairs(
    vertices: DataFrame,
    unit_m: float = 1.0,
    min_m: float = 1.0,
    tolerance: float = 0.01,
) -> DataFrame:
    """Touching zones with their shared boundary in metres; corner contact has length 0."""
    leveled = sized(ring_segments(vertices), tolerance)
    lengths = shared_lengths(leveled, tolerance)
    points = touching_points(leveled, tolerance).withColumn("length", F.lit(0.0))
    metres = F.sum("length") * unit_m
    return (
        lengths.unionByName(points)
        .groupBy("zone_id", "neighbor_id")
        .agg(metres.alias("shared_boundary_m"))
        .withColumn("qualifies", F.col("shared_boundary_m") >= min_m)
    )


def adjacency_edges(pairs: DataFrame) -> DataFrame:
    return pairs.where("qualifies").orderBy("zone_id", "neighbor_id")


def zone_areas(vertices: DataFrame, unit_m: float = 1.0) -> DataFrame:
    """Shoelace area; inner rings run the other way round and subtract."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return ring_segments(vertices).groupBy("zone_id").agg(
        (F.abs(F.sum(cross)) / 2 * unit_m * unit_m / 1e6).alias("area_km2")
    )


def zone_nodes(vertices: DataFrame, pairs: DataFrame, zones: DataFrame, unit_m: float = 1.0) -> DataFrame:
    """Zone attributes, area and number of neighbours (0 for isolated zones)."""
    ends = pairs.where("qualifies").select(
        F.explode(F.array("zone_id", "neighbor_id")).alias("zone_id")
    )
    degree = ends.groupBy("zone_id").agg(F.count(F.lit(1)).cast("int").alias("neighbor_count"))
    return (
        zones.select("zone_id", "borough", "Zone")
        .join(zone_areas(vertices, unit_m), "zone_id", "left")
        .join(degree, "zone_id", "left")
        .withColumn("neighbor_count", F.coalesce("neighbor_count", F.lit(0)))
    )


def graph_summary(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges, touching pairs, isolated zones, largest degree.

    Both inputs are tagged and added up together, so no join is needed.
    """
    tagged = pairs.select(
        F.lit(1).alias("pair"), F.col("qualifies").cast("int").alias("edge"), F.lit(None).cast("int").alias("degree")
    ).unionByName(
        nodes.select(F.lit(0).alias("pair"), F.lit(0).alias("edge"), F.col("neighbor_count").alias("degree"))
    )
    return tagged.agg(
        F.sum("edge").alias("undirected_edges"),
        F.sum("pair").alias("touching_pairs"),
        count_true(F.col("degree") == 0).alias("isolated_zones"),
        F.max("degree").alias("max_degree"),
    )


def isolated_zones(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("zone_id", "neighbor_id")).alias("zone_id"))
    return nodes.join(ends, "zone_id", "left_anti").select("zone_id")


def check_borough_agreement(vertices: DataFrame, zones: DataFrame) -> DataFrame:
    """Shapes whose borough differs from the lookup."""
    shapes = vertices.select("zone_id", "borough").distinct()
    known = zones.select("zone_id", F.col("borough").alias("listed"))
    joined = shapes.join(known, "zone_id", "left")
    totals = joined.agg(
        count_true(F.col("listed").isNull()).alias("unknown_zone"),
        count_true(F.col("listed") != F.col("borough")).alias("borough_mismatch"),
    )
    return check_rows(totals, totals.columns)
