"""Embedding near-dedup by collision-counting projections.

Vectors are projected on many random lines. On each line the vectors are sorted, and a query collides with those in a window
of fixed width centred at it. A pair's collisions over all lines are binomial in its distance, so pairs at
the threshold cosine pass a count that is calibrated to lose fewer than ``MISS`` of them; passing pairs are
verified in double precision.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.llm.links import components
from zonecast.llm.store import saved

LINES = 48
WINDOW = 0.5
MISS = 1e-6
TILE = 4096
VERIFIED = 1 << 15
SEED = 20


def needed_collisions(cosine: float, lines: int = LINES, window: float = WINDOW, miss: float = MISS) -> int:
    """The largest count that a pair at this cosine misses with a chance of ``miss`` at most."""
    p = math.erf(window / (math.sqrt(2 - 2 * cosine) * math.sqrt(2))) if cosine < 1 else 1.0
    below, count = 0.0, 0
    while count < lines:
        below += math.comb(lines, count) * p**count * (1 - p) ** (lines - count)
        if below > miss:
            break
        count += 1
    return count


def directions(dim: int, lines: int = LINES) -> np.ndarray:
    return np.random.default_rng((SEED, dim)).standard_normal((dim, lines))


def collisions(a: np.ndarray, b: np.ndarray, window: float = WINDOW) -> np.ndarray:
    """Per pair the number of lines on which the row of ``b`` stands in the window around the row of ``a``."""
    count = np.zeros((len(a), len(b)), dtype=np.uint8)
    for line in range(a.shape[1]):
        order = np.argsort(b[:, line], kind="stable")
        rank = np.empty(len(b), dtype=np.uint16)
        rank[order] = np.arange(len(b), dtype=np.uint16)
        sorted_ = b[order, line]
        low = np.searchsorted(sorted_, a[:, line] - window, "left").astype(np.uint16)
        high = np.searchsorted(sorted_, a[:, line] + window, "right").astype(np.uint16)
        # Ranks below the window wrap to large numbers, so one comparison tests both ends.
        count += (rank[None, :] - low[:, None]) < (high - low)[:, None]
    return count


def linked(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of ``a`` link with which of ``b``: found by collisions, verified by cosine."""
    la, lb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    ua, ub, lines = a / la[:, None], b / lb[:, None], directions(a.shape[1])
    pa_, pb, needed = ua @ lines, ub @ lines, needed_collisions(cosine)
    out = np.zeros((len(a), len(b)), dtype=bool)
    for at in range(0, len(a), 256):
        i, j = np.nonzero(collisions(pa_[at : at + 256], pb) >= needed)
        for begin in range(0, len(i), VERIFIED):
            x, y = at + i[begin : begin + VERIFIED], j[begin : begin + VERIFIED]
            out[x, y] = cosines(a, b, x, y, la, lb) >= cosine
    return out


def cosines(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Cosine in double precision of the counted pairs (row ``i`` of ``a``, row ``j`` of ``b``) and of no others."""
    return np.einsum("nd,nd->n", a[i], b[j]) / (la[i] * lb[j])


def smallest_reached(links: np.ndarray, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id that each row and each column of a link matrix reaches within it."""
    top = np.iinfo(np.int64).max
    while True:
        b = np.minimum(other, np.min(np.where(links, own[:, None], top), axis=0, initial=top))
        a = np.minimum(own, np.min(np.where(links, b[None, :], top), axis=1, initial=top))
        if (a == own).all() and (b == other).all():
            return a, b
        own, other = a, b


def near_vectors(rows: DataFrame, cosine: float = 0.93, column: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, label, <column>``.

    Only vectors of one label and one dimension are compared. Vectors that are null, zero or hold null or
    non-finite components and those without a label have no links and are their own component; so do null ids.
    Equal vectors of a label are one class with a count: its members link with each other and share all other
    links. Classes of a label are dealt into tiles, and each pair of tiles is a task that gives back one count
    and at most one link per class, never the pairs. An empty table gives no rows.
    """
    x = F.col(column)
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    usable = F.coalesce(sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    vectors = rows.select("vec_id", F.when(usable, F.col("label")).alias("label"), F.when(usable, x).alias("v"))
    classes = saved(
        vectors.where("v IS NOT NULL").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vector-classes"
    ).withColumn("dim", F.size("v"))
    tiles = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("_tiles"))
    tiled = classes.join(tiles, ["label", "dim"]).withColumn("_tile", F.pmod(F.xxhash64("rep"), F.col("_tiles")).cast("int"))
    met = tiled.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    met = met.withColumn("_i", F.least("_tile", "_with")).withColumn("_j", F.greatest("_tile", "_with"))

    def pair(key: tuple, held: pa.Table) -> pa.Table:
        i, j = key[2].as_py(), key[3].as_py()
        dim = key[1].as_py()
        cells = pa.concat_arrays([c.flatten() for c in held["v"].chunks]).to_numpy(zero_copy_only=False)
        v = cells.reshape(-1, dim).astype(np.float64)
        rep, copies, tile = (held[c].to_numpy() for c in ("rep", "copies", "_tile"))
        a, b = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        links = linked(v[a], v[b], cosine) if len(a) and len(b) else np.zeros((len(a), len(b)), dtype=bool)
        if i == j:
            np.fill_diagonal(links, False)
        root_a, root_b = smallest_reached(links, rep[a], rep[b])
        n_a, n_b = links @ copies[b], copies[a] @ links
        sides = [(a, root_a, n_a)] if i == j else [(a, root_a, n_a), (b, root_b, n_b)]
        if i == j:
            root_a[:] = np.minimum(root_a, root_b)
        at, root, n = (np.concatenate(x) for x in zip(*sides, strict=True))
        some = n > 0
        return pa.table({"rep": rep[at][some], "root": root[some], "n": n[some].astype(np.int64)})

    found = saved(met.groupBy("label", "dim", "_i", "_j").applyInArrow(pair, "rep long, root long, n long"), "vector-links")
    sums = found.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = (
        classes.join(sums, "rep", "left")
        .join(roots, F.col("rep") == F.col("id"), "left")
        .select(
            "label",
            "v",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    joined = vectors.join(known, ["label", "v"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
