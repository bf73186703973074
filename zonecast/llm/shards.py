"""Sharding by sampled splitters.

A size-weighted sample of keys gives quantile boundaries; records are range-partitioned between them, and ranges
found overfull are subdivided by a finer sample of their own. Range totals, of which there are a bounded
number, then give every record its place by prefix sums, so shards are cut at equal bytes.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonecast.llm.store import aside, saved

RANGE_ROWS = 200_000
MOST_RANGES = 16_384
OVERSAMPLE = 32
WHOLE_GROUP = 0.05
OVERFULL = 2.0
LOWEST = -(1 << 63)


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, grp, sub`` of whole texts: what shards are cut by.

    The size is the text's UTF-8 bytes plus 16; a null text counts as an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("grp"),
        F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long")).alias("sub"),
    )


def boundaries(sample: pd.DataFrame, ranges: int) -> list[tuple[int, int]]:
    """Weighted quantiles of the sampled keys. A boundary stands before a whole group, unless the group
    holds several boundaries: then it is cut between its members."""
    if sample.empty or ranges < 2:
        return []
    sample = sample.sort_values(["grp", "sub"], kind="stable")
    reach = sample["weight"].cumsum().to_numpy()
    at = np.searchsorted(reach, reach[-1] * np.arange(1, ranges) / ranges)
    cuts, last = [], None
    for grp, sub in sample.iloc[np.minimum(at, len(sample) - 1)][["grp", "sub"]].itertuples(index=False):
        cuts.append((int(grp), int(sub) if grp == last else LOWEST))
        last = grp
    return sorted(set(cuts))


def numbers(cuts: list[tuple[int, int]], grp: np.ndarray, sub: np.ndarray) -> np.ndarray:
    """For each key the number of its range: of the boundaries up to it."""
    groups = np.array([g for g, _ in cuts], dtype=np.int64)
    subs = np.array([s for _, s in cuts], dtype=np.int64)
    low, high = np.searchsorted(groups, grp, "left"), np.searchsorted(groups, grp, "right")
    for cut in np.unique(grp[high > low]):
        mine = np.flatnonzero(grp == cut)
        a, b = low[mine[0]], high[mine[0]]
        low[mine] = a + np.searchsorted(subs[a:b], sub[mine], "right")
    return low.astype(np.int32)


def range_of(cuts: list[tuple[int, int]]):
    """A column function (grp, sub) -> number of the range."""

    @F.pandas_udf("int")
    def number(grp: pd.Series, sub: pd.Series) -> pd.Series:
        return pd.Series(numbers(cuts, grp.to_numpy(np.int64), sub.to_numpy(np.int64)))

    return number


def draw(rows: DataFrame, total: int, wanted: int, salt: int) -> pd.DataFrame:
    """About ``wanted`` keys, each row drawn in proportion to its size by a hash of its key."""
    share = F.col("size") * F.lit(wanted / max(total, 1))
    chance = (F.xxhash64("grp", "sub", F.lit(salt)) / F.lit(2.0**64)) + 0.5
    return rows.where(chance < share).select("grp", "sub", F.greatest(share, F.lit(1.0)).alias("weight")).toPandas()


# Names of the columns that rows hold while they are placed.
OWN = ("_range", "_end", "_row", "_held", "_from", "_base", "_first", "_place", "_start")


def shard(keyed: DataFrame, shards: int) -> DataFrame:
    """Adds ``shard`` (from 0) and ``slot`` (gapless from 0 within a shard) to rows of ``doc_id, size, grp, sub``.

    Shards follow the order of (group, sub-key, id) and are cut at equal sums of ``size``. A group of up to
    ``WHOLE_GROUP`` of a shard stays whole, so a shard misses its share by that and a row's size at most; a
    larger group is cut between its rows. Null ids are keys like others; like rows may change places; an empty
    table gives no rows. Other columns stay, whatever their names, except older ``shard`` and ``slot``.
    """
    keyed, back = aside(keyed.drop("shard", "slot"), OWN)
    rows = saved(keyed, "shard-keys")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = int(min(MOST_RANGES, max(shards * 8, n // RANGE_ROWS)))
    cuts, tried = boundaries(draw(rows, total, ranges * OVERSAMPLE, 0), ranges), 0
    while True:
        ranged = rows.withColumn("_range", range_of(cuts)("grp", "sub"))
        held = ranged.groupBy("_range").agg(F.sum("size").alias("size"), F.count("*").alias("n")).toPandas().sort_values("_range")
        over = held[(held["size"] > OVERFULL * total / ranges) & (held["n"] > 1)]
        tried += 1
        if over.empty or tried > 3:
            break
        finer = draw(
            ranged.where(F.col("_range").isin(over["_range"].tolist())), int(over["size"].sum()), 4 * OVERSAMPLE * len(over), tried
        )
        if finer.empty:
            break
        more = []
        for _, own in finer.groupby(numbers(cuts, finer["grp"].to_numpy(), finer["sub"].to_numpy())):
            more += boundaries(own, 4)
        if set(more) <= set(cuts):
            break
        cuts = sorted(set(cuts) | set(more))
    held["base"] = held["size"].cumsum() - held["size"]
    held["first"] = held["n"].cumsum() - held["n"]
    base = rows.sparkSession.createDataFrame(
        [tuple(map(int, r)) for r in held[["_range", "base", "first"]].itertuples(index=False)], "_range int, _base long, _first long"
    )
    order = Window.partitionBy("_range").orderBy("grp", "sub", "doc_id", "size")
    group = Window.partitionBy("_range", "grp")
    whole = F.lit(int(WHOLE_GROUP * total / shards))
    placed = (
        ranged.withColumn("_end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_row", F.row_number().over(order))
        .withColumn("_held", F.sum("size").over(group))
        .withColumn("_from", F.min(F.col("_end") - F.col("size")).over(group))
        .join(F.broadcast(base), "_range")
    )
    twice = 2 * F.col("_base") + F.when(F.col("_held") <= whole, 2 * F.col("_from") + F.col("_held")).otherwise(
        2 * F.col("_end") - F.col("size")
    )
    placed = saved(
        placed.select(
            *[F.col(c) for c in keyed.columns],
            F.least(F.lit(shards - 1), F.floor(twice * shards / F.lit(2 * max(total, 1)))).cast("int").alias("shard"),
            (F.col("_first") + F.col("_row") - 1).alias("_place"),
        ),
        "shard-places",
    )
    first = placed.groupBy("shard").agg(F.min("_place").alias("_start"))
    return placed.join(F.broadcast(first), "shard").select(
        *[F.col(c) for c in keyed.columns], "shard", (F.col("_place") - F.col("_start")).alias("slot")
    ).withColumnsRenamed(back)
