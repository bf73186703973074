"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped by length, long ones first. A query's k-th best score so far, divided by its own length and a
bucket's largest, is the cosine that a candidate of the bucket must reach. Where that is above 1 the bucket
is left; where it is high, one coordinate of the candidate must lie in a narrow band; else the candidate
must be long enough. What is left is multiplied out. The first thresholds come from the longest candidates.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonecast.llm.shards import boundaries, draw, range_of
from zonecast.llm.store import saved

QUERY_BLOCK = 2048
CHUNK_ROWS = 16_384
BUCKET_ROWS = 1024
SEED_ROWS = 2048
BY_COORDINATE = 0.9
EXACT = float(1 << 53)


def quantized(rows: DataFrame, column: str = "embedding", scale: float = 64.0) -> DataFrame:
    """``vec_id, v, dim, norm2`` with each component as floor(scale * x).

    Rows with a null id or vector, or with null or non-finite components take no part; of rows that share an id
    the smallest vector counts.
    """
    x = F.col(column)
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    cells = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    whole = rows.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long"), cells.alias("v"))
    one = whole.groupBy("vec_id").agg(F.min("v").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return one.select("vec_id", "v", F.size("v").alias("dim"), square.alias("norm2"))


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.int64())
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.float64)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: in floating point while they fit, else in 64-bit integers."""
    reach = q.shape[1] * np.abs(q).max(initial=0) * np.abs(c).max(initial=0)
    if reach < EXACT:
        return (q @ c.T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


class Best:
    """The k best (score, id) of each query, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.k, self.floor = ids, k, floor
        self.scores = [np.empty(0, np.int64) for _ in ids]
        self.found = [np.empty(0, np.int64) for _ in ids]

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = (scores >= self.floor[i]) & (ids != self.ids[i])
        if not keep.any():
            return
        scores, ids = np.concatenate([self.scores[i], scores[keep]]), np.concatenate([self.found[i], ids[keep]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[i], self.found[i] = scores[order], ids[order]
        if len(order) == self.k:
            self.floor[i] = max(self.floor[i], self.scores[i][-1])


def search(q: np.ndarray, best: Best, c: np.ndarray, ids: np.ndarray) -> None:
    """Bring all candidates ``c`` (longest first) before all queries ``q``."""
    lengths, own = np.sqrt((c * c).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    for at in range(0, len(c), BUCKET_ROWS):
        some, some_ids, some_lengths = c[at : at + BUCKET_ROWS], ids[at : at + BUCKET_ROWS], lengths[at : at + BUCKET_ROWS]
        bound = np.maximum(own * some_lengths[0], 1e-9)
        cosine = best.floor / bound
        narrow = (cosine > BY_COORDINATE) & (cosine <= 1 + 1e-9)
        for i in np.flatnonzero(narrow):
            # A unit vector at this cosine or above has its focus coordinate in a band around the query's. Where the
            # query is nearer to the axis than that, the axis itself is near enough and the band reaches its end.
            t, axis = min(1.0, cosine[i]), int(np.abs(q[i]).argmax())
            x, slack = q[i, axis] / own[i], 1e-9
            half = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x))) + slack
            y = some[:, axis] / np.maximum(some_lengths, 1e-9)
            low, high = -np.inf if -x > t else x * t - half, np.inf if x > t else x * t + half
            near = np.flatnonzero((y >= low) & (y <= high) if abs(x) < 1 else np.ones(len(y), bool))
            near = near[some_lengths[near] * own[i] >= best.floor[i] - 1e-6]
            if len(near):
                best.add(i, products(q[i : i + 1], some[near])[0], some_ids[near])
        wide = np.flatnonzero(cosine <= BY_COORDINATE)
        if len(wide):
            # A candidate shorter than floor / |q| cannot reach the floor; lengths fall within the bucket.
            need = np.max(some_lengths[None, :] * own[wide, None] >= best.floor[wide, None] - 1e-6, axis=0)
            reach = int(np.flatnonzero(need)[-1]) + 1 if need.any() else 0
            scores = products(q[wide], some[:reach])
            for row, i in enumerate(wide.tolist()):
                best.add(i, scores[row], some_ids[:reach])


def reach_of(floor: np.ndarray, lengths: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """For each query the last chunk that may hold a product of its floor or more, -1 for none.

    ``longest`` holds each chunk's largest length; a product is at most the product of the lengths. Chunks before
    the last one are met too, as lengths fall from chunk to chunk.
    """
    falling = np.maximum.accumulate(longest[::-1])[::-1]
    need = (floor - 1e-6) / np.maximum(lengths * (1 + 1e-9), 1e-9)
    return np.searchsorted(-falling, -need, "right") - 1


def meetings(rows: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Queries and candidates, each once per (dimension, band, block, chunk) in which they meet.

    A query's floor is its k-th best product with the ``SEED_ROWS`` longest vectors. It goes to the chunks up to the last whose
    longest vector may reach the floor, and a chunk goes to the blocks of the bands (powers of two of that last chunk) that reach it.
    """
    spark = rows.sparkSession
    rows = saved(rows, "vectors")
    n = rows.count()
    chunks = max(1, -(-n // CHUNK_ROWS))
    keyed = rows.withColumn("grp", -F.floor("norm2")).withColumn("sub", F.xxhash64("vec_id")).withColumn("size", F.lit(1))
    cuts = boundaries(draw(keyed, n, chunks * 32, 0), chunks)
    chunked = saved(keyed.select("vec_id", "v", "dim", "norm2", range_of(cuts)("grp", "sub").alias("_chunk")), "chunks")
    longest: dict[int, np.ndarray] = {}
    for row in chunked.groupBy("dim", "_chunk").agg(F.sqrt(F.max("norm2")).alias("top")).collect():
        longest.setdefault(row["dim"], np.zeros(len(cuts) + 1))[row["_chunk"]] = row["top"]
    seeds: dict[int, tuple[list, list]] = {}
    for row in rows.orderBy(F.desc("norm2"), "vec_id").limit(SEED_ROWS).select("vec_id", "v", "dim").collect():
        ids, cells = seeds.setdefault(row["dim"], ([], []))
        ids.append(row["vec_id"])
        cells.append(row["v"])
    seeds = {dim: (np.array(ids), np.array(cells, dtype=np.float64).reshape(-1, dim)) for dim, (ids, cells) in seeds.items()}
    shared = spark.sparkContext.broadcast((seeds, longest))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tops = shared.value
        for batch in batches:
            low = np.full(batch.num_rows, -(1 << 62), dtype=np.int64)
            reach = np.full(batch.num_rows, -1, dtype=np.int32)
            dims, ids = batch.column("dim").to_numpy(), batch.column("vec_id").to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in tops:
                    continue
                mine = np.flatnonzero(dims == dim)
                q = matrix(pa.chunked_array([batch.column("v").take(pa.array(mine))]), dim)
                if dim in known and len(known[dim][0]) > k:
                    seed_ids, cells = known[dim]
                    scores = products(q, cells)
                    scores[ids[mine][:, None] == seed_ids[None, :]] = -(1 << 62)
                    low[mine] = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
                reach[mine] = reach_of(low[mine].astype(np.float64), np.sqrt((q * q).sum(axis=1)), tops[dim])
            yield batch.append_column("floor", pa.array(low)).append_column("_reach", pa.array(reach))

    kinds = "vec_id long, v array<bigint>, dim int, floor long, _reach int"
    band = F.floor(F.log2(F.col("_reach") + 1)).cast("int")
    known = saved(queries.select("vec_id", "v", "dim").mapInArrow(floors, kinds).where("_reach >= 0").withColumn("_band", band), "floors")
    bands = known.groupBy("dim", "_band").agg(F.ceil(F.count("*") / F.lit(QUERY_BLOCK)).cast("int").alias("_blocks"), F.max("_reach").alias("_last"))
    upto = lambda last: F.explode(F.sequence(F.lit(0), last))
    block = F.pmod(F.xxhash64("vec_id"), F.col("_blocks")).cast("int")
    asked = known.join(F.broadcast(bands), ["dim", "_band"]).withColumn("_block", block).withColumn("_chunk", upto(F.col("_reach")))
    held = chunked.join(F.broadcast(bands), "dim").where("_chunk <= _last").withColumn("_block", upto(F.col("_blocks") - 1))
    fresh = [F.col(c).alias(c) for c in ("vec_id", "v", "dim", "norm2", "_band", "_block", "_chunk")]
    return asked.select("vec_id", "v", "dim", "floor", "_band", "_block", "_chunk"), held.select(*fresh)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` largest inner products with the other rows.

    ``rows`` and ``queries`` come from ``quantized``; vectors meet those of their own dimension only. Ties go
    to the smaller id. Queries are a stated set and meet in blocks all chunks of rows that are long enough to hold a
    result: each (query block, chunk) is a task's work and passes on ``k`` rows per query. Nothing but the
    ``SEED_ROWS`` longest vectors, a fixed number, and one length per ``CHUNK_ROWS`` rows is sent to every task.
    Fewer candidates than ``k`` give fewer rows, none give none. Products beyond 64 bits, of components of
    about 10^8 and more, are not kept apart.
    """
    asked, held = meetings(rows, queries, k)

    def block(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        ids = asked["vec_id"].to_numpy()
        best = Best(ids, k, asked["floor"].to_numpy().astype(np.float64))
        c, c_ids = matrix(held["v"], dim), held["vec_id"].to_numpy()
        order = np.lexsort((c_ids, -held["norm2"].to_numpy()))
        if len(ids) and len(order):
            search(matrix(asked["v"], dim), best, c[order], c_ids[order])
        return pa.table(
            {
                "query_id": pa.array(np.repeat(ids, [len(s) for s in best.scores]), pa.int64()),
                "vec_id": pa.array(np.concatenate([np.empty(0, np.int64), *best.found]), pa.int64()),
                "score": pa.array(np.concatenate([np.empty(0, np.int64), *best.scores]), pa.int64()),
            }
        )

    keys = ("dim", "_band", "_block", "_chunk")
    met = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(block, "query_id long, vec_id long, score long")
    line = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
