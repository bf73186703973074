"""MinHash near-dedup with SetSketch registers.

Each of ``REGISTERS`` hash functions turns a shingle into an exponential variable; a register keeps the smallest one of
the set, counted on a scale of powers of ``BASE`` and cut to 16 bits. Registers of a union are the larger ones of
its parts, and two sets agree in a register with a chance close to their similarity. Bands of
registers bring alike sets together, their joint likelihood sorts out pairs that are clearly below the
threshold, and all others are verified on full shingle sets.

Equal sets are one class. A band's classes are not paired with each other: they are compared with the band's
smallest class first, and only what stays unconnected in a band is paired, until no pair is left that
could still join two components. No link between components is lost to this; pairs within one are not listed.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.llm.links import components
from zonecast.llm.store import saved
from zonecast.llm.tokens import release
from zonecast.llm.words import mixed, runs, together, words_of

SHINGLE = 5
REGISTERS = 128
ROWS = 4
BASE = 1.001
RATE = 20.0
LARGEST = (1 << 16) - 2
UNLIKELY = 12.0
FINE_REGISTERS = 1024
SALT_ROWS = 512
TILE = 2048
BEST = 2
MULTIPLIERS = mixed(np.arange(1, FINE_REGISTERS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingle_sets(texts: list[bytes | None], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: ``width`` words each; all words as one, if there are fewer."""
    found = words_of([text.lower() if text else text for text in texts])
    whole, first = runs(found.hashes, width), found.first.tolist()
    out = []
    for begin, end in zip(first[:-1], first[1:], strict=True):
        if end - begin >= width:
            out.append(np.unique(whole[begin : end - width + 1]))
        else:
            out.append(runs(found.hashes[begin:end], end - begin, salt=2) if end > begin else np.empty(0, np.uint64))
    return out


def registers(sets: list[np.ndarray], count: int = REGISTERS) -> np.ndarray:
    """(set, register) values of non-empty sets. More registers begin with the same ones."""
    joined = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    low = np.empty((count, len(sets)), dtype=np.uint64)
    h, t = np.empty_like(joined), np.empty_like(joined)
    for i, multiplier in enumerate(MULTIPLIERS[:count]):
        np.multiply(joined, multiplier, out=h)
        np.right_shift(h, np.uint64(32), out=t)
        np.bitwise_xor(h, t, out=h)
        np.multiply(h, np.uint64(0xD6E8FEB86659FD93), out=h)
        low[i] = np.minimum.reduceat(h, starts)
    smallest = -np.log1p(-(low.T.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / math.log(BASE)), 0, LARGEST + 1).astype("<u2")


def bands(values: np.ndarray) -> np.ndarray:
    """(set, band) hashes of ``ROWS`` registers each."""
    rows = values.astype(np.uint64).reshape(len(values), -1, ROWS)
    total = np.zeros(rows.shape[:2], dtype=np.uint64)
    for i in range(ROWS):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, i] + np.uint64(1))
    return mixed(total + np.arange(rows.shape[1], dtype=np.uint64)[None, :])


def log_ratio(higher, lower, equal, n_a, n_b, similarity: float) -> np.ndarray:
    """Log likelihood of the best similarity below ``similarity`` minus that of ``similarity`` itself.

    ``higher`` and ``lower`` count registers in which the first set's value is the larger and the smaller one.
    Zero if the best one is not below.
    """
    total = (n_a + n_b).astype(np.float64)
    u, v = n_a / total, n_b / total

    def likelihood(j):
        p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / math.log(BASE)
        up, down = p(u - v * j), p(v - u * j)
        same = np.maximum(1 - up - down, 1e-12)
        return higher * np.log(np.maximum(up, 1e-12)) + lower * np.log(np.maximum(down, 1e-12)) + equal * np.log(same)

    at, best = likelihood(np.full(len(u), similarity)), np.full(len(u), -np.inf)
    for j in np.linspace(0.0, similarity, 26):
        best = np.maximum(best, likelihood(np.full(len(u), j)))
    return np.maximum(best - at, 0.0)


def possible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of register rows that may reach the similarity: by set sizes exactly, by likelihood else."""
    sizes = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    higher, lower = (a > b).sum(axis=1), (a < b).sum(axis=1)
    return sizes & (log_ratio(higher, lower, a.shape[1] - higher - lower, n_a, n_b, percent / 100) <= UNLIKELY)


def sketch(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_key, registers`` of whole texts; the last two are null for empty sets."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for begin, end in together(texts):
                sets = shingle_sets(texts[begin:end])
                real = [s for s in sets if len(s)]
                values = iter(registers(real) if real else ())
                keys = [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets]
                cells = [next(values).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(cells, pa.binary())],
                    names=["doc_id", "n_shingles", "set_key", "registers"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sketched, "doc_id long, n_shingles long, set_key binary, registers binary")


def banded(classes: DataFrame) -> DataFrame:
    """``rep, band`` rows of each class."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, REGISTERS)
                own = bands(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(batch.column(0).to_numpy(), own.shape[1])), pa.array(own.ravel().view(np.int64))], names=["rep", "band"]
                )

    return classes.select("rep", "registers").mapInArrow(rows, "rep long, band long")


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of classes that their registers do not rule out."""
    of_a = classes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("registers").alias("r_a"))
    of_b = classes.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("registers").alias("r_b"))
    met = pairs.join(of_a, "a").join(of_b, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("r_a", "r_b"))
                good = possible(a, b, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), percent)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return met.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(kept, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets are alike enough.

    Each ``b`` comes with its members ``a`` in runs of about ``SALT_ROWS``; a run is streamed past the one set of ``b``.
    """
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(SALT_ROWS)).cast("int").alias("_salts"))
    members = (
        pairs.join(salts, "b")
        .select("a", "b", F.pmod(F.xxhash64("a"), F.col("_salts")).cast("int").alias("salt"))
        .join(texts.withColumnRenamed("rep", "a"), "a")
        .select("b", "salt", "a", "text")
    )
    heads = (
        salts.join(texts.withColumnRenamed("rep", "b"), "b")
        .select("b", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("a"), "text")
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        head, key = np.empty(0, np.uint64), None
        for batch in batches:
            b, a, salt = (batch.column(c).to_pylist() for c in ("b", "a", "salt"))
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            out = []
            for begin, end in together(texts):
                for i, own in zip(range(begin, end), shingle_sets(texts[begin:end]), strict=True):
                    if a[i] is None:
                        head, key = own, (b[i], salt[i])
                        continue
                    assert key == (b[i], salt[i])
                    both = len(np.intersect1d(head, own, assume_unique=True))
                    if 100 * both >= percent * (len(head) + len(own) - both):
                        out.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    lined = members.unionByName(heads).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return lined.mapInArrow(compared, "a long, b long")


def finer(texts: DataFrame) -> DataFrame:
    """``rep, n_shingles, registers`` with ``FINE_REGISTERS`` of each class that shares a band."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1).cast(pa.binary()).to_pylist()
            for begin, end in together(held):
                sets = shingle_sets(held[begin:end])
                values = registers(sets, FINE_REGISTERS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array([len(s) for s in sets], pa.int64()), pa.array([v.tobytes() for v in values], pa.binary())],
                    names=["rep", "n_shingles", "registers"],
                )

    return texts.select("rep", "text").mapInArrow(rows, "rep long, n_shingles long, registers binary")


def open_pairs(shared: DataFrame, fine: DataFrame, found: DataFrame, percent: int, best: int | None) -> DataFrame:
    """Pairs of one band and different components that may still be alike.

    A band's classes are dealt into tiles of ``TILE``; a task holds two tiles. A pair belongs to the first of the bands
    that it shares and is given there alone. Of the pairs of a class with another component, the ``best``
    likeliest of a task are given, or all of them.
    """
    named = found.select(F.col("id").alias("rep"), "component")
    known = shared.join(named, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    torn = known.groupBy("band").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count("*").alias("_n")).where("_low < _high")
    tiles = torn.select("band", F.ceil(F.col("_n") / F.lit(TILE)).cast("int").alias("_tiles"))
    held = known.join(tiles, "band").join(fine, "rep")
    held = held.withColumn("_tile", F.pmod(F.xxhash64("rep"), F.col("_tiles")).cast("int"))
    met = held.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    met = met.select("band", F.least("_tile", "_with").alias("i"), F.greatest("_tile", "_with").alias("j"), "_tile", "rep", "component", "n_shingles", "registers")

    def pair(key: tuple, rows: pa.Table) -> pa.Table:
        release()
        i, j = key[1].as_py(), key[2].as_py()
        rep, component, n, tile = (rows[c].to_numpy() for c in ("rep", "component", "n_shingles", "_tile"))
        values = np.frombuffer(b"".join(rows["registers"].to_pylist()), "<u2").reshape(-1, FINE_REGISTERS)
        own = bands(values[:, :REGISTERS])
        earlier = own[:, : int(np.flatnonzero(own[0].view(np.int64) == key[0].as_py())[0])]
        left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        a_out, b_out = [], []
        for at in left.tolist():
            other = right[(component[right] != component[at]) & ((i != j) | (rep[right] > rep[at]))]
            other = other[100 * np.minimum(n[other], n[at]) >= percent * np.maximum(n[other], n[at])]
            other = other[~(earlier[other] == earlier[at]).any(axis=1)]
            if not len(other):
                continue
            equal = (values[other] == values[at]).sum(axis=1)
            good = equal >= FINE_REGISTERS * percent / 250
            other, equal = other[good], equal[good]
            good = possible(np.broadcast_to(values[at], (len(other), FINE_REGISTERS)), values[other], np.full(len(other), n[at]), n[other], percent)
            other, equal = other[good], equal[good]
            if best is not None and len(other) > best:
                order = np.lexsort((-equal, component[other]))
                new = np.concatenate([[True], component[other][order][1:] != component[other][order][:-1]])
                start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
                other = other[order[np.arange(len(order)) - start < best]]
            a_out.append(np.full(len(other), rep[at]))
            b_out.append(rep[other])
        a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (a_out, b_out))
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return met.groupBy("band", "i", "j").applyInArrow(pair, "a long, b long")


def near_documents(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Reads ``doc_id`` and ``text`` only. ``component_id`` is the smallest id that links reach. Null, empty and
    blank texts have empty sets and link with nothing; texts of fewer words than a shingle are one shingle; rows that
    share an id are one node; a null id keeps its own row alone. An empty table gives no rows.
    """
    sketches = saved(sketch(docs), "sketches")
    classes = saved(
        sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")),
        "set-classes",
    )
    banded_ = banded(classes)
    firsts = banded_.groupBy("band").agg(F.min("rep").alias("b"), F.max("rep").alias("_last")).where("b < _last").select("band", "b")
    shared = saved(banded_.join(firsts, "band"), "shared-bands")
    stars = shared.where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    met = saved(shared.select(F.col("rep")).distinct(), "shared-classes")
    texts = saved(docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(met, "rep"), "shared-texts")
    tested = saved(likely(stars, classes, percent), "star-pairs")
    links = saved(verified(tested, texts, percent), "near-links")
    found = components(links)
    fine = saved(finer(texts), "fine-registers")
    for best in (BEST, None):
        more = saved(open_pairs(shared, fine, found, percent, best).join(tested, ["a", "b"], "left_anti"), "open-pairs")
        if more.isEmpty():
            # The best may all be tested pairs, so this tells nothing of the others.
            continue
        tested, links = tested.union(more), links.union(saved(verified(more, texts, percent), "near-links"))
        found = components(links)
    named = classes.select("set_key", "rep").join(found, F.col("rep") == F.col("id"), "left")
    named = named.select("set_key", F.coalesce("component", "rep").alias("_component"))
    out = sketches.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
