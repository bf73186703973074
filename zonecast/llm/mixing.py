"""Mixing sources to target weights: hash-random keys, range sort, distributed prefix sums, exact cuts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonecast.llm.store import aside, saved

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SEED = "mix"


def n_words(text) -> F.Column:
    """Words of a whole text as a long; 0 for a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> dict:
    """Source -> target. Sources by code point, null last, weigh ``weights`` in turn.

    They share the sum of all sizes by weight; a target stops at ``most`` times its source's size and the
    excess is shared by weight among the others, until none is above.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    open_ = {name: (weights[i % len(weights)], size) for i, (name, size) in enumerate(order)}
    rest, fixed = sum(size for _, size in sizes), {}
    while open_:
        shared = sum(w for w, _ in open_.values())
        above = [name for name, (w, size) in open_.items() if most * size * shared < w * rest]
        if not above:
            break
        for name in above:
            fixed[name] = float(most * open_[name][1])
            rest -= most * open_.pop(name)[1]
    return fixed | {name: w * rest / shared for name, (w, _) in open_.items()}


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row of ``docs``.

    Reads ``doc_id``, ``source`` and ``text`` only. Within a source rows stand in the order of a hash of their
    id. The budget, the target rounded to whole words, covers the source in whole epochs and then its first
    documents in that order; the last of them gives only the words still missing, so the sum is exact.
    Null texts have size 0 and take nothing; a null source is a source, the last one; rows of one id are
    ordered by size, and like rows may change places; an empty table gives an empty result.

    The driver sees one row per source and one number per (partition, source).
    """
    return decided(docs, (), weights, most, seed)


def targets_within(sizes: list[tuple], weights: tuple[int, ...], most: int) -> list[tuple]:
    """``(*group, source, size)`` with each one's target behind: ``targets`` of each group by itself, the weights by the order of all sources."""
    names, groups = {s[-2] for s in sizes}, {s[:-2] for s in sizes}
    own = {s[:-1]: s[-1] for s in sizes}
    wanted = {group: targets([(name, own.get((*group, name), 0)) for name in names], weights, most) for group in groups}
    return [(*s, float(wanted[s[:-2]][s[-2]])) for s in sorted(sizes, key=lambda s: [(v is None, v or "") for v in s[:-1]])]


def decided(docs: DataFrame, row: tuple[str, ...], weights: tuple[int, ...], most: int, seed: str, within: tuple[str, ...] = ()) -> DataFrame:
    """``mix`` with the columns ``row``, which come last in the order of a source's rows, in front.

    Each group of like values of the text columns ``within`` is a mix of its own.
    """
    spark = docs.sparkSession
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)))
    sized = saved(docs.select(*row, *within, "doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("_key")), "mix-sizes")
    keys = [*within, "source"]
    found = [tuple(r) for r in sized.groupBy(*keys).agg(F.sum("size").alias("size")).collect()]
    names = [f"_name{i}" for i in range(len(keys))]
    sources = spark.createDataFrame(
        [(i, *known) for i, known in enumerate(targets_within(found, weights, most))],
        f"_s int, {', '.join(f'{name} string' for name in names)}, source_size long, target double",
    )
    same = [F.col(key).eqNullSafe(F.col(name)) for key, name in zip(keys, names, strict=True)]
    known = sized.join(sources, same).drop(*names, *within)
    line = ("_s", "_key", "doc_id", "size", *row)
    ranged = saved(known.repartitionByRange(*line).withColumn("_part", F.spark_partition_id()), "mix-ranges")
    totals = ranged.groupBy("_part", "_s").agg(F.sum("size").alias("_n"))
    earlier = Window.partitionBy("_s").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_part", "_s", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_part", "_s").orderBy("_key", "doc_id", "size", *row).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_base") + F.coalesce(F.sum("size").over(within), F.lit(0))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return ranged.join(base, ["_part", "_s"]).select(
        *row, "doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + cut).cast("long").alias("taken")
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED, within: tuple[str, ...] = ()) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a document taken twice is two rows, one not taken is gone.

    Rows of like values of the columns ``within`` are a mix of their own: the sources share the words of that group.

    A document whose words are taken in part ends at its last word taken. Decisions meet their rows by a key of the row that
    is made once in a written table, so rows without an id and rows that share one are taken like all others. Other columns stay,
    whatever their names.
    """
    docs, back = aside(docs, ("_row", "_size", "_taken", "_copy"))
    docs, columns = saved(docs.withColumn("_row", F.monotonically_increasing_id()), "mix-rows"), docs.columns
    taken = decided(docs, ("_row",), weights, most, seed, within).where("taken > 0").select("_row", F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    copies = F.sequence(F.lit(0), F.ceil(F.col("_taken") / F.col("_size")).cast("int") - 1)
    rows = docs.join(taken, "_row").withColumn("_copy", F.explode(copies))
    words = F.col("_taken") - F.col("_copy") * F.col("_size")
    kept = F.slice(F.regexp_extract_all(F.col("text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), words.cast("int"))
    text = F.when(words < F.col("_size"), F.concat_ws("", kept)).otherwise(F.col("text"))
    return rows.select(*[text.alias(c) if c == "text" else F.col(c) for c in columns]).withColumnsRenamed(back)
