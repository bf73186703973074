"""Filter interaction audit by contingency tensor contractions.

Five filters judge every text. Per part, documents are counted by which filters they fail, a 2x2x2x2x2 tensor with one axis
(pass, fail) per filter. What a step of an order keeps, removes or finds removed already is a contraction of that tensor
with a selector per axis: pass for the filters before it, fail for its own, all for those that follow.
"""

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
MEASURES = ["n", "n_good", "n_toxic"]
AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def conditions(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that need nothing but the text."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, fails, good, toxic, n``: how many documents of a part and a label fail exactly the filters of a bit mask.

    Filter E, a text that a smaller id holds too, needs no join of texts: documents of equal text and label
    differ in their id alone, so a class of them fails as a whole but for those of the text's smallest id. Rows are counted by
    id, then by class, before any text's classes meet, so a text that a third of all rows share is one row per class there.
    """
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    own = sum((F.when(failed, bit(name)).otherwise(0) for name, failed in conditions(text).items()), F.lit(0))
    # Rows without an id match no label; their digest deals them out.
    rows = docs.select(
        "doc_id",
        F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0).alias("spread"),
        F.coalesce("lang", F.lit("")).alias("part"),
        digest.alias("digest"),
        own.alias("own"),
    )
    marks = (
        labels.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
        .withColumn("spread", F.lit(0).cast("long"))
    )
    marked = rows.join(marks, ["doc_id", "spread"], "left").withColumns(
        {name: F.coalesce(name, F.lit(False)) for name in ("good", "toxic")}
    )
    kind = ["digest", "part", "own", "good", "toxic"]
    by_id = marked.groupBy("doc_id", "spread", *kind).agg(F.count("*").alias("n"))
    classes = by_id.groupBy(kind).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n"))).alias("known"),
        F.min("doc_id").alias("least"),
        F.min_by("n", "doc_id").alias("of_least"),
    )
    text_least = F.expr("min(least) OVER (PARTITION BY digest)")
    spared = F.when(F.col("least") == text_least, F.col("of_least")).otherwise(0)
    later = F.coalesce(F.col("known") - spared, F.lit(0))
    both = F.array(
        F.struct(F.col("own").alias("fails"), (F.col("n") - F.col("later")).alias("n")),
        F.struct((F.col("own") + bit("E")).alias("fails"), F.col("later").alias("n")),
    )
    return classes.withColumn("later", later).select("part", "good", "toxic", F.inline(both)).where("n > 0")


def selectors(orders: list[str], before, own, after) -> list[np.ndarray]:
    """One array (order and step, 2) per filter: what its axis keeps while the step's filter and those around it are judged."""
    out = [np.empty((len(orders) * len(FILTERS), 2), dtype=np.int64) for _ in FILTERS]
    for i, order in enumerate(orders):
        for step in range(len(FILTERS)):
            for place, name in enumerate(order):
                chosen = before if place < step else own if place == step else after
                out[FILTERS.index(name)][i * len(FILTERS) + step] = chosen
    return out


def contracted(tensor: np.ndarray, chosen: list[np.ndarray]) -> np.ndarray:
    """(measures, steps): each measure's 2x2x2x2x2 tensor summed over what every step selects."""
    return np.einsum("mabcde,sa,sb,sc,sd,se->ms", tensor, *chosen, optimize=True)


ORDERS = ["".join(order) for order in permutations(FILTERS)]
STEPS = {
    "kept": selectors(ORDERS, PASS, PASS, ALL),
    "removed": selectors(ORDERS, PASS, FAIL, ALL),
    "failing": selectors(ORDERS, ALL, FAIL, ALL),
    "unique": selectors(ORDERS, PASS, FAIL, PASS),
}


def steps_of(tensor: np.ndarray) -> dict[str, np.ndarray]:
    """All steps of all orders for one part; ``tensor`` is (3, 2, 2, 2, 2, 2): all, good and toxic documents."""
    kept, removed, failing, unique = (contracted(tensor, STEPS[name]) for name in ("kept", "removed", "failing", "unique"))
    own = np.array([FILTERS.index(name) for order in ORDERS for name in order])
    shares = np.zeros(len(FILTERS), dtype=np.int64)
    np.add.at(shares, own, removed[0])
    return {
        "filter_order": np.repeat(np.array(ORDERS, dtype=object), len(FILTERS)),
        "step": np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS)),
        "kept": kept[0],
        "removed": removed[0],
        "redundant": failing[0] - removed[0],
        "unique_fails": unique[0],
        "good_lost": removed[1],
        "toxic_lost": removed[2],
        "shapley": shares[own],
    }


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each of five filters keeps, removes and finds removed at each step of each of the 120 orders, per part.

    ``docs`` has ``doc_id, text, lang``, ``labels`` has ``doc_id, quality, toxic``; other columns are not read. A part is a
    value of ``lang``, null and empty are one part ``''``. Null texts are empty. A document is good (toxic) if any label row of its
    id has quality (toxic) 1; null marks and labels of unknown or null ids mark nothing. Rows that share id and text are
    documents of their own, none of them later than the other; a row without an id repeats no text and makes no other
    one a repeat. Each part has 600 rows, zeros included; an empty table gives none.
    """
    counts = (
        judged(docs, labels)
        .groupBy("part", "fails")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"),
            F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n_toxic"),
        )
    )

    def contract(cells: pd.DataFrame) -> pd.DataFrame:
        """At most 32 rows, one per set of failed filters."""
        flat = np.zeros((len(MEASURES), 1 << len(FILTERS)), dtype=np.int64)
        flat[:, cells["fails"].to_numpy()] = cells[MEASURES].to_numpy(dtype=np.int64).T
        # The last axis of the reshaped tensor is the lowest bit, so the axes are turned into the order of the letters.
        tensor = flat.reshape(len(MEASURES), *[2] * len(FILTERS)).transpose(0, *range(len(FILTERS), 0, -1))
        return pd.DataFrame({"part": cells["part"].iloc[0], **steps_of(tensor)})

    return counts.groupBy("part").applyInPandas(contract, AUDIT)
