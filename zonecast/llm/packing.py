"""Best-fit packing of tokenized documents by exact complements of lengths.

Only lengths matter for a plan, and there are at most ``capacity`` of them, so the driver plans on the counts
per length: single, pair and triple sums are looked up for a combination that exactly fills a gap, as
often as all its lengths are available; what has no exact complement takes the longest length that fits, and
its smaller gap is looked up again. The plan says: of length L, the pieces ranked ``first`` to ``first + count``
go to the sequences from ``sequence`` on, at ``offset``. Executors give pieces their ranks by counts per
(partition, length), so no piece is sorted and none but the counts is shuffled.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonecast.llm.store import saved
from zonecast.llm.tokens import opened

CAPACITY = 2048
PIECES = "part int, doc_id long, piece int, start long, length int, rank long, ids binary"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``part, doc_id, piece, start, length, rank, ids``: every whole text's ids and ``end_id``, cut only where
    longer than ``capacity``; ``rank`` counts the partition's earlier pieces of the same length.

    Reads ``doc_id`` and ``text`` only. A null or empty text is the end id alone; repeated rows are pieces of
    their own; an empty table gives no pieces. The table is written once, for ranks must not change.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = opened(tokenizer), np.uint32(end_id).astype("<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc_id, ids in zip(some.column(0).to_pylist(), words.ids_of(some.column(1).to_pylist()), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        cut = ids[4 * start : 4 * (start + capacity)]
                        length = len(cut) // 4
                        rows.append((part, doc_id, piece, start, length, int(seen[length]), cut))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    return saved(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, PIECES), "pieces")


SCHEMA = pa.schema(
    [
        ("part", pa.int32()),
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int32()),
        ("rank", pa.int64()),
        ("ids", pa.binary()),
    ]
)


class Lengths:
    """Counts per length, with pointers that index pair and triple sums.

    Counts only fall, so a length found used up stays so: a pointer per sum moves down over its first
    length once and never back.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = [0] * (capacity + 1)
        for length, count in counts.items():
            self.left[length] = count
        self.pair = list(range(capacity + 1))
        self.triple = list(range(capacity + 1))
        self.longest = list(range(capacity + 1))

    def has_pair(self, a: int, b: int) -> bool:
        return self.left[a] > 0 and self.left[b] > 0 and (a != b or self.left[a] > 1)

    def pair_of(self, total: int) -> tuple[int, ...]:
        """Two available lengths of this sum, the longer one as long as possible."""
        a = min(self.pair[total], total - 1)
        while 2 * a >= total and not self.has_pair(a, total - a):
            a -= 1
        self.pair[total] = a
        return (a, total - a) if 2 * a >= total and a > 0 else ()

    def triple_of(self, total: int) -> tuple[int, ...]:
        """Three available lengths of this sum."""
        a = min(self.triple[total], total - 2)
        while a > 0:
            if self.left[a] > 0:
                self.left[a] -= 1
                rest = self._pair_now(total - a)
                self.left[a] += 1
                if rest:
                    break
            a -= 1
        self.triple[total] = max(a, 0)
        return (a, *rest) if a > 0 else ()

    def _pair_now(self, total: int) -> tuple[int, ...]:
        """A pair beside a length held for the moment; the pointer may not move for that length's sake."""
        a = min(self.pair[total], total - 1)
        while 2 * a >= total and not self.has_pair(a, total - a):
            a -= 1
        return (a, total - a) if 2 * a >= total and a > 0 else ()

    def exact(self, gap: int) -> tuple[int, ...]:
        if gap <= 0:
            return ()
        return ((gap,) if self.left[gap] > 0 else ()) or self.pair_of(gap) or self.triple_of(gap)

    def fitting(self, gap: int) -> int:
        """The longest available length up to ``gap``; 0 if there is none."""
        path, at = [], gap
        while at > 0 and not self.left[at]:
            path.append(at)
            at = self.longest[at] if self.longest[at] < at else at - 1
        for passed in path:
            self.longest[passed] = at
        return at


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows ``length, first rank, count, first sequence, offset`` and the number of sequences."""
    lengths, rows, sequences = Lengths(counts, capacity), [], 0
    used = [0] * (capacity + 1)
    for length in range(capacity, 0, -1):
        while lengths.left[length]:
            pattern, gap = [length], capacity - length
            lengths.left[length] -= 1
            while gap:
                more = lengths.exact(gap)
                if not more:
                    fit = lengths.fitting(gap)
                    more = (fit,) if fit else ()
                if not more:
                    break
                for x in more:
                    lengths.left[x] -= 1
                pattern += more
                gap -= sum(more)
            per = {x: pattern.count(x) for x in set(pattern)}
            again = min(lengths.left[x] // n for x, n in per.items())
            for x, n in per.items():
                lengths.left[x] -= again * n
            times, offset = again + 1, 0
            for x in pattern:
                rows.append((x, used[x], times, sequences, offset))
                used[x] += times
                offset += x
            sequences += times
    return np.array(rows, dtype=np.int64).reshape(-1, 5), sequences


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of ``cut_pieces`` with their ``sequence_id`` and ``offset``; all other columns stay.

    Sequences are filled gapless from offset 0. The driver gets one count per length, ``capacity`` at most,
    and the plan's size follows from ``capacity`` too, never from the number of pieces.
    """
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, _ = plan(counts, capacity)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    keys = (rows[:, 0] << 44) + rows[:, 1]
    table = pieces.sparkSession.sparkContext.broadcast((keys, rows[:, 1], rows[:, 3], rows[:, 4]))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, first, sequence, offset = table.value
        at = np.searchsorted(keys, (length.to_numpy(np.int64) << 44) + rank.to_numpy(np.int64), "right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + rank.to_numpy() - first[at], "offset": offset[at]})

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_earlier"))
    ranked = pieces.join(ranks, ["part", "length"])
    return ranked.withColumn("_place", place("length", F.col("rank") + F.col("_earlier"))).select(
        *[F.col(c) for c in pieces.columns], "_place.sequence_id", "_place.offset"
    )
