"""Token ids as directly addressable codes, in files that give any token back without decoding a block.

Each id is cut into chunks of ``BITS`` bits, low chunk first. Level 0 holds the low chunk of every id and a
bitmap that tells which ids go on; level 1 holds the next chunk of those alone, and so on. A rank directory
counts the set bits before every ``RANK_BITS`` bits, so the place of an id's next chunk is one lookup and one
short count. A run of ids is a run on every level, so a document is read without touching its neighbours.

The files are a Parquet table of segments that any store Spark writes to can hold: one row per segment
with its image, its documents and their places. Segments follow one another in ascending document order.
"""

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.llm.tokens import opened

BITS = 8
RANK_BITS = 512
MAGIC = b"ZDAC"
SEGMENT_TOKENS = 1 << 20
FILES = "part int, segment int, first_token long, n_tokens long, doc_ids array<bigint>, starts array<bigint>, image binary"


def encode(ids: np.ndarray) -> bytes:
    """The image of one segment: header, then per level its size, chunks, bitmap and rank directory."""
    rest, levels = np.asarray(ids, dtype=np.uint32), []
    while True:
        more = (rest >> BITS) > 0
        last = not more.any()
        chunks = (rest & 0xFF).astype(np.uint8).tobytes()
        bitmap, ranks = b"", b""
        if not last:
            bitmap = np.packbits(more, bitorder="little").tobytes()
            whole = bitmap.ljust(-(-len(more) // RANK_BITS) * RANK_BITS // 8, b"\0")
            counts = np.bitwise_count(np.frombuffer(whole, np.uint64)).reshape(-1, RANK_BITS // 64).sum(axis=1, dtype=np.int64)
            ranks = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4").tobytes()
        levels.append((len(rest), chunks, bitmap, ranks))
        if last:
            break
        rest = rest[more] >> BITS
    head = MAGIC + struct.pack("<BBI", BITS, len(levels), RANK_BITS)
    body = [struct.pack("<QQQ", n, len(bitmap), len(ranks)) + chunks + bitmap + ranks for n, chunks, bitmap, ranks in levels]
    return head + b"".join(body)


class Codes:
    """Reads an image: ``codes[i]`` and ``codes.run(begin, end)``."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("Not a file of directly addressable codes")
        self.bits, count, self.rank_bits = struct.unpack_from("<BBI", image, 4)
        at, self.levels = 4 + struct.calcsize("<BBI"), []
        for _ in range(count):
            n, bitmap, ranks = struct.unpack_from("<QQQ", image, at)
            at += 24
            self.levels.append(
                (
                    np.frombuffer(image, np.uint8, n, at),
                    np.frombuffer(image, np.uint8, bitmap, at + n),
                    np.frombuffer(image, "<u4", ranks // 4, at + n + bitmap),
                )
            )
            at += n + bitmap + ranks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, i: int) -> int:
        """Set bits before bit ``i``."""
        _, bitmap, ranks = self.levels[level]
        if i == 0 or not len(ranks):
            return 0
        block = min(i // self.rank_bits, len(ranks) - 1)
        begin = block * self.rank_bits // 8
        bits = np.unpackbits(bitmap[begin : -(-i // 8)], bitorder="little")[: i - begin * 8]
        return int(ranks[block]) + int(bits.sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = shift = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not len(bitmap) or not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(level, i), shift + self.bits
        return value

    def run(self, begin: int, end: int) -> np.ndarray:
        """Ids ``begin`` to ``end`` (exclusive)."""
        out = np.zeros(max(0, end - begin), dtype=np.uint32)
        where, shift = np.arange(len(out)), 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            out[where] |= chunks[begin:end].astype(np.uint32) << shift
            if not len(bitmap) or begin == end:
                break
            bits = np.unpackbits(bitmap[begin >> 3 : -(-end // 8)], bitorder="little")
            more = bits[begin & 7 : (begin & 7) + end - begin].astype(bool)
            begin = self._rank(level, begin)
            where, end, shift = where[more], begin + int(more.sum()), shift + self.bits
        return out


def write_codes(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Tokenize every whole text, append ``end_id`` and write the ids in ascending ``doc_id`` order.

    Reads ``doc_id`` and ``text`` only, whatever else the table holds. A null text is an empty one; null ids
    come first; rows that share an id follow each other by text. An empty table gives files without
    segments. A document never spans two segments; a very long one is a segment of its own.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = opened(tokenizer), np.uint32(end_id).astype("<u4").tobytes()
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        doc_ids, starts, held, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            image = encode(np.frombuffer(b"".join(held), "<u4"))
            row = {"part": part, "segment": segment, "first_token": first, "n_tokens": size, "doc_ids": doc_ids, "starts": starts, "image": image}
            return pa.RecordBatch.from_pylist([row], schema=SEGMENTS)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.ids_of(batch.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                if size and size + n > segment_tokens:
                    yield flush()
                    segment, first = segment + 1, first + size
                    doc_ids, starts, held, size = [], [], [], 0
                doc_ids.append(doc_id)
                starts.append(size)
                held.append(ids)
                size += n
        if size:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(segments, FILES).write.option("compression", "zstd").parquet(path)


SEGMENTS = pa.schema(
    [
        ("part", pa.int32()),
        ("segment", pa.int32()),
        ("first_token", pa.int64()),
        ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("starts", pa.list_(pa.int64())),
        ("image", pa.binary()),
    ]
)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files: ``doc_id, start, n_tokens, ids`` (ids as little-endian unsigned 32-bit).

    ``start`` counts the ids of all documents before it. The driver sees one number per written
    partition, the sum of its ids.
    """
    files = spark.read.schema(FILES).parquet(path)
    base, before = {}, 0
    for row in sorted(files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        base[row["part"]], before = before, before + row["n"]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cells = {name: batch.column(name)[row] for name in ("part", "first_token", "n_tokens", "doc_ids", "starts", "image")}
                codes = Codes(cells["image"].as_py())
                starts = cells["starts"].as_py()
                ends = [*starts[1:], cells["n_tokens"].as_py()]
                first = base[cells["part"].as_py()] + cells["first_token"].as_py()
                for at in range(0, len(starts), 512):
                    some = list(zip(starts[at : at + 512], ends[at : at + 512], strict=True))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(cells["doc_ids"].as_py()[at : at + 512], pa.int64()),
                            "start": pa.array([first + a for a, _ in some], pa.int64()),
                            "n_tokens": pa.array([b - a for a, b in some], pa.int64()),
                            "ids": pa.array([codes.run(a, b).astype("<u4").tobytes() for a, b in some], pa.binary()),
                        }
                    )

    return files.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")
