"""Substring dedup by repeated-phrase automata.

1. Documents are dealt into blocks. The smallest 5-word hash of each 13-word window is its anchor; neighbouring
   windows mostly share one, and equal windows always do. Anchors of two documents or more are recurring.
2. Windows with a recurring anchor are confirmed by their own hash, which gives each its first document.
3. Each block compiles one Aho-Corasick automaton over words from the phrases that recur in it, 13 words each, with
   their first document, and streams all its documents through it: every occurrence in a later document goes.

Blocks and buckets exchange packed arrays of distinct hashes, so a phrase that a third of all documents holds is one
entry per block. The text is shuffled once and read by all three steps.
"""

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonecast.llm.store import aside, blocks_for
from zonecast.llm.tokens import release
from zonecast.llm.words import mixed, runs, together, words_of

PHRASE = 13
ANCHOR = 5
BLOCK_BYTES = 8 << 20
MESSAGE = "_bucket int, _block int, hashes binary, low binary, reach binary"
REPLY = "_block int, hashes binary, low binary"
NEVER = np.iinfo(np.int64).max


def planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane: equal high bytes stand together and compress away."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes, kind=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def windows_of(table: pa.Table, phrase: int, anchored: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, anchor and document id of every window of the table's documents, in order; null ids have none."""
    ids = table["doc_id"].to_pylist()
    texts = table["text"].cast(pa.binary()).to_pylist()
    hashes, anchors, docs = [], [], []
    for begin, end in together(texts):
        words = words_of([t if i is not None else None for t, i in zip(texts[begin:end], ids[begin:end], strict=True)])
        own = runs(words.hashes, phrase)
        counts = np.maximum(np.diff(words.first) - phrase + 1, 0)
        inside = np.ones(len(own), dtype=bool)
        for last in words.first[1:-1].tolist():
            inside[max(0, last - phrase + 1) : last] = False
        for first, last in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if last - first < phrase:
                inside[first:last] = False
        hashes.append(own[inside])
        docs.append(np.repeat(np.array([i or 0 for i in ids[begin:end]], dtype=np.int64), counts))
        if anchored:
            short = runs(words.hashes, min(ANCHOR, phrase), salt=3)
            low = short[: len(own)].copy()
            for shift in range(1, phrase - min(ANCHOR, phrase) + 1):
                np.minimum(low, short[shift : shift + len(own)], out=low)
            anchors.append(low[inside])
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *hashes]), np.concatenate([none, *anchors]), np.concatenate([np.empty(0, np.int64), *docs])


def extremes(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their smallest low and largest high, and each entry's place among the keys."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if len(keys) else np.empty(0, bool)
    starts = np.flatnonzero(new)
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    if not len(keys):
        return sorted_, low, high, place
    return sorted_[starts], np.minimum.reduceat(low[order], starts), np.maximum.reduceat(high[order], starts), place


def dealt(block: int, buckets: int, by: np.ndarray, hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Table:
    """One message per bucket that has entries."""
    bucket = (mixed(by) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    parts = [p for p in np.split(order, cuts) if len(p)]
    return pa.table(
        {
            "_bucket": pa.array([int(bucket[p[0]]) for p in parts], pa.int32()),
            "_block": pa.array([block] * len(parts), pa.int32()),
            "hashes": pa.array([hashes[p].tobytes() for p in parts], pa.binary()),
            "low": pa.array([planes(low[p]) for p in parts], pa.binary()),
            "reach": pa.array([planes(high[p] - low[p]) for p in parts], pa.binary()),
        }
    )


def answers(messages: pa.Table) -> pa.Table:
    """Of one bucket: to each block those of its hashes that a smaller document than its last one holds, with the first of all."""
    hashes = [np.frombuffer(h, np.uint64) for h in messages["hashes"].to_pylist()]
    low = [from_planes(x) for x in messages["low"].to_pylist()]
    high = [a + from_planes(x) for a, x in zip(low, messages["reach"].to_pylist(), strict=True)]
    _, first, _, place = extremes(np.concatenate(hashes), np.concatenate(low), np.concatenate(high))
    first, at = first[place], 0
    blocks, found, lows = [], [], []
    for block, own, last in zip(messages["_block"].to_pylist(), hashes, high, strict=True):
        mine = first[at : at + len(own)]
        at += len(own)
        good = mine < last
        if good.any():
            blocks.append(block)
            found.append(own[good].tobytes())
            lows.append(planes(mine[good]))
    return pa.table({"_block": pa.array(blocks, pa.int32()), "hashes": pa.array(found, pa.binary()), "low": pa.array(lows, pa.binary())})


def recurring(messages: pa.Table) -> pa.Table:
    """Of one bucket: to each block those of its hashes that two documents hold, anywhere."""
    hashes = [np.frombuffer(h, np.uint64) for h in messages["hashes"].to_pylist()]
    low = [from_planes(x) for x in messages["low"].to_pylist()]
    high = [a + from_planes(x) for a, x in zip(low, messages["reach"].to_pylist(), strict=True)]
    _, first, last, place = extremes(np.concatenate(hashes), np.concatenate(low), np.concatenate(high))
    more, at = (first < last)[place], 0
    blocks, found = [], []
    for block, own in zip(messages["_block"].to_pylist(), hashes, strict=True):
        good = more[at : at + len(own)]
        at += len(own)
        if good.any():
            blocks.append(block)
            found.append(own[good].tobytes())
    return pa.table({"_block": pa.array(blocks, pa.int32()), "hashes": pa.array(found, pa.binary()), "low": pa.array([b""] * len(blocks), pa.binary())})


def reply_of(replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All answers to a block: sorted hashes and their first documents."""
    hashes = np.concatenate([np.empty(0, np.uint64), *[np.frombuffer(h, np.uint64) for h in replies["hashes"].to_pylist()]])
    low = [from_planes(x) for x in replies["low"].to_pylist() if x]
    low = np.concatenate([np.empty(0, np.int64), *low]) if low else np.zeros(len(hashes), np.int64)
    order = np.argsort(hashes, kind="stable")
    return hashes[order], low[order]


def looked_up(hashes: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each hash, ``NEVER`` for an unknown one."""
    if not len(known):
        return np.full(len(hashes), NEVER)
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    return np.where(known[at] == hashes, values[at], NEVER)


def spans(repeat: np.ndarray, phrase: int) -> list[int]:
    """Starts of the windows, every ``phrase``-th of a run and its last, that cover all words of the runs."""
    edge = np.diff(np.concatenate([[0], repeat.view(np.int8), [0]]))
    out: list[int] = []
    for begin, end in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        out += range(begin, end - 1, phrase)
        out.append(end - 1)
    return out


def removed_words(texts: list[list[bytes]], ids: list[int | None], first: list[np.ndarray], phrase: int) -> list[np.ndarray | None]:
    """Which words of each document go; ``first`` holds the first document of each of its windows."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    index: dict[bytes, int] = {}
    numbered = [[index.setdefault(w, len(index)) for w in words] for words in texts]
    for words, doc, own in zip(numbered, ids, first, strict=True):
        if len(own):
            for at in spans(own < doc, phrase):
                automaton.add_word(tuple(words[at : at + phrase]), int(own[at]))
    out: list[np.ndarray | None] = [None] * len(texts)
    if not len(automaton):
        return out
    automaton.make_automaton()
    for i, (words, doc) in enumerate(zip(numbered, ids, strict=True)):
        if doc is None or len(words) < phrase:
            continue
        ends = [end for end, holder in automaton.iter(tuple(words)) if holder < doc]
        if ends:
            step = np.zeros(len(words) + 1, dtype=np.int32)
            np.add.at(step, np.array(ends) - phrase + 1, 1)
            np.add.at(step, np.array(ends) + 1, -1)
            out[i] = np.cumsum(step)[:-1] > 0
    return out


def drop_repeats(docs: DataFrame, phrase: int = PHRASE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the words of repeated phrases, and with ``n_words`` and ``n_removed``.

    A word goes if a window of ``phrase`` words covers it whose words also start in a document of a smaller
    ``doc_id``; windows are those of the input. A text that loses words becomes its other words joined by one
    blank; every other text stays as it is. Null, empty and short texts stay, as do those of a null id, which is
    never smaller either; rows that share an id do not repeat each other; an empty table gives an empty one.
    Other columns stay, whatever their names, except older ``n_words`` and ``n_removed``.
    """
    docs, back = aside(docs, ("_block",))
    blocks = blocks_for(docs, "text", block_bytes)
    kept = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    table = docs.select(*[F.col(c).cast("long") if c == "doc_id" else F.col(c) for c in kept], block.alias("_block"))

    def anchors(key: tuple, own: pa.Table) -> pa.Table:
        release()
        _, found, ids = windows_of(own, phrase, True)
        keys, low, high, _ = extremes(found, ids, ids)
        return dealt(key[0].as_py(), blocks, keys, keys, low, high)

    def confirmed(key: tuple, own: pa.Table, replies: pa.Table) -> pa.Table:
        release()
        known, values = reply_of(replies)
        if not len(known):
            return dealt(0, blocks, known, known, values, values)
        hashes, found, ids = windows_of(own, phrase, True)
        good = looked_up(found, known, values) != NEVER
        hashes, found, ids = hashes[good], found[good], ids[good]
        keys, low, high, place = extremes(hashes, ids, ids)
        by = np.empty(len(keys), np.uint64)
        by[place] = found
        return dealt(key[0].as_py(), blocks, by, keys, low, high)

    def cleaned(key: tuple, own: pa.Table, replies: pa.Table) -> pa.Table:
        release()
        known, values = reply_of(replies)
        ids = own["doc_id"].to_pylist()
        texts = own["text"].cast(pa.binary()).to_pylist()
        hashes, _, _ = windows_of(own, phrase, False)
        first = looked_up(hashes, known, values)
        split = [(t or b"").split() for t in texts]
        counts = [max(0, len(w) - phrase + 1) if i is not None else 0 for w, i in zip(split, ids, strict=True)]
        per = np.split(first, np.cumsum(counts)[:-1]) if counts else []
        gone = removed_words(split, ids, per, phrase)
        for i, (words, drop) in enumerate(zip(split, gone, strict=True)):
            if drop is not None:
                texts[i] = b" ".join([w for w, out in zip(words, drop.tolist(), strict=True) if not out])
        at = own.column_names.index("text")
        out = own.set_column(at, "text", pa.array(texts, pa.binary()).cast(pa.string())).drop_columns(["_block"])
        out = out.append_column("n_words", pa.array([len(w) for w in split], pa.int64()))
        return out.append_column("n_removed", pa.array([0 if g is None else int(g.sum()) for g in gone], pa.int64()))

    by_block = table.groupBy("_block")
    found = by_block.applyInArrow(anchors, MESSAGE).groupBy("_bucket").applyInArrow(recurring, REPLY)
    first = by_block.cogroup(found.groupBy("_block")).applyInArrow(confirmed, MESSAGE).groupBy("_bucket").applyInArrow(answers, REPLY)
    schema = T.StructType([*[f for f in table.schema if f.name != "_block"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return by_block.cogroup(first.groupBy("_block")).applyInArrow(cleaned, schema).withColumnsRenamed(back)
