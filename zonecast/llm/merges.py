"""Merges of a byte-level BPE file, applied to many short pieces at once by array operations."""

import heapq

import numpy as np

# Pieces up to this many bytes are merged side by side.
SHORT = 32
WIDTHS = (6, 9, 12, 18, SHORT)
NONE = np.iinfo(np.int32).max
SLOTS = 1 << 20


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def slots(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


class MergeTable:
    """Which pairs of ids merge, at what rank and into what: as a dict, and as a hash table of arrays."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[left], vocab[right]] = (rank, vocab[left + right])
        pairs = np.array(list(self.pairs), dtype=np.int64).reshape(-1, 2)
        rank, made = np.array(list(self.pairs.values()), dtype=np.int64).reshape(-1, 2).T
        self.made_by = np.zeros(max(rank, default=0) + 1, dtype=np.int32)
        self.made_by[rank] = made
        keys = (pairs[:, 0] << 32) | pairs[:, 1]
        self.slot_keys, self.slot_ranks = np.full(SLOTS, -1, dtype=np.int64), np.full(SLOTS, NONE, dtype=np.int32)
        self.probes = 1
        for key, slot, r in zip(keys.tolist(), slots(keys).tolist(), rank.tolist(), strict=True):
            probes = 1
            while self.slot_keys[slot] >= 0:
                slot, probes = (slot + 1) & (SLOTS - 1), probes + 1
            self.slot_keys[slot], self.slot_ranks[slot] = key, r
            self.probes = max(self.probes, probes)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NONE for those that do not merge: the pairs' slots, then the next ones while a slot holds another pair."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64) & 0xFFFFFFFF
        slot = slots(keys)
        out = np.full(len(keys), NONE, dtype=np.int32)
        for _ in range(self.probes):
            hit = self.slot_keys[slot] == keys
            out[hit] = self.slot_ranks[slot[hit]]
            slot = (slot + 1) & (SLOTS - 1)
        return out

    def ids_of_all(self, pieces: list[bytes], inner: np.ndarray, last: np.ndarray) -> list[bytes]:
        """Ids of pieces, little-endian unsigned 32-bit; their bytes begin as the ids ``inner``, a piece's last one as ``last``.

        Short pieces of like length are merged side by side, long ones by a heap.
        """
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        out: list[bytes] = [b""] * len(pieces)
        for low, high in zip((0, *WIDTHS[:-1]), WIDTHS, strict=True):
            some = np.flatnonzero((sizes > low) & (sizes <= high))
            if not len(some):
                continue
            chosen = some.tolist()
            raw = np.frombuffer(b"".join(pieces[i].ljust(high, b"\0") for i in chosen), np.uint8).reshape(-1, high)
            ends = sizes[some] - 1
            ids = np.where(np.arange(high) <= ends[:, None], inner[raw], -1).astype(np.int32)
            rows = np.arange(len(some))
            ids[rows, ends] = last[raw[rows, ends]]
            for i, got in zip(chosen, self.merged_rows(ids), strict=True):
                out[i] = got
        for i in np.flatnonzero(sizes > SHORT).tolist():
            ids = inner[np.frombuffer(pieces[i], np.uint8)].tolist()
            ids[-1] = int(last[pieces[i][-1]])
            out[i] = np.array(self.merged(ids), "<u4").tobytes()
        return out

    def merged_rows(self, ids: np.ndarray) -> list[bytes]:
        """Rows of ids, padded by -1, with the rank of each pair of neighbours; a round merges every row's leftmost pair of least rank."""
        n, width = ids.shape
        columns = np.arange(width)
        ranks = np.full((n, width), NONE, dtype=np.int32)
        ranks[:, :-1] = self.ranks_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        done, open_rows = np.full((n, width), -1, dtype=np.int32), np.arange(n)
        while len(open_rows):
            rows = np.arange(len(open_rows))
            at = ranks.argmin(axis=1)
            least = ranks[rows, at]
            ended = least == NONE
            if ended.any():
                done[open_rows[ended]] = ids[ended]
                go = ~ended
                open_rows, ids, ranks, at, least = open_rows[go], ids[go], ranks[go], at[go], least[go]
                rows = np.arange(len(open_rows))
            new = self.made_by[least]
            right = columns[:-1] > at[:, None]
            ids[:, :-1] = np.where(right, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ids[rows, at] = new
            right |= columns[:-1] == at[:, None]
            ranks[:, :-1] = np.where(right, ranks[:, 1:], ranks[:, :-1])
            left, after = np.maximum(at - 1, 0), np.minimum(at + 1, width - 1)
            ranks[rows, at] = self.ranks_of(new, ids[rows, after])
            before = self.ranks_of(ids[rows, left], new)
            some = at > 0
            ranks[rows[some], left[some]] = before[some]
        held = done >= 0
        data, ends = done[held].astype("<u4").tobytes(), (4 * np.cumsum(held.sum(axis=1))).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merged(self, ids: list[int]) -> list[int]:
        """Merges of least rank first, of equal ones the leftmost: a heap over a linked list of symbols."""
        pairs, ids, n = self.pairs, list(ids), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*pairs[pair], i, pair) for i, pair in enumerate(zip(ids[:-1], ids[1:], strict=True)) if pair in pairs]
        heapq.heapify(heap)
        while heap:
            _, new, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (new, ids[k]) in pairs:
                    heapq.heappush(heap, (*pairs[new, ids[k]], i, (new, ids[k])))
            h = before[i]
            if h >= 0 and (ids[h], new) in pairs:
                heapq.heappush(heap, (*pairs[ids[h], new], h, (ids[h], new)))
        return [i for i in ids if i >= 0]
