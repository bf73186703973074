"""Words of whole texts as numbers: many texts at once, by array operations over their UTF-8 bytes.

A word is a longest run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return.
"""

from dataclasses import dataclass

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_steps: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    if len(_steps["up"]) < n:
        inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
        for name, base in (("up", MULTIPLIER), ("down", inverse)):
            held = np.full(n, base, dtype=np.uint64)
            held[0] = 1
            _steps[name] = np.cumprod(held, dtype=np.uint64)
    return _steps["up"][:n], _steps["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """``hashes`` of all words; words ``first[i]`` to ``first[i + 1]`` are those of text ``i``;
    ``begin`` and ``end`` are their places in ``data``, the texts joined by blanks."""

    data: bytes
    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray


def words_of(texts: list[bytes | None]) -> Words:
    """All words of the texts; null and empty ones have none."""
    texts = [text or b"" for text in texts]
    data = b" ".join(texts)
    edges = np.concatenate([[0], np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))])
    raw = np.frombuffer(data, np.uint8)
    inner = np.zeros(len(raw) + 2, dtype=np.int8)
    inner[1:-1] = ~SPACE[raw]
    turn = np.diff(inner)
    begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    hashes = mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return Words(data, hashes, begin, end, np.searchsorted(begin, edges))


def runs(hashes: np.ndarray, n: int, salt: int = 1) -> np.ndarray:
    """One hash per ``n`` consecutive words, of the first word on; empty if there are fewer."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    up, _ = powers(n + 1)
    total = np.full(count, salt, dtype=np.uint64)
    for i in range(n):
        total += hashes[i : i + count] * up[i + 1]
    return mixed(total)


def together(texts: list[bytes | None], most: int = 1 << 20):
    """Slices (begin, end) of texts that are worked on at once: of about ``most`` bytes, one text at least."""
    begin = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text or b"") > most:
            yield begin, i
            begin, held = i, 0
        held += len(text or b"") + 1
    if begin < len(texts):
        yield begin, len(texts)
