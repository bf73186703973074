"""Token ids of whole texts by a public tokenizer file, with a word cache per Python worker.

The tokenizer's pre-tokens never reach over a blank or a line end, so a text's ids are those of its
parts between blanks, one after the other. Parts repeat, hence each worker encodes a part once and
keeps its ids. Ids stay little-endian unsigned 32-bit bytes throughout.
"""

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from zonecast.llm.merges import MergeTable, byte_names

PUNCTUATION = ".,;:!?"
# So many texts are cut at once, and so many characters of them beside the last.
TOGETHER, TOGETHER_CHARS = 1024, 1 << 21
# A line of letters up to U+00FF and a tail that is a pre-token of its own, or any other line.
SHAPES = re.compile("^([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?#$%&*)\\]}\"]*)$|^(.+)$", re.MULTILINE).findall
_opened: dict[str, "WordIds"] = {}


def opened(path: str) -> "WordIds":
    """The worker's encoder for this file; it lives as long as the worker."""
    if path not in _opened:
        _opened[path] = WordIds(path)
    return _opened[path]


def release() -> None:
    """Let go of all kept parts. Workers outlive stages, so tasks that need memory for other things call this."""
    for kept in _opened.values():
        kept.known.clear()
        kept.cores.clear()


def chunks(texts: list[str | None], most: int) -> Iterator[list[str | None]]:
    """Runs of up to ``most`` texts that end with the text that reaches ``TOGETHER_CHARS``."""
    begin = chars = 0
    for end, text in enumerate(texts, 1):
        chars += len(text or "")
        if end - begin == most or chars >= TOGETHER_CHARS or end == len(texts):
            yield texts[begin:end]
            begin, chars = end, 0


def gathered(ids: list[bytes], index: np.ndarray, bounds: np.ndarray) -> Iterator[bytes]:
    """The joined ids of the parts ``index[a:b]`` for each two neighbours a and b of ``bounds``."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    begins, own = np.cumsum(sizes) - sizes, sizes[index]
    ends = np.concatenate([[0], np.cumsum(own)])
    at = np.repeat(begins[index] - ends[:-1], own)
    at += np.arange(len(at))
    data, cuts = np.frombuffer(b"".join(ids), "<u4")[at].tobytes(), (4 * ends[bounds]).tolist()
    for begin, end in pairwise(cuts):
        yield data[begin:end]


class WordIds:
    """``known`` has the ids of parts and of their folded words, ``cores`` those of pieces that the library encodes; ``parts`` and
    ``pieces`` bound them. A full cache starts anew, ids stay the same."""

    def __init__(self, path: str, parts: int = 1_000_000, pieces: int = 100_000, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts, self.pieces, self.longest = parts, pieces, longest
        self.known: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        model = json.loads(self.tokenizer.to_str())["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.merges = MergeTable(vocab, model["merges"])
        names = [name for name, _ in sorted(byte_names().items(), key=lambda item: item[1])]
        self.inner, self.last = (np.array([vocab[name + end] for name in names], dtype=np.int32) for end in ("", suffix))

    def ids(self, text: str | None) -> bytes:
        """All ids of one text; nothing for a null or empty one."""
        return next(self.ids_of([text]))

    def ids_of(self, texts: list[str | None], together: int = TOGETHER) -> Iterator[bytes]:
        """The ids of each text in turn. Up to ``together`` texts are cut into parts at once, each distinct part of them is looked up once, and
        the ids of all parts are gathered by its number; parts not met before are encoded together."""
        known = self.known
        for group in chunks(texts, together):
            some = pc.fill_null(pa.array(group, pa.large_string()), "")
            cut = pc.split_pattern(pc.replace_substring(some, "\n", " "), " ")
            coded = cut.flatten().dictionary_encode()
            parts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            if len(known) > self.parts:
                known.clear()
            if len(self.cores) > self.pieces:
                self.cores.clear()
            found = list(map(known.get, parts))
            new = [i for i, own in enumerate(found) if own is None]
            long = self._learn([parts[i] for i in new]) if new else []
            for i in new:
                found[i] = known[parts[i]]
            yield from gathered(found, coded.indices.to_numpy(), cut.offsets.to_numpy())
            # Long parts are never kept, so each of them is among the new ones.
            for part in long:
                known.pop(part, None)
                self.cores.pop(part, None)

    def _learn(self, new: list[str]) -> list[str]:
        """Gives all new parts, each of them named once, their ids and returns what is too long to be kept.

        Letters up to U+00FF are one pre-token: case is folded here and only merges are left.
        """
        known, cores = self.known, self.cores
        known[""] = cores[""] = b""
        parts = [part for part in new if part]
        shapes = SHAPES("\n".join(parts))
        words = "\n".join([word for word, _, _ in shapes]).lower().split("\n")
        fresh = list(set(words).difference(known))
        known.update(zip(fresh, self.merges.ids_of_all([w.encode() for w in fresh], self.inner, self.last), strict=True))
        split = [(part, *self._cut(part)) for _, _, part in shapes if part]
        wanted = {piece for _, *pieces in split for piece in pieces}.union([tail for _, tail, _ in shapes]).difference(cores)
        self._encode(wanted)
        if shapes:
            known.update([(part, known[word] + cores[tail]) for part, word, (_, tail, _) in zip(parts, words, shapes, strict=True) if word])
        known.update([(part, cores[core] + cores[tail]) for part, core, tail in split])
        return [piece for some in (parts, fresh, wanted) for piece in some if len(piece) > self.longest]

    def _cut(self, part: str) -> tuple[str, str]:
        """A part of other shape, without its tail of punctuation, and the tail."""
        text = part.lower() if part.isascii() and "<|" not in part else part
        core = text.rstrip(PUNCTUATION)
        tail = text[len(core) :]
        return (core, tail) if core and tail and self._letter(core[-1]) else (text, "")

    @staticmethod
    def _letter(last: str) -> bool:
        """Letters end a pre-token before a tail of punctuation, and case is folded for plain letters."""
        return last.isalpha() if last.isascii() else unicodedata.normalize("NFC", last).lower()[-1].isalpha()

    def _encode(self, pieces: set[str]) -> None:
        """The library's ids of pieces."""
        asked = list(pieces)
        for piece, got in zip(asked, self.tokenizer.encode_batch_fast(asked, add_special_tokens=False), strict=True):
            self.cores[piece] = np.array(got.ids, dtype="<u4").tobytes()
