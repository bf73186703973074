"""BPE encoding and decoding by forced-boundary splitting.

A merge makes a vocabulary token, so two bytes that are neighbours inside no token never end up in one: between them every
encoding has a certain cut. Texts are cut at such pairs wherever the pre-token pattern can't look across, all at once
over their UTF-8 bytes; a fragment's ids depend on nothing around it, so each worker finds a fragment's ids once. A new
fragment is cut into pre-tokens and, inside them, at every pair that no token holds; the pieces are merged
on their own and their ids concatenated.
"""

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from zonecast.llm.merges import MergeTable, byte_names

BLANK = frozenset(b" \t\n\v\f\r")
QUOTE = ord("'")
ENCODED = "doc_id long, n_tokens long, ids binary"
DECODED = "doc_id long, n_tokens long, ids binary, text string"
SLICE_BYTES = 1 << 21
# The pattern of byte-level files that use one.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_opened: dict[str, "ByteBpe"] = {}


def opened(path: str) -> "ByteBpe":
    """The worker's codec for this file; it lives as long as the worker."""
    if path not in _opened:
        _opened[path] = ByteBpe(path)
    return _opened[path]


def kind(byte: int) -> str:
    """Which run of the pre-token pattern an ASCII byte belongs to; bytes of longer characters are told apart by the pattern alone."""
    if byte >= 128:
        return "unknown"
    if byte in BLANK:
        return "blank"
    return "letter" if chr(byte).isalpha() else "digit" if chr(byte).isdigit() else "other"


class ByteBpe:
    """A byte-level BPE file of the tokenizers library. ``fragments`` bounds the cache, ``longest`` what enters it.

    Files with a normalizer, an unknown token, word-end marks, another pre-tokenizer, or added tokens that strip or match single words work
    otherwise and are refused.
    """

    def __init__(self, path: str, fragments: int = 400_000, longest: int = 48):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pattern = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        stripped = [t["content"] for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"]]
        if (
            pattern.get("type") != "ByteLevel"
            or pattern.get("add_prefix_space")
            or not pattern.get("use_regex", True)
            or (spec["decoder"] or {}).get("type") != "ByteLevel"
            or spec["normalizer"]
            or odd
            or stripped
        ):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        names = byte_names()
        self.library_pre_tokens = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.names = names
        self.tokens = {i: bytes(names[c] for c in token) for token, i in model["vocab"].items()}
        vocab = model["vocab"]
        self.id_of_byte = np.array([vocab[name] for name, _ in sorted(names.items(), key=lambda item: item[1])], dtype=np.int32)
        self.merges = MergeTable(vocab, model["merges"])
        inside = np.zeros((256, 256), dtype=bool)
        for token in self.tokens.values():
            pairs = np.frombuffer(token, np.uint8)
            inside[pairs[:-1], pairs[1:]] = True
        self.forced = ~inside
        self.certain = self.forced & self._independent()
        added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.added = {content: np.array([i], "<u4").tobytes() for content, i in added.items()}
        self.find_added = re.compile(b"|".join(re.escape(c) for c in sorted(added, key=len, reverse=True))) if added else None
        self.tokens |= {i: content for content, i in added.items()}
        self.limit, self.longest = fragments, longest
        self.known: dict[bytes, bytes] = {}
        self._index_tokens()

    @staticmethod
    def _independent() -> np.ndarray:
        """Pairs where the pre-token pattern sees the same on both sides, whether or not the other side is there.

        Before a blank: a run of blanks that goes on is cut by force anyway, and nothing else reaches over a blank. Between runs of
        different kinds, unless a blank may belong to what follows or a quote may begin a contraction.
        """
        kinds = np.array([kind(b) for b in range(256)])
        plain = np.isin(kinds, ["letter", "digit", "other"])
        plain_left = plain & (np.arange(256) != QUOTE)
        turns = plain_left[:, None] & plain[None, :] & (kinds[:, None] != kinds[None, :])
        return turns | (kinds == "blank")[None, :]

    # --- encoding ---

    def ids_of(self, data: bytes, edges: np.ndarray) -> list[bytes]:
        """Ids, little-endian unsigned 32-bit, of the texts ``data[edges[i]:edges[i + 1]]``."""
        raw = np.frombuffer(data, np.uint8)
        cut = np.zeros(len(raw) + 1, dtype=bool)
        if len(raw) > 1:
            cut[1:-1] = self.certain[raw[:-1], raw[1:]]
        added = set()
        for begin, end in self._added_spans(data, edges):
            cut[begin:end] = False
            cut[[begin, end]] = True
            added.add(data[begin:end])
        cut[edges] = True
        places = np.flatnonzero(cut)
        at = places.tolist()
        fragments = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        new = set(fragments).difference(self.known)
        self._learn(new, added)
        ids = list(map(self.known.__getitem__, fragments))
        first = np.searchsorted(places, edges).tolist()
        out = [b"".join(ids[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        # Long fragments seldom come again, and a full cache starts anew; ids stay the same.
        if len(self.known) > self.limit:
            self.known.clear()
        else:
            for fragment in new:
                if len(fragment) > self.longest:
                    del self.known[fragment]
        return out

    def _added_spans(self, data: bytes, edges: np.ndarray) -> Iterator[tuple[int, int]]:
        """Where a text holds an added token's string; such a string has no fragment within it, so no other fragment equals it."""
        if self.find_added is not None:
            for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                yield from (m.span() for m in self.find_added.finditer(data, begin, end))

    def _learn(self, new: set[bytes], added: set[bytes]) -> None:
        """Cut new fragments into pieces that no merge reaches across, merge each piece once, put a fragment's pieces together."""
        for fragment in new & added:
            self.known[fragment] = self.added[fragment]
        plain = list(new - added)
        tokens, ends = [], []
        for fragment in plain:
            tokens += self.pre_tokens_of(fragment)
            ends.append(len(tokens))
        data = b"".join(tokens)
        raw = np.frombuffer(data, np.uint8)
        edges = np.cumsum([0, *map(len, tokens)])
        cut = np.zeros(len(raw) + 1, dtype=bool)
        cut[1:-1] = self.forced[raw[:-1], raw[1:]]
        cut[edges] = True
        places = np.flatnonzero(cut).tolist()
        pieces = [data[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]
        found = self.merged_all(list(set(pieces)))
        ids = list(map(found.__getitem__, pieces))
        begin = 0
        for fragment, end in zip(plain, np.searchsorted(places, edges[ends]).tolist(), strict=True):
            self.known[fragment] = ids[begin] if end == begin + 1 else b"".join(ids[begin:end])
            begin = end

    def pre_tokens_of(self, fragment: bytes) -> list[bytes]:
        """What the file's pattern makes of a fragment. Kinds of characters up to U+00FF are fixed; the library knows those of others."""
        if max(fragment) <= 0xC3:
            return [token.encode() for token in PRE_TOKENS.findall(fragment.decode())]
        names = self.names
        return [bytes(map(names.__getitem__, shown)) for shown, _ in self.library_pre_tokens(fragment.decode())]

    def merged_all(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each piece."""
        return dict(zip(pieces, self.merges.ids_of_all(pieces, self.id_of_byte, self.id_of_byte), strict=True))

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one piece of any length."""
        return self.merges.merged([int(self.id_of_byte[b]) for b in piece])

    # --- decoding ---

    def texts_of(self, ids: list[bytes]) -> list[str]:
        """The text of each run of ids; bytes that make no character become U+FFFD."""
        every = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        if len(every) and (every.max() >= len(self.token_size) or not self.token_size[every].all()):
            raise ValueError("An id is not in the vocabulary")
        sizes = self.token_size[every]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        data = self.token_bytes[np.repeat(self.token_begin[every] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        cuts = ends[np.cumsum([0, *(len(i) // 4 for i in ids)])].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _index_tokens(self) -> None:
        """All tokens' bytes one after the other, with the place and size of each id; ids that do not exist have none."""
        held = [self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)]
        self.token_size = np.array([len(t) for t in held], dtype=np.int64)
        self.token_begin = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(held), np.uint8)


def sliced(sizes: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Slices (begin, end) of rows of about ``most`` bytes, one row at least."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    begin = 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + most, "right")) - 1)
        yield begin, end
        begin = end


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` of every row: the ids of the whole text as the tokenizers library gives them without special tokens.

    ``ids`` are little-endian unsigned 32-bit numbers. An added token's string inside a text is that token, as in the library. Null
    and empty texts have no ids. Repeated rows and null ids stay as they are; other columns are not read, so their names
    don't matter. Rows are encoded where they are read, nothing is shuffled; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = opened(path)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            sizes = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            for begin, end in sliced(np.diff(sizes)):
                edges = sizes[begin : end + 1] - sizes[begin]
                held = texts.buffers()[2]
                data = held[int(sizes[begin]) : int(sizes[end])].to_pybytes() if held is not None else b""
                ids = codec.ids_of(data, edges)
                counts = [len(i) // 4 for i in ids]
                yield pa.record_batch(
                    {"doc_id": batch.column("doc_id").slice(begin, end - begin), "n_tokens": pa.array(counts, pa.int64()), "ids": pa.array(ids, pa.binary())}
                )

    return docs.select("doc_id", docs[text].alias("text")).mapInArrow(run, ENCODED)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids, text`` of rows of ``encode``: the text of all their ids, special tokens included; null ids give null.

    An id that the file does not have is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = opened(path)
        for batch in batches:
            ids = batch.column("ids")
            for begin, end in sliced(pc.fill_null(pc.binary_length(ids), 0).to_numpy(zero_copy_only=False)):
                some = batch.slice(begin, end - begin)
                held = some.column("ids").to_pylist()
                texts = codec.texts_of([i or b"" for i in held])
                yield pa.record_batch([*some.columns, pa.array(texts, pa.string(), mask=np.array([i is None for i in held]))], names=[*some.schema.names, "text"])

    return rows.select("doc_id", "n_tokens", "ids").mapInArrow(run, DECODED)
