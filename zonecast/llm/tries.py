"""Token counts by dynamic programming over a trie of distinct pre-tokens.

A BPE file encodes by merges. Pieces are the encoding of their text if each two neighbours are that of theirs, so
an encoding without its last piece is that of a shorter prefix, and the last piece and the count of a prefix depend on
that prefix alone. A unigram model scores a segmentation by the sum of its pieces' scores; the best score that
ends at a prefix depends on that prefix alone, too. Walking the distinct pre-tokens in order is walking their trie, so each
shared prefix is settled once and every terminal keeps its count of pieces. Documents then only add counts.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KNOWN = 1_000_000
PAIRS = 500_000
SPACE = "▁"


class Unigram:
    """Piece scores of a SentencePiece file; what no piece covers falls back to its UTF-8 bytes."""

    def __init__(self, path: str, byte_score: float | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.longest = max(map(len, self.scores))
        self.byte_score = min(self.scores.values()) - 10 if byte_score is None else byte_score

    def step(self, prefix: str, best: list[tuple[float, int]]) -> tuple[float, int]:
        """Best (score, pieces) that ends at ``prefix``; ``best`` holds those of its own prefixes.

        Equal scores take fewer pieces.
        """
        n = len(prefix)
        bytes_ = len(prefix[-1].encode("utf-8", "surrogatepass"))
        score, count = best[n - 1]
        found = (score + bytes_ * self.byte_score, -(count + bytes_))
        for begin in range(max(0, n - self.longest), n):
            own = self.scores.get(prefix[begin:])
            if own is not None:
                score, count = best[begin]
                found = max(found, (score + own, -(count + 1)))
        return found[0], -found[1]

    def counts(self, words: list[str]) -> dict[str, int]:
        """Pieces of the best segmentation of each word, every shared prefix being scored once."""
        out, best, last = {}, [(0.0, 0)], ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(word, last, strict=False):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :]
            for n in range(shared + 1, len(word) + 1):
                best.append(self.step(word[max(0, n - self.longest) : n], best[max(0, n - self.longest) :]))
            out[word], last = best[-1][1], word
        return out


class Merges:
    """Piece counts of a SentencePiece BPE file: the best merge first, the leftmost of like ones.

    What no piece covers falls back to its UTF-8 bytes. Runs of the space mark merge last and by themselves, so the file's
    library counts them. ``pairs`` bounds the cache of pairs.
    """

    def __init__(self, path: str, pairs: int = PAIRS):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.letters = {piece for piece in scores if len(piece) == 1}
        words = {piece: score for piece, score in scores.items() if len(piece) > 1 and piece.strip(SPACE)}
        self.rank = {piece: i for i, piece in enumerate(sorted(words, key=words.get, reverse=True))}
        spaces = [score for piece, score in scores.items() if len(piece) > 1 and not piece.strip(SPACE)]
        if len(set(words.values())) < len(words) or max(spaces, default=-1e30) >= min(words.values()) or any(SPACE in p[1:] or "\n" in p for p in words):
            raise ValueError(f"{path}: merges of one rank, or across spaces or lines")
        self.longest = max(map(len, self.rank))
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.apart: dict[tuple[str, str], bool] = {}
        self.pairs = pairs
        self.runs: dict[int, int] = {0: 0}

    def split(self, piece: str) -> tuple[str, str] | None:
        """The halves of a piece's last merge; none if merging its letters does not give the piece."""
        if piece not in self.halves:
            rank, parts, halves, last = self.rank, list(piece), None, -1
            while len(parts) > 1:
                found = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank]
                if not found:
                    break
                order, i = min(found)
                if order < last:
                    raise ValueError(f"{piece}: its merges are not in order")
                last, halves = order, (parts[i], parts[i + 1])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[piece] = halves if len(parts) == 1 else None
        return self.halves[piece]

    def stay_apart(self, a: str, b: str) -> bool:
        """Whether two pieces are the encoding of their text, found by undoing the later merge in turn.

        No merge over the border may come before the one undone: the left piece's own goes first at one rank, the
        right piece's own last.
        """
        rank, limit = self.rank, len(self.rank)
        while True:
            if rank.get(a + b, limit) < limit:
                return False
            own, other = rank.get(a, -1), rank.get(b, -1)
            if own > other:
                limit, a = own, self.split(a)[1]
            elif other >= 0:
                limit, b = other + 1, self.split(b)[0]
            else:
                return True

    def step(self, prefix: str, best: list[tuple[str, int, bool]]) -> tuple[str, int, bool]:
        """Last piece and count at ``prefix``, and whether a leading space mark stands alone; ``best`` as of its prefixes."""
        rank, apart, n = self.rank, self.apart, len(prefix)
        for begin in range(n - 1):
            piece = prefix[begin:]
            if piece in rank and self.split(piece):
                last, count, alone = best[begin]
                if last:
                    pair = last, piece
                    if pair not in apart:
                        apart[pair] = self.stay_apart(last, piece)
                    if not apart[pair]:
                        continue
                return piece, count + 1, alone
        last, count, alone = best[n - 1]
        piece = prefix[-1]
        size = 1 if piece in self.letters else len(piece.encode("utf-8", "surrogatepass"))
        return piece, count + size, alone if last else piece == SPACE

    def counts(self, parts: list[str]) -> dict[str, tuple[int, bool]]:
        """``pieces, mark stands alone`` of each part, every shared prefix being settled once."""
        out, best, last = {}, [("", 0, False)], ""
        for part in sorted(parts):
            shared = 0
            for a, b in zip(part, last, strict=False):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :]
            for n in range(shared + 1, len(part) + 1):
                begin = max(0, n - self.longest)
                best.append(self.step(part[begin:n], best[begin:]))
            out[part], last = best[-1][1:], part
        if len(self.apart) > self.pairs:
            self.apart.clear()
        return out

    def spaces(self, length: int) -> int:
        """Pieces of a run of space marks; the file puts one in front of every text."""
        if length not in self.runs:
            if len(self.runs) > 10_000:
                self.runs = {0: 0}
            self.runs[length] = len(self.model.encode(" " * (length - 1))) if length > 1 else 1
        return self.runs[length]


class PartCounts:
    """Token counts of whole texts from those of their parts: ``known`` bounds the parts that are kept."""

    def __init__(self, path: str, known: int = KNOWN):
        self.merges, self.known = Merges(path), known
        self.seen: dict[str, int] = {}
        self.loose: set[str] = set()

    def of(self, texts: list[str | None]) -> list[int]:
        # A blank begins a part and is its mark; a line end begins one without a mark. An empty part is a mark alone.
        cut = [text.replace(SPACE, " ").replace("\n", " \n").split(" ") if text else [] for text in texts]
        seen, loose, merges = self.seen, self.loose, self.merges
        if len(seen) > self.known:
            seen.clear()
            loose.clear()
        seen[""] = 0
        new = {part for parts in cut for part in parts if part not in seen}
        marked = {part if part[0] == "\n" else SPACE + part: part for part in new}
        for part, (count, alone) in merges.counts(list(marked)).items():
            seen[marked[part]] = count
            if alone:
                loose.add(marked[part])
        out = []
        for parts in cut:
            total = sum([seen[part] for part in parts])
            if "" in parts:
                run = 0
                for part in parts:
                    if not part:
                        run += 1
                    elif run:
                        total += merges.spaces(run + 1) - 1 if part in loose else merges.spaces(run)
                        run = 0
                total += merges.spaces(run)
            out.append(total)
        return out


def merge_counts(docs: DataFrame, model: str, known: int = KNOWN) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every whole text, one row per row of ``docs``: what the BPE file's own library counts.

    Blanks, tabs and line ends are tokens as the file has them; words are the parts between white space. Reads ``doc_id``
    and ``text`` only. Null and empty texts have no words and no tokens; repeated rows are counted each. A worker keeps the
    counts of up to ``known`` parts and starts anew beyond that; counts stay the same.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _merged:
            _merged[model] = PartCounts(model)
        parts = _merged[model]
        parts.known = known
        for batch in batches:
            words, tokens = [], []
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(1).slice(at, 256).to_pylist()
                words += [len(text.split()) if text else 0 for text in texts]
                tokens += parts.of(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(counted, f"doc_id {kind}, n_words long, n_tokens long")


_merged: dict[str, PartCounts] = {}


def token_counts(docs: DataFrame, model: str, known: int = KNOWN) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every whole text by a unigram model's scores, one row per row of ``docs``.

    The scores of a BPE file are ranks of merges and not meant for this: see ``merge_counts``. Pre-tokens are the parts between white space with the file's space mark in front. Reads ``doc_id`` and ``text``
    only. Null, empty and blank texts have no words and no tokens; repeated rows are counted each. A worker
    keeps the counts of up to ``known`` pre-tokens and starts anew beyond that; counts stay the same.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram, seen = opened(model)
        for batch in batches:
            ids, words, tokens = batch.column(0), [], []
            for at in range(0, batch.num_rows, 256):
                parts = [text.split() if text else [] for text in batch.column(1).slice(at, 256).to_pylist()]
                if len(seen) > known:
                    seen.clear()
                new = {w for own in parts for w in own if w not in seen}
                seen.update((w[1:], n) for w, n in unigram.counts([SPACE + w for w in new]).items())
                words += [len(own) for own in parts]
                tokens += [sum([seen[w] for w in own]) for own in parts]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(counted, f"doc_id {kind}, n_words long, n_tokens long")


_opened: dict[str, tuple[Unigram, dict[str, int]]] = {}


def opened(path: str) -> tuple[Unigram, dict[str, int]]:
    """The worker's scores and known counts for this file."""
    if path not in _opened:
        _opened[path] = (Unigram(path), {})
    return _opened[path]
