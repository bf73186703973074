"""BPE by forced boundaries against the tokenizers library, on odd and random texts."""

import json
import random

import numpy as np
import public_tokenizers
import pytest

from made import prose
from zonecast.llm import fragments

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE_BPE)


@pytest.fixture(scope="module")
def codec():
    return fragments.ByteBpe(BYTE_BPE)


def encoded(codec, texts):
    data = [t.encode() for t in texts]
    return codec.ids_of(b"".join(data), np.cumsum([0, *map(len, data)]))


def same(codec, library, texts):
    got = encoded(codec, texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for text, ids, right in zip(texts, got, want, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == right, text[:80]
    assert codec.texts_of(got) == [library.decode(ids, skip_special_tokens=False) for ids in want]


def test_every_character_in_every_place(codec, library):
    chars = [chr(i) for i in [*range(0x3400), *range(0xA000, 0xD800), *range(0xE000, 0x11000), *range(0x1F000, 0x1FB00)] if not 0xD800 <= i < 0xE000]
    same(codec, library, ["".join(f"a{c} b{c}{c} 1{c}'{c}s\n{c}" for c in chars[i : i + 200]) for i in range(0, len(chars), 200)])


def test_random_texts_equal_the_library(codec, library):
    rng = random.Random(2)
    letters = ["ab 's", " \n\t　\xa0x.'\x85\x1c", "a1.'tsdlvemr \n!?", "qzxj'\"-é ñ你\U0001f600", "lL'l ", "tion ing the.,", "0123456789 ,."]
    same(codec, library, ["".join(rng.choice(some) for _ in range(rng.randint(0, 50))) for some in letters for _ in range(1500)])


def test_added_tokens_and_long_runs(codec, library):
    mark = "<|endoftext|>"
    texts = [mark, mark * 3, f"a  {mark}  b\n\n{mark}", mark[:-1], mark[1:], f"<{mark}>", f"{mark[:5]}{mark}", "", " ", "  "]
    texts += ["x" * 30_000, " " * 4000 + "x", "\n" * 2000, "ab" * 2000, "你好" * 500, "!?" * 500, "aB3" * 300, "\U0001f600" * 300]
    same(codec, library, texts)
    # A text that ends in the first half of a mark does not make one with the text that follows it.
    same(codec, library, ["a<|endof", "text|> b"])


def test_a_small_cache_changes_nothing(library):
    small = fragments.ByteBpe(BYTE_BPE, fragments=20, longest=4)
    rng = random.Random(3)
    for _ in range(5):
        same(small, library, [prose(rng, 60) + "<|endoftext|>" for _ in range(3)])
    assert len(small.known) <= 20 + 60 * 3 * 2


def test_no_token_holds_a_forced_pair(codec):
    assert codec.forced.any() and not codec.forced.all()
    for i, token in codec.tokens.items():
        if token not in codec.added:
            assert not any(codec.forced[a, b] for a, b in zip(token, token[1:], strict=False)), i
    assert (codec.certain <= codec.forced).all()
    assert codec.certain[ord("a"), ord(" ")] and not codec.certain[ord(" "), ord("a")] and not codec.certain[ord("'"), ord("s")]


def test_cuts_carry_the_result(codec, library):
    """A pair that tokens do hold must not be a cut: with one forced wrongly, ids differ."""
    wrong = fragments.ByteBpe(BYTE_BPE)
    wrong.forced = wrong.forced.copy()
    wrong.forced[ord("h"), ord("e")] = True
    text = "the other theme"
    assert np.frombuffer(encoded(wrong, [text])[0], "<u4").tolist() != library.encode(text, add_special_tokens=False).ids


def test_rows_and_heap_merge_alike(codec):
    rng = random.Random(5)
    pieces = list({"".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 32))).encode() for _ in range(500)})
    got = codec.merged_all(pieces)
    assert all(np.frombuffer(got[p], "<u4").tolist() == codec.merged(p) for p in pieces)


def test_encode_and_decode_tables(frame, odd_texts, library):
    texts = odd_texts + [odd_texts[5]] * 20
    ids = [None if i % 9 == 8 else i // 2 for i in range(len(texts))]
    docs = frame(texts, ids=ids)
    rows = fragments.decode(fragments.encode(docs, BYTE_BPE), BYTE_BPE).collect()
    assert len(rows) == len(texts)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist(), r["text"]) for r in rows) == sorted(
        (str(i), w, t or "") for i, w, t in zip(ids, want, texts, strict=True)
    )
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in rows)
    assert fragments.encode(frame([]), BYTE_BPE).count() == 0


def test_decoding_odd_ids(spark, codec, library):
    rng = random.Random(6)
    runs = [[rng.randrange(50_257) for _ in range(rng.randint(0, 30))] for _ in range(200)] + [[]]
    held = [np.array(r, "<u4").tobytes() for r in runs]
    assert codec.texts_of(held) == [library.decode(r, skip_special_tokens=False) for r in runs]
    rows = spark.createDataFrame([(1, 0, None, 5), (2, 1, bytearray(np.array([65], "<u4").tobytes()), 5)], "doc_id long, n_tokens long, ids binary, text int")
    assert {r["doc_id"]: r["text"] for r in fragments.decode(rows, BYTE_BPE).collect()} == {1: None, 2: library.decode([65])}
    with pytest.raises(ValueError, match="vocabulary"):
        codec.texts_of([np.array([99_999], "<u4").tobytes()])


def test_other_kinds_of_files_are_refused(tmp_path):
    with pytest.raises(ValueError, match="byte-level"):
        fragments.ByteBpe(public_tokenizers.path("word_bpe_49k.json"))
    spec = json.load(open(BYTE_BPE))
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "strip.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="byte-level"):
        fragments.ByteBpe(str(tmp_path / "strip.json"))
