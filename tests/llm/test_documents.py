"""Operators on texts against plain versions, with odd rows, repeated rows, and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from made import prose
from zonecast.llm import codes, language, mixing, packing, phrases, setsketch, shards, tokens, tries
from zonecast.llm.store import new_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


def words(text):
    return WORD.findall(text or "")


# --- language -------------------------------------------------------------------------------------


def speakers(n, seed=1):
    rng = random.Random(seed)
    return [(prose(rng, rng.randint(5, 60), "abcde" if i % 2 else "uvwxyz"), "aa" if i % 2 else "uu") for i in range(n)]


def test_language_is_learned_and_odd_texts_are_und(frame, odd_texts):
    made = speakers(120)
    known = frame([t for t, _ in made], langs=[lang for _, lang in made])
    model = language.fit(known.select("text", "lang"), fit_rows=80, landmarks=20)
    new = speakers(60, seed=2)
    found = language.predict(frame([t for t, _ in new]), model).collect()
    assert all(r["lang_pred"] == new[r["doc_id"]][1] and 0 <= r["score"] <= 1 for r in found)
    odd = {r["doc_id"]: r for r in language.predict(frame(odd_texts), model).collect()}
    assert len(odd) == len(odd_texts)
    for i, text in enumerate(odd_texts):
        assert (odd[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    kept = language.in_known_language(frame(odd_texts), model, 0.0)
    assert kept.columns == frame(odd_texts).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in odd.items() if r["lang_pred"] != "und"}


def test_language_sample_counts_a_repeated_text_once(frame):
    only = frame(["banana bread"] * 40, langs=["aa"] * 40).select("text", "lang")
    model = language.fit(only, fit_rows=4)
    assert model.languages == ["aa"] and len(model.sizes) == 1
    for hot in ("x y z", "banana bread", "one two"):
        made = speakers(30)
        texts, langs = [hot] * 40 + [t for t, _ in made], ["aa"] * 40 + [lang for _, lang in made]
        model = language.fit(frame(texts, langs=langs).select("text", "lang"), fit_rows=4, landmarks=4)
        assert model.languages == ["aa", "uu"] and len(model.sizes) == 4


def test_language_landmarks_are_bounded_with_many_labels(frame):
    made = [t for t, _ in speakers(30)]
    model = language.fit(frame(made, langs=[f"l{i:02}" for i in range(30)]).select("text", "lang"), fit_rows=10, landmarks=7)
    assert len(model.languages) == 30 and len(model.sizes) == 7


@pytest.mark.parametrize("per", [1, 7, 50, 1000])
def test_smallest_hashes(spark, per):
    rng = random.Random(per)
    own = {lang: [rng.randint(-(2**63), 2**63 - 1) >> shift for _ in range(90)] for lang, shift in (("a", 0), ("b", 15), ("c", 40))}
    hashes = spark.createDataFrame([(lang, h) for lang, some in own.items() for h in set(some)], "lang string, _draw long")
    got = {tuple(r) for r in language.smallest(hashes, per).collect()}
    assert got == {(lang, h) for lang, some in own.items() for h in sorted(set(some))[:per]}


def test_all_rows_as_landmarks_are_plain_kernel_ridge(frame):
    made = speakers(60, seed=5)
    texts, langs = [t for t, _ in made], [lang for _, lang in made]
    model = language.fit(frame(texts, langs=langs).select("text", "lang"), fit_rows=1000, landmarks=1000)
    sets = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    new = [t for t, _ in speakers(20, seed=6)]
    new_sets = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in new]
    kernel = lambda some: np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in some])
    n, between = len(texts), kernel(sets)
    y = np.array([[lang == "aa", lang == "uu"] for lang in langs], dtype=float)
    penalty = language.RIDGE * n * 2 / (n + 1)
    system = np.zeros((n + 1, n + 1))
    system[:n, :n], system[:n, n], system[n, :n], system[n, n] = between + penalty * np.eye(n), 1, between.sum(axis=0), n + 1e-9 * n
    weights = np.linalg.solve(system, np.vstack([y, y.sum(axis=0)]))
    assert np.allclose(model.scores(new), kernel(new_sets) @ weights[:n] + weights[n], atol=1e-6)


def test_kernel_is_the_count_of_common_grams():
    texts = ["banana", "bandana", "xyz", "a"]
    model = language.with_landmarks(texts[:2], ["aa"])

    def plain(t):
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    want = [[len(plain(x) & plain(y)) / (len(plain(x)) * len(plain(y))) ** 0.5 for y in texts[:2]] for x in texts]
    assert np.allclose(model.kernel(texts), want)


def test_language_without_labels(frame):
    docs = frame(["some text", "more text"], langs=[None, None])
    assert language.fit(docs.select("text", "lang")) is None
    assert {r["lang_pred"] for r in language.predict(docs, None).collect()} == {"und"}
    assert language.predict(frame([]), None).count() == 0


# --- shards ---------------------------------------------------------------------------------------


def placed(docs, n):
    return [r.asDict() for r in shards.shard(shards.digest(docs), n).collect()]


def test_shards_are_gapless_and_near_equal(frame, odd_texts):
    rng = random.Random(5)
    texts = odd_texts + [prose(rng, rng.randint(10, 200)) for _ in range(800)] + ["same text of a hot group"] * 400
    out = placed(frame(texts), 10)
    assert len(out) == len(texts)
    slots, held = collections.defaultdict(list), collections.Counter()
    for r in out:
        slots[r["shard"]].append(r["slot"])
        held[r["shard"]] += r["size"]
        text = texts[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 16 and r["text_crc32"] == zlib.crc32(text.encode())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = sum(held.values()) / 10
    largest = max(r["size"] for r in out)
    assert all(abs(held[i] - share) <= largest + 0.05 * share for i in range(10))


def test_small_groups_stay_whole(frame):
    rng = random.Random(6)
    texts = [t for _ in range(300) for t in [prose(rng, 40)] * 3]
    of = collections.defaultdict(set)
    for r in placed(frame(texts), 6):
        of[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in of.values())


def test_shards_of_odd_tables(frame):
    assert placed(frame([]), 4) == []
    same = placed(frame(["t"] * 50, ids=[None] * 25 + [7] * 25), 4)
    assert len(same) == 50 and max(collections.Counter(r["shard"] for r in same).values()) <= 14
    assert {r["shard"] for r in placed(frame(["only"]), 4)} <= {0, 1, 2, 3}


def test_overfull_ranges_are_subdivided():
    import pandas as pd

    hot = pd.DataFrame({"grp": [5] * 90 + [9] * 10, "sub": range(100), "weight": [1.0] * 100})
    cuts = shards.boundaries(hot, 10)
    assert cuts[0] == (5, shards.LOWEST) and len([c for c in cuts if c[0] == 5]) == 9
    keys = np.array([5, 5, 5, 9, 1]), np.array([0, 55, 89, 1, 0])
    number = shards.numbers(cuts, *keys)
    assert number[4] == 0 and number[0] == 1 and number[0] < number[1] < number[2] <= number[3]


# --- substring dedup ------------------------------------------------------------------------------


def plain_kept(rows, phrase=13):
    """rows: (doc_id, text). Kept words and number removed of each row."""
    first = {}
    split = [words(t) for _, t in rows]
    for (doc, _), w in zip(rows, split, strict=True):
        if doc is not None:
            for i in range(len(w) - phrase + 1):
                key = tuple(w[i : i + phrase])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, _), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - phrase + 1):
            if doc is not None and first[tuple(w[i : i + phrase])] < doc:
                gone.update(range(i, i + phrase))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def check_phrases(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = phrases.drop_repeats(docs)
    assert got.columns == [*docs.columns, "n_words", "n_removed"]
    got = [(r["doc_id"], r["n_words"], r["n_removed"], " ".join(words(r["text"]))) for r in got.collect()]
    assert collections.Counter(got) == collections.Counter(plain_kept(rows))
    return got


def test_repeated_phrases(frame, odd_texts):
    rng = random.Random(7)
    passage, line = prose(rng, 60), prose(rng, 13)
    texts = odd_texts + [prose(rng, 50) + " " + passage + " " + prose(rng, 20) for _ in range(30)]
    texts += [line + "\n" + line + "\n" + prose(rng, 20) for _ in range(30)] + ["a " * 40, "a " * 60, "a b " * 30, "b a " * 30]
    texts += [" ".join(passage.split()[k : k + 13 + k % 5]) for k in range(20)]
    got = check_phrases(frame(texts))
    assert any(r[2] for r in got)


def test_repeated_phrases_of_repeated_and_null_ids(frame):
    rng = random.Random(8)
    text = prose(rng, 30)
    got = check_phrases(frame([text] * 6, ids=[None, 4, 4, 9, None, 2]))
    assert sorted((r[0] or -1, r[2]) for r in got) == [(-1, 0), (-1, 0), (2, 0), (4, 30), (4, 30), (9, 30)]
    assert phrases.drop_repeats(frame([])).count() == 0


# --- codes, tokens --------------------------------------------------------------------------------


@pytest.mark.parametrize("top", [1, 200, 300, 70_000, 1 << 31])
def test_codes_round_trip_and_random_access(top):
    ids = np.random.default_rng(top).integers(0, top, 3000).astype(np.uint32)
    ids[::7] = 3 % top
    held = codes.Codes(codes.encode(ids))
    assert (held.run(0, len(ids)) == ids).all()
    assert all(held[i] == ids[i] for i in range(0, 3000, 13))
    assert all((held.run(i, i + 41) == ids[i : i + 41]).all() for i in range(0, 2900, 97))
    assert len(held.run(5, 5)) == 0


def test_code_files(spark, frame, odd_texts, tokenizer):
    ids = [30, 2, 2, None, *range(100, 90 + len(odd_texts) + 6)]
    docs = frame(odd_texts, ids=ids[: len(odd_texts)])
    path = new_path(spark, "codes")
    codes.write_codes(docs, path, WORD_BPE, segment_tokens=500)
    got = codes.read_codes(spark, path).collect()
    assert len(got) == len(odd_texts)
    want = collections.Counter()
    for i, text in zip(ids, odd_texts, strict=False):
        want[(i, np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    got.sort(key=lambda r: r["start"])
    at, order = 0, []
    for r in got:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        at += r["n_tokens"]
        order.append(-1 if r["doc_id"] is None else r["doc_id"])
    assert order == sorted(order)


def test_code_files_of_no_documents(spark, frame):
    path = new_path(spark, "codes")
    codes.write_codes(frame([]), path, WORD_BPE)
    assert codes.read_codes(spark, path).count() == 0


def test_word_cache_gives_the_tokenizers_ids(tokenizer, odd_texts):
    from zonecast.llm.tokens import WordIds

    rng = random.Random(4)
    texts = [t for t in odd_texts if t] + ["It's (ok). Ok?! a.b,c;d <|ENDOFTEXT|>. 0 1 0", "á ́b Å.  x y", "0 0 0", "ÀÉ. Ωσς. İ. ǅ! 你好，世界。 क़. क़."]
    texts += [prose(rng, 50, "abcÀé.,!'<|>0 9") for _ in range(50)]
    tight = WordIds(WORD_BPE, parts=20, pieces=20)
    for text, ids in zip(texts, tight.ids_of(texts, together=3), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_long_parts_share_their_core(tokenizer):
    from zonecast.llm.tokens import WordIds

    names = ["introduction", "methods", "results", "discussion", "wow", "a" * 60]
    texts = [f"{n}{'.' * 50} {n} {n}, {n.upper()} {n.title()}! {n}{'!' * 60}" for n in names]
    fresh = WordIds(WORD_BPE)
    for _ in range(2):
        for text, ids in zip(texts, fresh.ids_of(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert all(len(part) <= fresh.longest for part in fresh.known) and not {"introduction", "a" * 60} & set(fresh.cores)


def test_case_and_tails_of_words_are_not_the_librarys_work(tokenizer, monkeypatch):
    from zonecast.llm.tokens import WordIds

    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcdeöéñß") for _ in range(rng.randint(1, 12))) for _ in range(400)})
    odd = ["ÖTZIE×2", "a÷b", "x\u0301.", "Ÿ", "İ.", "ΣΑΣ.", "Don't.", "ª.", "a\tb.", "(ok)", "<|EndOfText|>", "foo<|endoftext|>", "5.", "\u00a0", "ẞ", "$5", "a&b"]
    texts = [f"{w} {w.title()}. {w.upper().replace('SS', 'ß')}&&& {w},### {w}!\") {o}{o} {o}" for w, o in zip(words, odd * 30, strict=False)]
    fresh, asked = WordIds(WORD_BPE), []
    monkeypatch.setattr(fresh, "_encode", lambda pieces, real=fresh._encode: (asked.extend(pieces), real(pieces)))
    for text, ids in zip(texts, fresh.ids_of(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(asked) < 100 and not set(words) & set(asked)
    # A word is kept once, not as a part and again as a core.
    assert not set(words) & set(fresh.cores) and len(fresh.cores) < 100


def test_full_word_cache_starts_anew(tokenizer):
    from zonecast.llm.tokens import WordIds

    texts = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}. Éa{chr(97 + i % 26)}" for i in range(300)]
    tight = WordIds(WORD_BPE, parts=50, pieces=5)
    for _ in range(2):
        for text, ids in zip(texts, tight.ids_of(texts, together=4), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
            assert len(tight.known) + len(tight.cores) <= 50 + 5 + 1 + 6 * 4


# --- token counts ---------------------------------------------------------------------------------


def test_trie_counts_equal_a_plain_viterbi(frame, odd_texts):
    unigram = tries.Unigram(PIECE_BPE)
    rng = random.Random(9)
    texts = [t for t in odd_texts if t is None or len(t) < 40_000] + [prose(rng, 50, "aeinorst") for _ in range(20)] + ["naïve 你好 \U0001f600"]

    def pieces(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            size = len(word[end - 1].encode())
            options = [(best[end - 1][0] + size * unigram.byte_score, -(best[end - 1][1] + size))]
            for begin in range(end):
                if word[begin:end] in unigram.scores:
                    options.append((best[begin][0] + unigram.scores[word[begin:end]], -(best[begin][1] + 1)))
            score, count = max(options)
            best.append((score, -count))
        return best[-1][1]

    got = {r["doc_id"]: r for r in tries.token_counts(frame(texts), PIECE_BPE, known=30).collect()}
    for i, text in enumerate(texts):
        assert got[i]["n_words"] == len((text or "").split())
        if len(text or "") < 3000:
            assert got[i]["n_tokens"] == sum(pieces("▁" + w) for w in (text or "").split())
    assert tries.token_counts(frame([]), PIECE_BPE).count() == 0


def test_merge_counts_equal_the_library(frame, odd_texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    rng = random.Random(10)
    letters = ["ab ", "aeinorst \n", "th e\n\t", "▁ a.", "(){}=; \n", "é你 \U0001f600ñx", "0123456789 ,.", " \u3000\xa0\x1c\r\nab", "<0x0A> s/"]
    texts = odd_texts + [" ", "\n", "a  b", "international " * 5, " " * 300 + "\n\n  x" + " " * 40]
    texts += ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for some in letters for _ in range(100)]
    for known in (30, 1_000_000):
        got = {r["doc_id"]: r for r in tries.merge_counts(frame(texts), PIECE_BPE, known=known).collect()}
        for i, text in enumerate(texts):
            assert got[i]["n_words"] == len((text or "").split())
            assert got[i]["n_tokens"] == (len(library.encode(text)) if text else 0), text[:60]
    assert tries.merge_counts(frame([]), PIECE_BPE).count() == 0


# --- packing --------------------------------------------------------------------------------------


def test_packing_is_gapless_and_tight(frame, odd_texts, tokenizer):
    rng = random.Random(11)
    texts = odd_texts + [prose(rng, rng.randint(1, 300)) for _ in range(300)] + ["hot copy of one text"] * 200
    got = packing.pack(packing.cut_pieces(frame(texts), WORD_BPE, capacity=256), capacity=256).collect()
    sequences, docs = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append(r)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    for i, text in enumerate(texts):
        own = sorted(docs[i], key=lambda r: r["piece"])
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert b"".join(bytes(r["ids"]) for r in own) == ids.tobytes()
        assert [r["start"] for r in own] == list(range(0, len(ids), 256))
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 256) + 1


def test_plan_takes_pairs_and_triples_that_fill_exactly():
    for counts in ({60: 1, 40: 1}, {60: 2, 30: 2, 10: 2}, {50: 4}, {40: 1, 30: 1, 20: 1, 10: 1}, {25: 8}):
        rows, n = packing.plan(counts, 100)
        assert n * 100 == sum(length * c for length, c in counts.items()) and rows[:, 2].sum() == sum(counts.values())
    assert packing.plan({}, 100)[1] == 0
    assert packing.plan({70: 3, 50: 1}, 100)[1] == 4


def test_packing_no_documents(frame):
    assert packing.pack(packing.cut_pieces(frame([]), WORD_BPE)).count() == 0


# --- mixing ---------------------------------------------------------------------------------------


def test_targets_share_by_weight_below_their_caps():
    got = mixing.targets([("b", 1000), ("a", 10), (None, 10), ("c", 500)])
    assert got["a"] == 30.0 and sum(got.values()) == pytest.approx(1520)
    assert got["b"] / got["c"] == pytest.approx(2.0) and got[None] == 30.0
    assert mixing.targets([]) == {} and mixing.targets([("x", 0)]) == {"x": 0.0}


def test_mix_is_exact_and_repeats(frame, odd_texts):
    rng = random.Random(12)
    texts = odd_texts + [prose(rng, rng.randint(1, 40)) for _ in range(400)]
    sources = [None if i % 11 == 0 else f"s{i % 4}" if i % 3 else "s0" for i in range(len(texts))]
    docs = frame(texts, sources=sources)
    got = mixing.mix(docs).collect()
    taken, target = collections.Counter(), {}
    for r in got:
        assert r["size"] == len(words(texts[r["doc_id"]])) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    assert sorted(got) == sorted(mixing.mix(docs.repartition(5)).collect())
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    per = collections.Counter()
    for r in rows.collect():
        per[r["doc_id"]] += len(words(r["text"]))
    assert per == collections.Counter({r["doc_id"]: r["taken"] for r in got if r["taken"]})
    assert mixing.mix(frame([])).count() == 0


def test_mix_takes_rows_of_null_and_repeated_ids(frame):
    rng = random.Random(13)
    texts = [prose(rng, rng.randint(1, 40)) for _ in range(200)] + ["three like rows"] * 3
    ids = [None if i % 4 == 0 else i % 50 for i in range(200)] + [1000] * 3
    sources = [f"s{i % 3}" for i in range(len(texts))]
    docs = frame(texts, ids=ids, sources=sources)
    budget = {r["source"]: int(r["target"] + 0.5) for r in mixing.mix(docs).collect()}
    taken, copies = collections.Counter(), collections.Counter()
    for r in mixing.mixed(docs).collect():
        taken[r["source"]] += len(words(r["text"]))
        copies[r["source"], r["doc_id"], r["text"]] += 1
    assert taken == budget
    assert max(copies.values()) <= 3 * 3 and any(i is None for _, i, _ in copies)


def test_mix_within_groups_is_a_mix_of_each(frame):
    """Sources share each group's words by their weights in the order of all sources, whether a group holds them or not."""
    rng = random.Random(14)
    texts = [prose(rng, rng.randint(1, 40)) for _ in range(300)]
    langs = [(None, "aa", "bb")[i % 3] for i in range(300)]
    sources = ["s1" if lang == "aa" and i % 2 else f"s{i % 5 % 3}" if lang != "aa" else "s2" for i, lang in enumerate(langs)]
    docs = frame(texts, langs=langs, sources=sources)
    size, taken = collections.Counter(), collections.Counter()
    for text, lang, source in zip(texts, langs, sources, strict=True):
        size[lang, source] += len(words(text))
    for r in mixing.mixed(docs, within=("lang",)).collect():
        taken[r["lang"], r["source"]] += len(words(r["text"]))
    for lang in (None, "aa", "bb"):
        wanted = mixing.targets([(s, size[lang, s]) for s in ("s0", "s1", "s2")])
        assert wanted["s0"] > 0 or lang == "aa"
        assert all(abs(taken[lang, s] - wanted[s]) <= 0.5 for s in wanted)


def test_identified_language_decides_the_mix(spark, frame):
    """Texts without a label get their language, and the source mix goes by it."""
    import corpus_pipeline

    made = speakers(200)
    told = [None if i % 5 == 0 else lang for i, (_, lang) in enumerate(made)]
    given = frame([t for t, _ in made], langs=told, sources=[f"s{i % 7 % 3}" for i in range(200)])
    docs = corpus_pipeline.identify_language(spark, given, "")
    rows = docs.collect()
    assert docs.schema == given.schema and len(rows) == 200
    assert [r["lang"] for r in sorted(rows)] == [lang for _, lang in made]
    size, taken, past = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        size[r["lang"], r["source"]] += len(words(r["text"]))
    for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
        taken[r["lang"], r["source"]] += len(words(r["text"]))
    for r in corpus_pipeline.mix_sources(spark, given, "").collect():
        past[made[r["doc_id"]][1], r["source"]] += len(words(r["text"]))
    for lang in ("aa", "uu"):
        wanted = mixing.targets([(f"s{i}", size[lang, f"s{i}"]) for i in range(3)])
        assert all(abs(taken[lang, s] - wanted[s]) <= 0.5 for s in wanted)
    assert past != taken


# --- near documents -------------------------------------------------------------------------------


def plain_near(rows, percent=75):
    sets = []
    for _, text in rows:
        w = [x.decode() for x in (text or "").encode().lower().split()]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                root[b] = a
    return {(doc, len(s), rows[find(i)][0]) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))}


def test_near_documents_equal_brute_force(frame, odd_texts):
    rng = random.Random(13)
    texts = list(odd_texts)
    for _ in range(12):
        base = prose(rng, 80).split()
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(80)] = prose(rng, 1)
            texts.append(" ".join(own))
    chain = prose(rng, 120).split()
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 60, 4)] + ["Upper CASE words count alike here", "upper case words count alike here", "a b", "A B"]
    docs = frame(texts)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in setsketch.near_documents(docs).collect()}
    assert got == plain_near(list(enumerate(texts)))


def test_large_group_of_near_copies_is_one_component(frame):
    rng = random.Random(14)
    base = prose(rng, 100).split()
    texts = []
    for _ in range(300):
        own = list(base)
        for _ in range(3):
            own[rng.randrange(100)] = prose(rng, 1)
        texts.append(" ".join(own))
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in setsketch.near_documents(frame(texts)).collect()}
    assert got == plain_near(list(enumerate(texts)))


def test_all_open_pairs_are_tested_when_the_best_are_known(frame, monkeypatch):
    passes, whole = [], setsketch.open_pairs

    def best_are_known(*given):
        passes.append(given[-1])
        return whole(*given).where("false" if given[-1] is not None else "true")

    monkeypatch.setattr(setsketch, "open_pairs", best_are_known)
    assert setsketch.near_documents(frame(["a b c d e f g", "h i j k l m n"])).count() == 2
    assert passes == [setsketch.BEST, None]


def test_near_documents_of_odd_ids(frame):
    text = "some words that are the same in each"
    rows = setsketch.near_documents(frame([text] * 4, ids=[None, 5, 5, 9])).collect()
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in rows)
    assert got == [(-1, None, True), (5, 5, True), (5, 5, True), (9, 5, False)]
    assert setsketch.near_documents(frame([])).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:700], rng.integers(0, 1 << 63, 300).astype(np.uint64)]))
    ra, rb, both = setsketch.registers([a, b, np.union1d(a, b)])
    assert (np.maximum(ra, rb) == both).all()
    n = np.array([len(a)]), np.array([len(b)])
    assert not setsketch.possible(ra[None], setsketch.registers([b[500:]]), n[0], np.array([len(b) - 500]), 75)[0]
    assert setsketch.possible(ra[None], ra[None], n[0], n[0], 75)[0]


def test_sha_of_kept_words(frame):
    text = "  a  b\nc "
    want = hashlib.sha256(b"a b c").hexdigest()
    got = phrases.drop_repeats(frame([text])).select(F.sha2(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), 256)).first()[0]
    assert got == want


# --- names of other columns -----------------------------------------------------------------------

CLASHING = ["_row", "_size", "_taken", "_copy", "_block", "shard", "slot", "_range", "_base", "_END", "_row_kept"]


def clashing(spark, texts):
    rows = [(i, t, "en", f"s{i % 2}", 1, *[100 * i + k for k in range(len(CLASHING))]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHING))


@pytest.mark.parametrize("stage", ["near-dedup", "substring dedup", "source mix"])
def test_stages_keep_columns_of_any_name(spark, stage):
    import corpus_pipeline

    rng = random.Random(12)
    docs = clashing(spark, [prose(rng, 40) for _ in range(12)])
    made = dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
    assert made.columns == docs.columns
    for r in made.collect():
        assert [r[c] for c in CLASHING] == [100 * r["doc_id"] + k for k in range(len(CLASHING))]


def test_shards_keep_columns_of_any_name(spark):
    rng = random.Random(13)
    docs = clashing(spark, [prose(rng, 40) for _ in range(12)])
    made = shards.shard(shards.digest(docs).join(docs.drop("text", "lang", "source", "n_chars", "shard", "slot"), "doc_id"), 3)
    kept = [c for c in CLASHING if c not in ("shard", "slot")]
    assert made.columns.count("slot") == 1 and made.columns.count("shard") == 1
    for r in made.collect():
        assert [r[c] for c in kept] == [100 * r["doc_id"] + CLASHING.index(c) for c in kept] and r["shard"] in (0, 1, 2)


def test_a_part_is_looked_up_once_per_chunk_of_texts():
    """Parts that repeat in a chunk meet the cache once; long texts end a chunk; ids are those of the whole texts."""

    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            Counted.asked += 1
            return super().get(key, default)

    words = tokens.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    words.known = Counted()
    texts = ["the  cat\nsat on the mat, the end. ", None, "", " \n ", "caf\u00e9 the CAT \u65e5\u672c <|endoftext|> it's"] * 50
    got = list(words.ids_of(texts))
    assert Counted.asked <= 20
    for text, ids in zip(texts[:5], got[:5], strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == words.tokenizer.encode(text or "", add_special_tokens=False).ids
    assert got == got[:5] * 50
    cut = list(tokens.chunks(["a", None, "b" * tokens.TOGETHER_CHARS, "c", "d", "e"], 2))
    assert [len(c) for c in cut] == [2, 1, 2, 1] and sum(cut, [])[2][0] == "b"
    assert list(tokens.chunks([], 3)) == []
