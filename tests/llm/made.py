"""Small tables for the tests of the training-data operators."""

# Extra columns whose names the operators use themselves.
EXTRA = "size int, shard int, slot int, rank int, part int, band long, a long, b long, n int, rep long, component long, score double, grp long"
COLUMNS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def extra():
    return (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 0.5, 12)


def prose(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows_of(texts, ids=None, langs=None, sources=None):
    out = []
    for i, text in enumerate(texts):
        out.append(((ids or range(len(texts)))[i], text, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], 1, *extra()))
    return out


