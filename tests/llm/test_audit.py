"""Filter audit against plain loops, with odd rows, repeated rows and empty tables."""

import itertools
import random
import re

import numpy as np
import pytest

from made import extra, prose
from zonecast.llm import interactions

LABELS = "doc_id long, quality int, toxic int, own int, n int, digest string, spread int"


@pytest.fixture
def labels(spark):
    def make(rows):
        return spark.createDataFrame([(*r, 1, 2, "d", 3) for r in rows], LABELS)

    return make


def failed(rows):
    """Per row the letters of the filters that it fails."""
    out = []
    for doc_id, text, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = doc_id is not None and any(i is not None and i < doc_id and (other or "") == t for i, other, _ in rows)
        fails = [
            len(w) < 200,
            100 * len(set(w)) < 50 * len(w),
            100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            re.search("[#$%&*|]", t) is not None,
            smaller,
        ]
        out.append({name for name, yes in zip("ABCDE", fails, strict=True) if yes})
    return out


def plain(rows, marks):
    """Every order walked step by step over the documents themselves."""
    fails = failed(rows)
    good = {i for i, q, _ in marks if i is not None and q == 1}
    toxic = {i for i, _, t in marks if i is not None and t == 1}
    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        docs = [(rows[k][0], fails[k]) for k in range(len(rows)) if (rows[k][2] or "") == part]
        shares = dict.fromkeys("ABCDE", 0)
        found = {}
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, name in enumerate(order, 1):
                gone = [d for d in left if name in d[1]]
                left = [d for d in left if name not in d[1]]
                failing = sum(name in d[1] for d in docs)
                only = sum(d[1] == {name} for d in docs)
                shares[name] += len(gone)
                lost = [sum(i in held for i, _ in gone) for held in (good, toxic)]
                found["".join(order), step] = (len(left), len(gone), failing - len(gone), only, *lost)
        out |= {(part, order, step): (*v, shares[order[step - 1]]) for (order, step), v in found.items()}
    return out


def result(docs, labels):
    got = {}
    for r in interactions.audit(docs, labels).collect():
        key = (r["part"], r["filter_order"], r["step"])
        assert key not in got
        got[key] = tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return got


def made(odd_texts):
    rng = random.Random(4)
    rows = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(odd_texts)]
    for i in range(100, 260):
        text = prose(rng, rng.choice([50, 199, 200, 250]), rng.choice(["ab", "abcdefghijklm"]))
        text = text.upper() if rng.random() < 0.2 else text
        text += rng.choice(["", "", " #", " a|b", "$"])
        rows.append((i, text, rng.choice(["en", "de", None])))
    hot = "one text of a hot group " * 60
    rows += [(rng.randint(0, 400), hot, rng.choice(["en", "fr"])) for _ in range(90)]
    rows += [(None, hot, "en"), (None, hot, "en"), (None, None, "fr"), (500, "", "fr"), (500, "", "fr"), (501, "", None), (7, "Seven", "en"), (7, "Eight", "en")]
    return rows


def test_audit_equals_plain_loops(spark, labels, odd_texts):
    rows = made(odd_texts)
    docs = spark.createDataFrame([(i, t, lang, "s", 1, *extra()) for i, t, lang in rows], docs_columns())
    rng = random.Random(8)
    marks = [(rng.randint(0, 420), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(250)] + [(None, 1, 1), (9999, 1, 1)]
    assert result(docs, labels(marks)) == plain(rows, marks)


def docs_columns():
    from made import COLUMNS

    return COLUMNS


def test_names_of_its_own_columns_may_clash(spark, labels):
    docs = spark.createDataFrame(
        [(1, "a #", "en", 9, 9, "x", 9, True, 9), (2, "a #", "en", 9, 9, "x", 9, True, 9)],
        "doc_id long, text string, lang string, own int, spread int, digest string, fails int, good boolean, n int",
    )
    assert result(docs, labels([])) == plain([(1, "a #", "en"), (2, "a #", "en")], [])


def test_audit_of_empty_tables(frame, labels):
    assert result(frame([]), labels([(1, 1, 1)])) == {}
    got = result(frame(["a b"], langs=[None]), labels([]))
    assert len(got) == 600 and {key[0] for key in got} == {""}


def test_contraction_is_a_sum_over_the_selected_cells():
    rng = np.random.default_rng(3)
    tensor = rng.integers(0, 50, (3, 2, 2, 2, 2, 2))
    got = interactions.steps_of(tensor)
    i = list(got["filter_order"]).index("CAEBD") + 2
    removed = tensor[0, 0, :, 0, :, 1].sum()
    assert got["step"][i] == 3 and got["removed"][i] == removed and got["kept"][i] == tensor[0, 0, :, 0, :, 0].sum()
    assert got["redundant"][i] == tensor[0, ..., 1].sum() - removed and got["unique_fails"][i] == tensor[0, 0, 0, 0, 0, 1]
    assert got["good_lost"][i] == tensor[1, 0, :, 0, :, 1].sum() and got["toxic_lost"][i] == tensor[2, 0, :, 0, :, 1].sum()


def test_no_text_is_shuffled(frame, labels):
    plan = interactions.judged(frame(["a"]), labels([]))._jdf.queryExecution().executedPlan().toString()
    assert all("text" not in line for line in plan.split("\n") if "Exchange" in line)
