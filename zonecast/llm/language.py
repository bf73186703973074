"""Language ID by string kernels: blended n-gram presence, Nystroem landmarks, one-versus-rest kernel ridge.

The kernel of two texts is the number of distinct character n-grams (n = 1 to 3) that both hold, over the root of
the product of their own numbers. Landmarks are texts of the fitting sample; a text is described by its
kernel values with them, whitened by the landmarks' own kernel matrix, and a ridge regression per language
scores it. Blocks of texts are scored at once: presence matrix x landmark matrix x weights.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonecast.llm.store import saved
from zonecast.llm.tokens import release

FIT_ROWS = 16_000
FIT_TASKS = 16
TASK_ROWS = 1000
LANDMARKS = 192
LANDMARK_CHARS = (40, 4000)
RIDGE = 1e-2
BLOCK = 64
WIDEST = 1 << 23
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


def grams(text: str) -> np.ndarray:
    """Sorted codes of the distinct 1-, 2- and 3-grams of a whole text, 21 bits a character, hence exact."""
    one = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    one = np.where(one == 0, 32, one)
    two = (one[:-1] << 21) | one[1:]
    three = (two[:-1] << 21) | one[2:]
    return np.unique(np.concatenate([one, two, three]))


@dataclass
class Model:
    """``vocabulary``: sorted codes that landmarks hold; ``landmarks``: (code, landmark) presence;
    ``sizes``: distinct n-grams per landmark; ``weights``: (landmark and a constant, language)."""

    languages: list[str]
    vocabulary: np.ndarray
    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Kernel values (text, landmark) of a block of texts, as one product of presence matrices."""
        own, rows, columns = [], [], []
        for row, text in enumerate(texts):
            codes = grams(text)
            at = np.searchsorted(self.vocabulary, codes)
            at[at == len(self.vocabulary)] = 0
            at = at[self.vocabulary[at] == codes]
            own.append(len(codes))
            rows.append(np.full(len(at), row))
            columns.append(at)
        row, column = np.concatenate(rows), np.concatenate(columns)
        landmarks = self.landmarks
        if len(texts) * len(self.vocabulary) > WIDEST:
            used, column = np.unique(column, return_inverse=True)
            landmarks = landmarks[used]
        presence = np.zeros((len(texts), len(landmarks)), dtype=np.float32)
        presence[row, column] = 1
        shared = presence @ landmarks.astype(np.float32, copy=False)
        return shared / np.sqrt(np.array(own, dtype=np.float64)[:, None] * self.sizes[None, :])

    def scores(self, texts: list[str]) -> np.ndarray:
        """(text, language): the regressions' values; near 1 for a text's language, near 0 for others."""
        return self.kernel(texts) @ self.weights[:-1] + self.weights[-1]


def with_landmarks(texts: list[str], languages: list[str]) -> Model:
    """A model without weights yet."""
    codes = [grams(text) for text in texts]
    vocabulary = np.unique(np.concatenate(codes))
    landmarks = np.zeros((len(vocabulary), len(texts)), dtype=np.float32)
    for i, own in enumerate(codes):
        landmarks[np.searchsorted(vocabulary, own), i] = 1
    return Model(languages, vocabulary, landmarks, np.array([len(own) for own in codes], dtype=np.float64), np.empty((0, 0)))


def solve(model: Model, texts: list[str], moments: np.ndarray, targets: np.ndarray, n: int, ridge: float) -> np.ndarray:
    """Ridge weights on the whitened features from sums of (kernel values, 1) products."""
    between = np.concatenate([model.kernel(texts[at : at + BLOCK]) for at in range(0, len(texts), BLOCK)])
    values, vectors = np.linalg.eigh((between + between.T) / 2)
    good = values > 1e-6 * values.max()
    white = vectors[:, good] / np.sqrt(values[good])
    size = white.shape[1]
    lift = np.zeros((len(texts) + 1, size + 1))
    lift[:-1, :-1], lift[-1, -1] = white, 1
    penalty = ridge * n * np.eye(size + 1) * (np.trace(lift.T @ moments @ lift) / max(n, 1) / (size + 1))
    penalty[-1, -1] = 1e-9 * n
    return lift @ np.linalg.solve(lift.T @ moments @ lift + penalty, lift.T @ targets)


def smallest(hashes: DataFrame, per: int) -> DataFrame:
    """The ``per`` smallest ``_draw`` of each ``lang``, all if it has fewer; ``hashes`` holds each once.

    A histogram of the leading 16 bits tells how far a language's hashes are needed, so only about ``per`` of them are sorted.
    """
    lead = F.shiftright("_draw", 48)
    line = Window.partitionBy("lang").orderBy("_lead").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = hashes.groupBy("lang", lead.alias("_lead")).agg(F.count("*").alias("_own"))
    needed = counted.withColumn("_before", F.sum("_own").over(line) - F.col("_own")).where(F.col("_before") < per)
    last = needed.groupBy("lang").agg(F.max("_lead").alias("_last"))
    few = hashes.join(F.broadcast(last), "lang").where(lead <= F.col("_last"))
    order = Window.partitionBy("lang").orderBy("_draw")
    return few.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per).select("lang", "_draw")


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Fit on rows ``text, lang``; None if no row has a language and a letter.

    The sample is bounded: each language gives an equal part of ``fit_rows``, one at least, of its distinct texts (all, if
    it has fewer), the smallest by a hash of the text; copies of a text count once. Landmarks are ``landmarks`` of
    the sampled texts at most, in turn from each language, texts of ``LANDMARK_CHARS`` characters first. Whole texts are
    used. Only hashes are grouped over all rows; the sample's kernel products are summed in tasks, and the
    driver sees the landmarks and the sums.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang", F.xxhash64("text", F.lit(7)).alias("_draw"))
    languages = [r["lang"] for r in rows.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return None
    per = max(1, fit_rows // len(languages))
    drawn = smallest(saved(rows.select("lang", "_draw").distinct(), "language-hashes"), per)
    chosen = rows.join(F.broadcast(drawn), ["lang", "_draw"]).groupBy("lang", "_draw").agg(F.min("text").alias("text"))
    tasks = max(FIT_TASKS, -(-fit_rows // TASK_ROWS))
    sample = saved(chosen.repartition(tasks, "lang", "_draw"), "language-sample")
    low, high = LANDMARK_CHARS
    unfit = (~F.length("text").between(low, high)).cast("int")
    line = Window.partitionBy("lang").orderBy(unfit, "_draw", "text")
    most = max(1, landmarks)
    ranked = sample.withColumn("_n", F.row_number().over(line)).where(F.col("_n") <= -(-most // len(languages)))
    texts = [r["text"] for r in ranked.orderBy("_n", "lang").limit(most).select("text").collect()]
    model = with_landmarks(texts, languages)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    width = len(texts) + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known = shared.value
        place = {lang: i for i, lang in enumerate(known.languages)}
        moments, targets, n = np.zeros((width, width)), np.zeros((width, len(place))), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                k = known.kernel(some.column("text").to_pylist())
                k = np.concatenate([k, np.ones((len(k), 1))], axis=1)
                y = np.zeros((len(k), len(place)))
                y[np.arange(len(k)), [place[lang] for lang in some.column("lang").to_pylist()]] = 1
                moments, targets, n = moments + k.T @ k, targets + k.T @ y, n + len(k)
        yield pa.RecordBatch.from_pydict({"n": [n], "moments": [moments.tobytes()], "targets": [targets.tobytes()]})

    parts = sample.select("text", "lang").mapInArrow(sums, "n long, moments binary, targets binary").collect()
    moments = sum(np.frombuffer(p["moments"]).reshape(width, width) for p in parts)
    targets = sum(np.frombuffer(p["targets"]).reshape(width, len(languages)) for p in parts)
    model.weights = solve(model, texts, moments, targets, sum(p["n"] for p in parts), ridge)
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, from the whole text alone.

    A null text, an empty one, and one without a letter is ``und`` with score 0, as is every text if there is no
    model. Equal scores go to the first language by code point; repeated rows are predicted each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            real = [i for i, text in enumerate(texts) if known is not None and has_letter(text)]
            for at in range(0, len(real), BLOCK):
                some = real[at : at + BLOCK]
                values = known.scores([texts[i] for i in some])
                for i, best, value in zip(some, values.argmax(axis=1).tolist(), values.max(axis=1).tolist(), strict=True):
                    names[i], scores[i] = known.languages[best], min(1.0, max(0.0, value))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(predicted, f"doc_id {kind}, lang_pred string, score double")


def in_known_language(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a learned language with a score of ``least`` or more.

    ``lang`` becomes the language of the whole text, whatever label a row came with, none included. A text without a letter
    is in no language; so is none if there is no model.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, named = docs.columns.index("text"), docs.columns.index("lang")

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            names: list[str | None] = [None] * len(texts)
            real = [i for i, text in enumerate(texts) if known is not None and has_letter(text)]
            for begin in range(0, len(real), BLOCK):
                some = real[begin : begin + BLOCK]
                values = known.scores([texts[i] for i in some])
                for i, best, value in zip(some, values.argmax(axis=1).tolist(), values.max(axis=1).tolist(), strict=True):
                    names[i] = known.languages[best] if value >= least else None
            found = pa.array(names, batch.schema.field(named).type)
            yield batch.set_column(named, batch.schema.field(named), found).filter(found.is_valid())

    return docs.mapInArrow(good, docs.schema)


def held_out(doc_id) -> F.Column:
    """Rows kept from fitting: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
