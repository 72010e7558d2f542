"""Language identification: sparse multinomial logistic regression on character n-grams.

Letters are lower-cased, everything else becomes one boundary mark, and runs of one to three
characters are hashed into ``N_FEATURES`` places. Weights are TF-IDF with document counts over
every training document. The regression is trained by follow-the-regularised-leader (proximal)
with an elastic net on a drawn sample of at most ``MAX_SAMPLE`` labelled documents, as many
of each language, or all it has; one part of the sample is held back to fit the temperature of the softmax.
The model has a row of ``N_FEATURES`` weights per language, which bounds what is sent to the
executors. Counting and prediction read whole texts where they lie, without a shuffle of texts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.llm.common import quoted

N_FEATURES = 1 << 15
MAX_SAMPLE = 4000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
HELD_BACK = 5  # one in so many of the sample sets the temperature
PIECE = 1 << 20  # characters counted at once
UNKNOWN = "und"

_SHIFT = np.uint64(64 - 15)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Documents that are never learned from; a null id counts as an empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % 3 == 1


class Characters:
    """Counts of hashed character n-grams."""

    def __init__(self):
        self.letter = np.array([chr(i).isalpha() for i in range(1 << 16)])

    def _codes(self, text: str, before: int) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        low = codes < (1 << 16)
        letters = self.letter[np.where(low, codes, 0)] & low
        if not low.all():
            far = np.flatnonzero(~low)
            letters[far] = [chr(c).isalpha() for c in codes[far].tolist()]
        codes = np.where(letters, codes, 0).astype(np.uint64)
        start = np.empty(len(codes), bool)
        start[0], start[1:] = before != 0, codes[:-1] != 0
        return codes[letters | start]

    def count(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Places and counts; None for a text without a letter."""
        if not text:
            return None
        total, any_letter, tail = np.zeros(N_FEATURES, np.int64), False, np.zeros(1, np.uint64)
        for at in range(0, len(text), PIECE):
            own = self._codes(text[at : at + PIECE], int(tail[-1]))
            any_letter |= bool(own.any())
            codes = np.concatenate([tail, own, np.zeros(1, np.uint64)] if at + PIECE >= len(text) else [tail, own])
            hashed, known = codes * _FACTORS[0], len(tail)
            grams = [hashed[known:][codes[known:] != 0]]
            for k in (1, 2):  # those that end in what is new
                if len(codes) > k:
                    hashed = hashed[:-1] * np.uint64(31) + codes[k:] * _FACTORS[k]
                    grams.append(hashed[max(0, known - k) :])
            places = np.concatenate(grams) * _FACTORS[1] >> _SHIFT
            total += np.bincount(places.astype(np.int64), minlength=N_FEATURES)
            tail = codes[-2:]
        if not any_letter:
            return None
        places = np.flatnonzero(total)
        return places, total[places]


def weighted(places: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1.0 + np.log(counts)) * idf[places]
    return values / np.sqrt((values * values).sum())


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # one row per language; the last column is the intercept
    temperature: float

    def predict(self, grams) -> tuple[str, float]:
        if grams is None or not self.languages:
            return UNKNOWN, 0.0
        places, counts = grams
        logits = self.weights[:, places] @ weighted(places, counts, self.idf) + self.weights[:, -1]
        p = softmax(logits / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, k: int, epochs: int = EPOCHS) -> np.ndarray:
    """Per-coordinate FTRL-proximal for the softmax loss; rows are (places, values)."""
    z, n = np.zeros((k, N_FEATURES + 1)), np.zeros((k, N_FEATURES + 1))

    def weights(zs, ns):
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(ns)) / ALPHA + L2)

    for _ in range(epochs):
        for (places, values), label in zip(rows, classes):
            at, x = np.append(places, N_FEATURES), np.append(values, 1.0)
            zs, ns = z[:, at], n[:, at]
            w = weights(zs, ns)
            error = softmax(w @ x)
            error[label] -= 1.0
            g = error[:, None] * x
            squares = ns + g * g
            z[:, at] = zs + g - (np.sqrt(squares) - np.sqrt(ns)) / ALPHA * w
            n[:, at] = squares
    return weights(z, n)


def fitted_temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature with the least log loss, from a grid that is refined once."""
    def loss(t):
        return -np.log(softmax(logits / t)[np.arange(len(classes)), classes] + 1e-300).mean()

    grid = np.geomspace(0.02, 20, 61)
    best = min(grid, key=loss)
    return float(min(np.geomspace(best / 1.15, best * 1.15, 41), key=loss))


def document_counts(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Documents with letters, and how many of them hold each n-gram place; all rows of ``texts(text)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        characters, seen = Characters(), np.zeros(N_FEATURES + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if (grams := characters.count(text.as_py())) is not None:
                    seen[grams[0]] += 1
                    seen[-1] += 1
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(seen[at])], names=["place", "n"])

    found = texts.mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(N_FEATURES + 1, np.int64)
    for place, n in found:
        seen[place] = n
    return int(seen[-1]), seen[:-1]


def even_quota(counts: list[int], most: int) -> int:
    """The largest number such that so many of each language, or all it has, are ``most`` together; one at least."""
    left, counts = most, sorted(counts)
    for k, n in enumerate(counts):
        if n * (len(counts) - k) > left:
            return max(1, left // (len(counts) - k))
        left -= n
    return counts[-1]


class FirstTurns:
    """Tells whether a row can be among the ``quota`` rows of its language with the smallest turns."""

    def __init__(self, quota: int):
        self.quota, self.held = quota, {}

    def add(self, language: int, turn: float) -> bool:
        held = self.held.setdefault(language, [])
        if len(held) < self.quota:
            heapq.heappush(held, -turn)
            return True
        return -turn > held[0] and heapq.heappushpop(held, -turn) is not None


def draw_sample(train: DataFrame, per_language: dict[str, int], max_sample: int, seed: int = 5) -> DataFrame:
    """Rows ``(language, places, counts)`` to train on, in one partition and in the order of training.

    Every language gives the same number of documents with letters, or all it has, those of its
    smallest hashes. The order is that of another hash.
    """
    languages, quota = sorted(per_language), even_quota(list(per_language.values()), max_sample)
    # a hash times this is about a document's place in its language, in quotas
    shares = F.create_map(*[F.lit(x) for lang in languages for x in (lang, float(per_language[lang] / quota))])
    number = F.create_map(*[F.lit(x) for k, lang in enumerate(languages) for x in (lang, k)])
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = train.select(
        "text", number[F.col("lang")].alias("language"), (draw * shares[F.col("lang")]).alias("turn"),
        F.xxhash64("doc_id", "text", F.lit(seed + 1)).alias("place"),
    ).filter(F.col("turn") < (quota + 6 * quota**0.5 + 10) / quota)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        characters, first = Characters(), FirstTurns(quota)
        for batch in batches:
            rows = [
                (k, t, p, g) for text, k, t, p in zip(*[c.to_pylist() for c in batch.columns])
                if (g := characters.count(text)) and first.add(k, t)
            ]
            yield pa.record_batch(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()),
                 pa.array([r[2] for r in rows], pa.int64()),
                 pa.array([r[3][0].astype("<i4").tobytes() for r in rows], pa.binary()),
                 pa.array([r[3][1].astype("<i8").tobytes() for r in rows], pa.binary())],
                names=["language", "turn", "place", "places", "counts"],
            )

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                own = held.setdefault(row[0], [])
                own.append(row)
                if len(own) > 2 * quota:
                    own.sort(key=lambda r: r[1:3])
                    del own[quota:]
        rows = [r for own in held.values() for r in sorted(own, key=lambda r: r[1:3])[:quota]]
        rows.sort(key=lambda r: (r[2], r[0]))
        for at in range(0, len(rows), 500):
            part = list(zip(*rows[at : at + 500]))
            yield pa.record_batch(
                [pa.array(part[0], pa.int32()), pa.array(part[3], pa.binary()), pa.array(part[4], pa.binary())],
                names=["language", "places", "counts"],
            )

    found = drawn.mapInArrow(grams, "language int, turn double, place long, places binary, counts binary")
    return found.repartition(1).mapInArrow(choose, "language int, places binary, counts binary")


def fit(docs: DataFrame, max_sample: int = MAX_SAMPLE, seed: int = 5) -> Model:
    """Train on the rows of ``docs(doc_id, text, lang)`` that are not held out and have a ``lang``.

    At most ``max_sample`` documents are trained on (their order and choice follow hashes of id and
    text, see ``draw_sample``); the document counts cover all training rows. Without a labelled text there are no
    languages, and everything is predicted ``und``.
    """
    train = docs.select("doc_id", "text", "lang").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    total, seen = document_counts(train.select("text"))
    idf = np.log((1.0 + total) / (1.0 + seen)) + 1.0
    per_language = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    if not per_language or not total:
        return Model([], idf, np.zeros((0, N_FEATURES + 1)), 1.0)
    languages = sorted(per_language)
    sample = draw_sample(train, per_language, max_sample, seed)

    def train_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, classes = [], []
        for batch in batches:
            for language, places, counts in zip(*[c.to_pylist() for c in batch.columns]):
                at = np.frombuffer(places, "<i4")
                rows.append((at, weighted(at, np.frombuffer(counts, "<i8"), idf)))
                classes.append(language)
        if not rows:
            return
        classes = np.array(classes)
        held = np.arange(len(rows)) % HELD_BACK == HELD_BACK - 1
        if not held.any():
            held[:] = True
        fitting = ~held if (~held).any() and not held.all() else np.ones(len(rows), bool)
        w = train_ftrl([r for r, f in zip(rows, fitting) if f], classes[fitting], len(languages))
        logits = np.array([w[:, at] @ x + w[:, -1] for (at, x), h in zip(rows, held) if h])
        temperature = fitted_temperature(logits, classes[held])
        yield pa.record_batch(
            [pa.array(range(len(languages)), pa.int32()), pa.array([r.astype("<f8").tobytes() for r in w], pa.binary()),
             pa.array([temperature] * len(languages), pa.float64())],
            names=["language", "weights", "temperature"],
        )

    learned = sample.mapInArrow(train_one, "language int, weights binary, temperature double").collect()
    if not learned:
        return Model([], idf, np.zeros((0, N_FEATURES + 1)), 1.0)
    w = np.array([np.frombuffer(r["weights"], "<f8") for r in sorted(learned, key=lambda r: r["language"])])
    return Model(languages, idf, w, learned[0]["temperature"])


def predict(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of each row with ``lang_pred`` and ``score``, from ``text`` alone.

    A null text, or one without a letter, is ``und`` with score 0. Rows that repeat are predicted
    each; other columns are ignored; an empty table gives no rows.
    """
    kept = docs.select("text", *columns)
    # one row of weights per language
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.idf, model.weights, model.temperature))
    schema = T.StructType(kept.schema.fields[1:]).add("lang_pred", T.StringType()).add("score", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        characters, own = Characters(), Model(*sent.value)
        for batch in batches:
            found = [own.predict(characters.count(text.as_py())) for text in batch.column(0)]
            yield pa.record_batch(
                [*batch.columns[1:], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*batch.schema.names[1:], "lang_pred", "score"],
            )

    return kept.mapInArrow(run, schema)


def identify(docs: DataFrame, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """Train on ``docs`` and predict all of its rows: id, whether held out, language and score."""
    found = predict(docs.select("doc_id", "text"), fit(docs, max_sample))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they were, whose language is told with ``min_score`` at least.

    Rows with a null text, or a text without a letter, go; rows that repeat stay as often as they
    stand; an empty table gives no rows. Other columns may have any names.
    """
    model = fit(docs)
    row = F.struct(*[quoted(c) for c in docs.columns]).alias("_row")
    found = predict(docs.select("text", row), model, ("_row",))
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("_row.*")
