"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams (code points of the lower-cased text, lengths 1 to 3) are hashed to ``FEATURES``
numbers. Document frequencies are counted over all labelled documents. The model is fitted on a bounded
random sample of them, about ``SAMPLE`` documents shared out evenly over the languages, by
follow-the-regularised-leader with an elastic net: the L1 part makes the weights sparse, the L2 part
keeps them small. Every fifth document of the sample is left out of the fit and gives the temperature
that divides the scores, so that the probability of the chosen language is calibrated.

Nulls: rows with a null text, language or id teach nothing; a text that is null or has no letter is
``und`` with score 0, as is any text when nothing could be learnt. Repeated rows count each. Texts of any
length are read whole, in blocks. Ties go to the language that sorts first. An empty table gives an empty
table. Only the columns named here are read; extra ones are not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 15
LENGTHS = 3
#: Documents of the fit, all languages together, and of one language at most.
SAMPLE = 4000
SAMPLE_PER_LANGUAGE = 800
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.01
UNKNOWN = "und"
_BLOCK = 1 << 20

_LETTER = re.compile(r"[^\W\d_]")


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs in the whole text."""
    found = np.zeros(FEATURES, np.float64)
    text = text.lower()
    for at in range(0, max(len(text), 1), _BLOCK):
        # Blocks overlap, so that no n-gram is cut: each is counted where it starts.
        points = np.frombuffer(text[at : at + _BLOCK + LENGTHS - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        points = points.astype(np.uint64)
        rolled = np.zeros_like(points)
        for n in range(1, LENGTHS + 1):
            rolled = (rolled[: len(points) - n + 1] + points[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            starts = min(len(rolled), _BLOCK)
            found += np.bincount((rolled[:starts] >> np.uint64(49)).astype(np.int64), minlength=FEATURES)
            rolled ^= rolled >> np.uint64(29)
    return found


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(FEATURES, np.int64)
    rows = 0
    for batch in batches:
        for text in batch["text"]:
            total += counts(text.as_py()) > 0
            rows += 1
    if rows:
        held = np.flatnonzero(total)
        # The number of documents stands under -1.
        yield pa.record_batch([np.append(held, -1), np.append(total[held], rows)], names=["feature", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            c = counts(batch["text"][k].as_py())
            held = np.flatnonzero(c)
            yield pa.record_batch(
                [
                    batch["doc_id"].slice(k, 1),
                    batch["lang"].slice(k, 1),
                    pa.array([held.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([c[held].astype(np.float32)], pa.list_(pa.float32())),
                ],
                names=["doc_id", "lang", "feature", "count"],
            )


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Model:
    """Weights, inverse document frequencies and temperature for some languages."""

    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf = languages, idf
        self.weights = np.zeros((FEATURES, len(languages)))
        self.temperature = 1.0

    def _row(self, feature: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = count * self.idf[feature]
        return x / max(np.sqrt(x @ x), 1e-12)

    def fit(self, rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
        """Follow the regularised leader over ``rows`` (language, features, counts), then calibrate."""
        index = {x: i for i, x in enumerate(self.languages)}
        data = [(index[lang], f, self._row(f, c)) for lang, f, c in rows]
        kept = [x for i, x in enumerate(data) if i % 5 == 4] or data
        taught = [x for i, x in enumerate(data) if i % 5 != 4] or data
        z, n = np.zeros_like(self.weights), np.zeros_like(self.weights)
        order = np.random.default_rng(0)
        for _ in range(EPOCHS):
            for i in order.permutation(len(taught)):
                y, f, x = taught[i]
                zf, nf = z[f], n[f]
                w = self._leader(zf, nf)
                p = _softmax(x @ w)
                p[y] -= 1
                g = x[:, None] * p
                root = np.sqrt(nf + g * g)
                z[f] = zf + g - (root - np.sqrt(nf)) / ALPHA * w
                n[f] = nf + g * g
        self.weights = self._leader(z, n)
        if kept:
            scores = np.array([x @ self.weights[f] for _, f, x in kept])
            self.temperature = _temperature(scores, np.array([y for y, _, _ in kept]))
        return self

    @staticmethod
    def _leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0
        x = counts(text) * self.idf
        p = _softmax((x @ self.weights) / max(np.sqrt(x @ x), 1e-12) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def _temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least log loss, by golden-section search between 1/50 and 50."""

    def loss(log_t: float) -> float:
        p = _softmax(scores / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).mean()

    low, high, step = -np.log(50), np.log(50), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - step * (high - low), low + step * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def learn(labelled: DataFrame) -> Model:
    """A model from ``labelled`` (doc_id, text, lang)."""
    own = labelled.select(F.col("doc_id"), F.col("text").cast("string"), F.col("lang").cast("string")).dropna()
    per_language = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(per_language)
    frequency = own.select("text").mapInArrow(_frequencies, "feature long, n long")
    # At most FEATURES + 1 rows.
    found = frequency.groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(FEATURES + 1)
    df[found["feature"].to_numpy()] = found["n"].to_numpy()
    model = Model(languages, np.log((df[-1] + 1) / (df[:-1] + 1)) + 1)
    if not languages:
        return model
    wanted = min(SAMPLE_PER_LANGUAGE, max(1, SAMPLE // len(languages)))
    shares = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, wanted / per_language[k]))))
    dice = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) / (1 << 30)
    rows = own.where(dice < shares[F.col("lang")]).mapInArrow(
        _features, "doc_id long, lang string, feature array<int>, count array<float>"
    )
    sample = rows.orderBy("doc_id").toArrow()
    columns = (sample["lang"].to_pylist(), sample["feature"].to_pylist(), sample["count"].to_pylist())
    return model.fit([(k, np.array(f, np.int64), np.array(c, np.float64)) for k, f, c in zip(*columns, strict=True)])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(x.as_py()) for x in batch["text"]]
            lang, score = ([x[i] for x in found] for i in (0, 1))
            yield pa.record_batch(
                [batch["doc_id"], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double")
