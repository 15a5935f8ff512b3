"""Operator 1: language identification.

Character n-grams of the lower-cased text, hashed to a fixed number of buckets and weighted by TF-IDF,
feed a multinomial logistic regression that is trained with follow-the-regularised-leader (proximal
form) under an elastic net, so most weights are exactly zero. One temperature, fitted on rows kept from
training, turns scores into probabilities.

Document frequencies are counted over all training rows; the regression sees a bounded sample of them
(``SAMPLE`` rows, dealt evenly over the languages, but ``EACH`` of a language at least). Prediction is one column function over the text.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is every text
when nothing can be learned. Rows without an id or a language are never learned from. Every language of
the training rows is learned; sample and model grow with their number. Repeated rows are scored alike; no row is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidewire.llm.common import fold, own, struct_array

#: Hash buckets, longest n-gram, and characters handled at once.
BUCKETS, LONGEST, AT_ONCE = 1 << 14, 3, 1 << 20
#: Rows that the regression is fitted on, and the least number of them that a language is given if it has as many.
SAMPLE, EACH = 3000, 150
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.3, 0.1, 3
UNKNOWN = "und"
#: Probability that a document needs to stay in a pipeline.
CONFIDENT = 0.5

_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and how often each occurs. Runs of other characters count as one space."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for start in range(0, max(len(text), 1), AT_ONCE):
        part = text[max(0, start - LONGEST + 1) : start + AT_ONCE] if start else text[:AT_ONCE]
        codes = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _LETTER[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF)
        codes = np.where(letter, codes, 32)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        codes = np.concatenate(([32], codes[keep], [32])).astype(np.uint32)
        mixed = np.zeros(len(codes), dtype=np.uint32)
        for n in range(1, LONGEST + 1):
            mixed = mixed[: len(codes) - n + 1] * np.uint32(0x9E3779B1) + codes[n - 1 :] + np.uint32(n)
            if len(mixed):
                total += np.bincount((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(18), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1.0 + np.log(counts)) * idf[at]
    return values / max(np.sqrt((values * values).sum()), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def probabilities(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        return softmax(values @ self.weights[at] / self.temperature)


def softmax(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return scores / scores.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights (bucket, class) after ``EPOCHS`` passes in an order that a fixed seed draws."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))
    rng = np.random.default_rng(7)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, values, target = rows[i]
            w = weights(z[at], n[at])
            error = softmax(values @ w)
            error[target] -= 1.0
            gradient = values[:, None] * error[None, :]
            step = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / ALPHA
            z[at] += gradient - step * w
            n[at] += gradient**2
    return weights(z, n).astype(np.float32)


def fit_temperature(scores: np.ndarray, targets: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden section on its logarithm."""
    if not len(targets):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(scores / np.exp(log_t))
        return -float(np.log(np.maximum(p[np.arange(len(targets)), targets], 1e-12)).mean())

    low, high, ratio = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _frequencies(batches):
    seen, rows = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            at, _ = gram_counts(text.as_py())
            seen[at] += 1
            rows += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(seen[at], rows))], ["bucket", "n"]
    )


def _grams(batches):
    for batch in batches:
        found = [gram_counts(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1),
                pa.array([at.astype(np.uint16).tobytes() for at, _ in found], pa.binary()),
                pa.array([c.astype(np.uint32).tobytes() for _, c in found], pa.binary()),
            ],
            ["lang", "rank", "at", "counts"],
        )


def fit(rows: DataFrame, lang_column: str = "lang", text_column: str = "text") -> Model:
    """A model from the rows of ``rows`` with a language and a text."""
    spark = rows.sparkSession
    rows = rows.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").count().collect()
    if not sizes:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0), np.float32), 1.0)
    counted = rows.select("text").mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    frequency = {r.bucket: r.n for r in counted.collect()}
    total = frequency.pop(-1, 0)
    idf = np.full(BUCKETS, np.log(total + 1.0) + 1.0)
    idf[list(frequency)] = np.log((total + 1.0) / (np.fromiter(frequency.values(), float) + 1.0)) + 1.0

    languages = sorted(r.lang for r in sizes)
    place = {lang: i for i, lang in enumerate(languages)}
    each = max(SAMPLE // len(languages), EACH)
    # Twice what is wanted, in expectation, then the first of each language by rank.
    share = spark.createDataFrame([(r.lang, min(1.0, 2.0 * each / r["count"])) for r in sizes], "lang string, share double")
    drawn = rows.join(F.broadcast(share), "lang").withColumn("rank", F.pmod(F.xxhash64("text"), F.lit(1 << 30)))
    drawn = drawn.where(F.col("rank") < F.col("share") * (1 << 30)).select("lang", "rank", "text").distinct()
    sample = drawn.mapInArrow(_grams, "lang string, rank long, at binary, counts binary").collect()
    examples, held, taken = [], [], dict.fromkeys(languages, 0)
    for r in sorted(sample, key=lambda r: (r["rank"], r.lang)):
        if taken[r.lang] < each:
            taken[r.lang] += 1
            at = np.frombuffer(r["at"], np.uint16).astype(np.int64)
            row = (at, weighted(at, np.frombuffer(r["counts"], np.uint32), idf), place[r.lang])
            (held if taken[r.lang] % 5 == 0 else examples).append(row)
    weights = follow_the_leader(examples, len(languages))
    scores = np.array([v @ weights[at] for at, v, _ in held]).reshape(len(held), len(languages))
    return Model(languages, idf, weights, fit_temperature(scores, np.array([t for _, _, t in held], dtype=np.int64)))


def predicted(model: Model, text: Column) -> Column:
    """A struct of the most likely language and its probability."""
    names = np.array([*model.languages, UNKNOWN], dtype=object)

    def predict(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for value in texts:
            value = value.as_py()
            if not model.languages or value is None or not any(map(str.isalpha, value)):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            at, counts = gram_counts(value)
            p = model.probabilities(at, weighted(at, counts, model.idf))
            best = int(p.argmax())
            langs.append(names[best])
            scores.append(float(p[best]))
        return struct_array(["lang_pred", "score"], [pa.string(), pa.float64()], [langs, scores])

    kind = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return F.arrow_udf(predict, kind)(text.cast("string"))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(fold("doc_id", 5) > 0)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    model = fit(training_rows(docs))
    found = docs.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), predicted(model, F.col("text")).alias(own("p"))
    )
    return found.select("doc_id", "held_out", f"{own('p')}.lang_pred", f"{own('p')}.score")


def accepted(docs: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """The rows of ``docs`` whose language is told with enough probability, with their own columns."""
    p = own("p")
    marked = docs.withColumn(p, predicted(fit(training_rows(docs)), F.col("text")))
    return marked.where((F.col(f"{p}.lang_pred") != UNKNOWN) & (F.col(f"{p}.score") >= confident)).drop(p)
