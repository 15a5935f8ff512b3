"""Operator 4: toxicity.

A text becomes a short dense vector: densities of two lexicons, how near their words stand to words of
the second person, and rates of capitals, punctuation and disguised words. Gradient-boosted trees over
these features give a margin, the mean over forests that each leave out a part of the sample; isotonic
regression on the margins of the left-out rows turns it into a probability. One lexicon is fixed, the
other is learned from the sample's labels.

All labels used come from a sample of at most ``SAMPLE`` labelled documents outside the held-out part,
drawn by a hash of the id; the text of these alone is gathered. Scores are one column function over
whole texts.

Defined results: null and empty texts are scored as texts without words. Without any usable label, or
with one kind only, the score is the share of toxic labels (0 without labels). Of several labels of one
id the highest counts; null ids and labels are never learned from. Repeated rows are scored alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidewire.llm.common import fold
from tidewire.session import cut

#: Bound of the labelled rows that are learned from, and size of the learned lexicon.
SAMPLE, LEARNED = 16_000, 256
TREES, DEPTH, RATE, BINS, SMOOTH = 80, 3, 0.15, 64, 1.0
#: Parts of the sample, each left out by one forest.
PARTS = 4
#: A learned word needs so many toxic texts, log-odds, and log-odds in units of their deviation.
LEAST_TEXTS, LEAST_ODDS, SURE = 5, 2.0, 3.2
THRESHOLD = 0.3
#: Words this near to a second-person word count as aimed at the reader.
WINDOW = 6

# General insults of four languages, and words of the second person.
INSULTS = frozenset(
    "idiot idiots stupid moron morons dumb dumbass fool loser losers pathetic worthless disgusting scum trash garbage "
    "clown jerk ugly filthy vile bastard bitch asshole shit crap retard imbecile vermin pig coward liar hate kill "
    "imbécile crétin connard salaud ordure débile minable nul dégoûtant abruti raclure "
    "dumm dummkopf trottel arschloch abschaum widerlich erbärmlich wertlos verlierer müll schwein "
    "idiota idiotas estúpido estúpida imbécil basura asqueroso inútil patético escoria perdedor payaso".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos dich dir dein deine deiner euch euer "
    "tú ti tus usted ustedes vosotros".split()
)
# "du" is a German word of the second person and a French article; these words tell which. "die", "ihr" and "sie" are
# most often an article and words of the third person in German, so they are in no list.
WITH_DU = SECOND_PERSON | {"du"}
FRENCH = frozenset("le la les l d des et est un une que qui dans pour pas ne au aux sur".split())
GERMAN = frozenset("der das die und ist nicht ein eine ich bist den dem mit auf zu".split())
_DISGUISE = str.maketrans("@$!10345*", "asiioeas ")

_WORDS = re.compile(r"[^\W\d_]+")
_SIGN_BEFORE_LETTER = re.compile(r"[@$!*#0-9](?=[^\W\d_])")
_MIXED = re.compile(r"[^\W\d_]+(?:[@$!*#0-9]+[^\W\d_]+)+")
_SPACED = re.compile(r"\b(?:[^\W\d_][ .\-]){3,}[^\W\d_]\b")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")

FEATURES = 20


def _second_person(words: list[str]) -> frozenset[str]:
    """The words of the second person; "du" is one unless the text reads as French."""
    if "du" not in words:
        return SECOND_PERSON
    french, german = (sum(map(some.__contains__, words)) for some in (FRENCH, GERMAN))
    return SECOND_PERSON if french > german else WITH_DU


def features(text: str | None, learned: dict[str, float]) -> list[float]:
    """The dense vector of one whole text."""
    text = text or ""
    lower = text.lower()
    words = _WORDS.findall(lower)
    n = max(len(words), 1)
    marked = INSULTS.union(learned)
    fixed, found, near, nearest = [], [], 0, 0.0
    person = _second_person(words)
    second = sum(map(person.__contains__, words))
    if not marked.isdisjoint(words):
        hits = [i for i, w in enumerate(words) if w in marked]
        fixed = [i for i in hits if words[i] in INSULTS]
        found = [(i, learned[words[i]]) for i in hits if words[i] in learned]
        if second:
            to = np.array([i for i, w in enumerate(words) if w in person])
            at = np.searchsorted(to, hits)
            gap = np.minimum(np.abs(to[np.minimum(at, len(to) - 1)] - hits), np.abs(to[np.maximum(at - 1, 0)] - hits))
            near, nearest = int((gap <= WINDOW).sum()), 1.0 / (1.0 + float(gap.min()))
    mixed = _MIXED.findall(lower) if _SIGN_BEFORE_LETTER.search(lower) else []
    plain = [w.translate(_DISGUISE).replace(" ", "") for w in mixed]
    plain += [re.sub(r"[ .\-]", "", m) for m in _SPACED.findall(lower)]
    if _STRETCHED.search(lower):
        plain += [_STRETCHED.sub(r"\1", w) for w in words if _STRETCHED.search(w)]
    unmasked = sum(map(marked.__contains__, plain))
    chars = max(len(text), 1)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    capitals = int(((data >= 65) & (data <= 90)).sum())
    letters = capitals + int(((data >= 97) & (data <= 122)).sum()) + int((data >= 192).sum())
    weights = [w for _, w in found]
    return [
        float(np.log1p(len(words))),
        len(fixed) / n, min(len(fixed), 50), len({words[i] for i in fixed}),
        len(found) / n, min(len(found), 50), len({words[i] for i, _ in found}),
        max(weights, default=0.0), sum(weights) / n, min(sum(weights), 200.0),
        second / n, near / n, nearest,
        capitals / max(letters, 1), len(_SHOUTED.findall(text)) / n,
        text.count("!") / chars, text.count("?") / chars, sum(map(text.count, ".,;:")) / chars,
        len(mixed) / n, min(unmasked, 50),
    ]


# ---- boosted trees -------------------------------------------------------------------------------


@dataclass
class Tree:
    """A full binary tree; node i has children 2i + 1 and 2i + 2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), dtype=np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (rows[np.arange(len(rows)), self.feature[at]] > self.cut[at])
        return self.value[at]


def _grow(binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray) -> Tree:
    nodes = 2 ** (DEPTH + 1) - 1
    tree = Tree(np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(nodes))
    at = np.zeros(len(binned), dtype=np.int64)
    for level in range(DEPTH):
        first, width = 2**level - 1, 2**level
        best = np.full(width, 1e-9)
        place = (at - first) * BINS
        for f in range(binned.shape[1]):
            g = np.bincount(place + binned[:, f], gradient, width * BINS).reshape(width, BINS).cumsum(axis=1)
            h = np.bincount(place + binned[:, f], hessian, width * BINS).reshape(width, BINS).cumsum(axis=1)
            total_g, total_h = g[:, -1:], h[:, -1:]
            gain = g**2 / (h + SMOOTH) + (total_g - g) ** 2 / (total_h - h + SMOOTH) - total_g**2 / (total_h + SMOOTH)
            gain[(h < 1.0) | (total_h - h < 1.0)] = 0.0
            gain[:, len(edges[f]) :] = 0.0
            where = gain.argmax(axis=1)
            for k in np.flatnonzero(gain[np.arange(width), where] > best):
                best[k] = gain[k, where[k]]
                tree.feature[first + k], tree.cut[first + k] = f, edges[f][where[k]]
        limit = tree.cut[at]
        chosen = tree.feature[at]
        right = np.zeros(len(at), dtype=np.int64)
        for f in np.unique(chosen):
            rows = chosen == f
            right[rows] = np.append(edges[f], np.inf)[np.minimum(binned[rows, f], len(edges[f]))] > limit[rows]
        at = 2 * at + 1 + right
    g, h = np.bincount(at, gradient, nodes), np.bincount(at, hessian, nodes)
    tree.value = -RATE * g / (h + SMOOTH)
    return tree


@dataclass
class Forest:
    """Boosted trees; the margin is the start and the sum of their values."""

    start: float
    trees: list[Tree]

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return self.start + sum((t(rows) for t in self.trees), np.zeros(len(rows)))


def boost(rows: np.ndarray, labels: np.ndarray) -> Forest:
    """A logistic model, grown by Newton steps on binned features."""
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(rows.shape[1])]
    # A feature that is nearly always zero still needs its larger values told apart.
    edges = [np.unique(np.append(e, np.quantile(c[c > 0], (0.0, 0.25, 0.5, 0.75)) - 1e-12 if (c > 0).any() else []))[: BINS - 1] for e, c in zip(edges, rows.T)]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, rows.T)], axis=1)
    rate = np.clip(labels.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(rate / (1 - rate)))
    margin, trees = np.full(len(rows), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        trees.append(_grow(binned, edges, p - labels, p * (1 - p)))
        margin += trees[-1](rows)
    return Forest(start, trees)


def isotonic(margins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and values of the non-decreasing steps that fit the labels best, both ends of a step in a row."""
    order = np.argsort(margins, kind="stable")
    blocks: list[tuple[float, float, float, int]] = []  # first and last margin, sum of labels, rows
    for x, y in zip(margins[order].tolist(), labels[order].tolist()):
        blocks.append((x, x, y, 1))
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, last, y2, n2 = blocks.pop()
            first, _, y1, n1 = blocks.pop()
            blocks.append((first, last, y1 + y2, n1 + n2))
    return np.array([e for b in blocks for e in b[:2]]), np.repeat([b[2] / b[3] for b in blocks], 2)


@dataclass
class Model:
    """The mean margin of some forests, and the steps that turn it into a probability."""

    learned: dict[str, float]
    forests: list[Forest]
    ends: np.ndarray
    levels: np.ndarray

    def margins(self, rows: np.ndarray) -> np.ndarray:
        return sum(f(rows) for f in self.forests) / len(self.forests)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        margins = self.margins(rows)
        plain = 1 / (1 + np.exp(-margins))
        if not len(self.ends):
            return plain
        # The last hundredth keeps the order inside a step.
        return np.clip(0.99 * np.interp(margins, self.ends, self.levels) + 0.01 * plain, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of ``labels(doc_id, toxic)`` on the texts of ``docs``, from rows outside the held-out part."""
    drawn = (
        labels.where((fold("doc_id", 4) != 2) & (fold("doc_id", 4) >= 0) & F.col("toxic").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    )
    drawn = cut(drawn, "labels-drawn")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")
    texts = cut(texts.select("doc_id", "text", "toxic").distinct(), "labelled")
    found = texts.groupBy("toxic").count().collect()
    kinds = {int(r.toxic > 0) for r in found}
    if len(kinds) < 2:
        share = float(kinds == {1})
        return Model({}, [Forest(30.0 if share else -30.0, [])], np.empty(0), np.empty(0))
    lexicon = _lexicon(texts)
    # Dealt to the parts by a hash of the id, which may be of any type.
    drawn_rows = texts.select(F.xxhash64("doc_id").alias("at"), "toxic", feature_column(lexicon, F.col("text")).alias("row"))
    rows = [(r["at"], np.frombuffer(r["row"], np.float64), int(r.toxic > 0)) for r in drawn_rows.collect()]
    rows.sort(key=lambda r: (r[0], r[1].tobytes(), r[2]))
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], dtype=float)
    forests, margins, judged = [], np.zeros(len(y)), np.zeros(len(y), dtype=bool)
    for part in range(PARTS):
        apart = np.arange(len(y)) % PARTS == part
        if len(set(y[~apart])) == 2:
            forests.append(boost(x[~apart], y[~apart]))
            margins[apart] = forests[-1](x[apart])
            judged |= apart
    model = Model(lexicon, forests or [boost(x, y)], np.empty(0), np.empty(0))
    if len(set(y[judged])) == 2:
        model.ends, model.levels = isotonic(margins[judged], y[judged])
    return model


def _lexicon(texts: DataFrame) -> dict[str, float]:
    """The learned lexicon of the sample; words are counted where the texts are."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))
    once = texts.where("text is not null").groupBy("text").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    totals = once.agg(F.sum("toxic"), F.count("*")).first()
    toxic, clean = totals[0] or 0, totals[1] - (totals[0] or 0)
    counts = once.select("toxic", F.explode(words).alias("word")).groupBy("word").agg(
        F.sum("toxic").alias("t"), F.count("*").alias("n")
    )
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (clean + 1))
    deviation = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("n") - F.col("t") + 0.5))
    strong = counts.where(F.col("t") >= max(LEAST_TEXTS, toxic // 100)).withColumn("odds", odds)
    strong = strong.where((F.col("odds") >= LEAST_ODDS) & (F.col("odds") >= SURE * deviation))
    return {r.word: r.odds for r in strong.orderBy(F.desc(F.col("odds") * F.col("t")), "word").limit(LEARNED).collect()}


def feature_column(lexicon: dict[str, float], text: Column) -> Column:
    def row(texts: pa.Array) -> pa.Array:
        return pa.array([np.array(features(t.as_py(), lexicon)).tobytes() for t in texts], pa.binary())

    return F.arrow_udf(row, "binary")(text)


def score_column(model: Model, text: Column) -> Column:
    def score(texts: pa.Array) -> pa.Array:
        rows = np.array([features(t.as_py(), model.learned) for t in texts]).reshape(len(texts), FEATURES)
        return pa.array(model.scores(rows), pa.float64())

    return F.arrow_udf(score, DoubleType())(text.cast("string"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scored = docs.select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), score_column(fit(docs, labels), F.col("text")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with their own columns."""
    return docs.where(score_column(fit(docs, labels), F.col("text")) < THRESHOLD)
