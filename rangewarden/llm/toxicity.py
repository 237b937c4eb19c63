"""Severity of toxicity by cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangewarden.llm._common import batched, freed, record, table, texts
from rangewarden.llm.vocab import WordTable

#: Features are hashed to so many places; labelled documents a model is fitted on, at most.
PLACES, SAMPLE = 1 << 20, 6000
#: A word's features: itself, and its first letters if it has more.
STARTS = (4, 5, 6)
#: Grades above 0; toxic documents that a feature must occur in; parts of the sample that take turns in grading.
TOP, LEAST, FOLDS = 3, 3, 3
_SPLIT = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    own = [word, *(f"{word[:n]}*" if len(word) > n else word for n in STARTS)]
    return [xxhash.xxh32_intdigest(x.encode()) % PLACES for x in own]


def distinct_words(text: str) -> set[str]:
    """The distinct words of a whole text in lower case: its runs of letters."""
    return set(_SPLIT.findall(text.lower()))


@dataclass
class Severity:
    """P(grade > k) = sigmoid(score - threshold k); the score is the sum of the weights of the distinct words' features."""

    weights: dict[int, float]
    thresholds: np.ndarray

    def word_scores(self, words: list[str]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in set(word_features(w))) for w in words]

    def above(self, score) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.thresholds - np.asarray(score, np.float64)[:, None], -500, 500)))


def design(docs: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and columns of the ones of the documents' features, and which features they are: all that occur in LEAST toxic documents."""
    own = []
    for feats in docs:
        # Words that end before their start of so many letters have a feature twice: it counts once, as do features of several words.
        own.append(np.unique(feats))
    count = np.zeros(PLACES, np.int64)
    for f, t in zip(own, toxic, strict=True):
        if t:
            count[f] += 1
    used = np.flatnonzero(count >= LEAST)
    at = np.full(PLACES, -1, np.int64)
    at[used] = np.arange(len(used))
    cols = [x[x >= 0] for x in (at[f] for f in own)]
    row = np.repeat(np.arange(len(docs)), list(map(len, cols))) if cols else np.zeros(0, np.int64)
    return row, np.concatenate(cols).astype(np.int64) if cols else np.zeros(0, np.int64), used


def loss(w: np.ndarray, theta: np.ndarray, row: np.ndarray, col: np.ndarray, y: np.ndarray, weigh: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean weighted negative log likelihood of grades y, and its gradients by weights and thresholds: P(grade <= k) = sigmoid(threshold k - score)."""
    n, top = len(y), len(theta)
    s = np.bincount(row, w[col], n)
    edge = np.concatenate([np.full((n, 1), -np.inf), np.broadcast_to(theta, (n, top)), np.full((n, 1), np.inf)], axis=1) - s[:, None]
    p = 1 / (1 + np.exp(-np.clip(edge, -40, 40)))
    p[:, 0], p[:, -1] = 0, 1
    a, b = p[np.arange(n), y + 1], p[np.arange(n), y]
    gap = np.maximum(a - b, 1e-9)
    by_weight = np.bincount(col, (weigh * (1 - a - b))[row], len(w)) / n
    by_threshold = (np.bincount(y, -weigh * a * (1 - a) / gap, top + 1)[:top] + np.bincount(y, weigh * b * (1 - b) / gap, top + 1)[1:]) / n
    return float(-(weigh * np.log(gap)).sum() / n), by_weight, by_threshold


def ordinal(row: np.ndarray, col: np.ndarray, features: int, y: np.ndarray, top: int, rounds: int = 200, rate: float = 0.3, l1: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ``top`` ordered thresholds by maximum likelihood with an L1 term, by proximal AdaGrad; each document above grade 0 weighs as the fourth root of how much rarer those are.

    Weights are sparse and not negative, so plain words can't outweigh an insult.
    """
    share = np.maximum(np.bincount(y, minlength=top + 1), 0.5)[: top + 1]
    below = np.clip(np.cumsum(share)[:-1] / share.sum(), 1e-3, 1 - 1e-3)
    theta = np.log(below / (1 - below))
    weigh = np.where(y > 0, max(1.0, ((y == 0).sum() / max(1, (y > 0).sum())) ** 0.25), 1.0)
    w, gw, gt = np.zeros(features), np.full(features, 1e-8), np.full(top, 1e-8)
    for _ in range(rounds):
        _, grad, gth = loss(w, theta, row, col, y, weigh)
        gw += grad**2
        gt += gth**2
        step = rate / np.sqrt(gw)
        w = np.maximum(0, w - step * grad - step * l1)
        theta = np.maximum.accumulate(theta - rate * gth / np.sqrt(gt) + 1e-4 * np.arange(top))
    return w, theta


def grades(row: np.ndarray, col: np.ndarray, features: int, toxic: np.ndarray) -> np.ndarray:
    """Ordered grades from yes/no labels. 0 is not toxic; a toxic document's grade is how strongly a yes/no model speaks for it that was fitted without it: the lower, middle or upper third of toxic documents."""
    n = len(toxic)
    fold = np.zeros(n, np.int64)
    for t in (False, True):
        fold[toxic == t] = np.arange((toxic == t).sum()) % FOLDS
    odds = np.zeros(n)
    for k in range(FOLDS):
        learn = np.flatnonzero(fold != k)
        place = np.full(n, -1)
        place[learn] = np.arange(len(learn))
        here = place[row] >= 0
        w, _ = ordinal(place[row[here]], col[here], features, toxic[learn].astype(np.int64), 1, rounds=100)
        odds[fold == k] = np.bincount(row, w[col], n)[fold == k]
    y = np.zeros(n, np.int64)
    if toxic.any():
        cuts = np.quantile(odds[toxic], [i / TOP for i in range(1, TOP)])
        y[toxic] = 1 + np.searchsorted(cuts, odds[toxic], side="left")
    return y


def fit_grades(docs: list[np.ndarray], toxic: np.ndarray) -> Severity:
    row, col, used = design(docs, toxic)
    if not toxic.any() or not len(used):
        return Severity({}, 20.0 + np.arange(TOP))  # nothing to learn toxicity from: nothing is toxic
    w, theta = ordinal(row, col, len(used), grades(row, col, len(used), toxic), TOP)
    return Severity({int(f): float(x) for f, x in zip(used, w, strict=True) if x}, theta)


def fit(df: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Severity:
    """A model from df (doc_id, text) and labels (doc_id, toxic): at most ``sample`` labelled documents, those of the lowest hash of doc_id.

    Rows that share a doc_id are that many documents; of them and all others no more than the sample's size is taken.
    """
    batched(df.sparkSession)
    picked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    train = texts(df, "doc_id").join(F.broadcast(picked), "doc_id").select("toxic", "text")
    schema = pa.schema([("toxic", pa.int32()), ("feats", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            feats = [np.array([word_features(w) for w in sorted(distinct_words(t))], "<u4").tobytes() for t in b.column(1).to_pylist()]
            yield record(schema, b.column(0).cast(pa.int32()), feats)

    got = train.orderBy(F.xxhash64("text"), "text", "toxic").limit(sample).mapInArrow(freed(run), "toxic int, feats binary").collect()
    got.sort(key=lambda r: (r["toxic"], bytes(r["feats"])))  # the same model however tasks end
    docs = [np.frombuffer(r["feats"], "<u4").reshape(-1, 1 + len(STARTS)) for r in got]
    return fit_grades(docs, np.array([r["toxic"] > 0 for r in got], bool))


def score(df: DataFrame, model: Severity) -> DataFrame:
    """doc_id, severity (expected grade), grade (the most probable one), toxic (whether grade 0 is the less likely), for every row's whole text.

    Null text counts as empty and, like any text without words, gets the severity of no evidence.
    Repeated rows get a row each; other columns stay behind; an empty table gives none; nothing is shuffled. Texts of any
    length count as a whole; of equally probable grades the lowest is taken.
    """
    batched(df.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("grade", pa.int32()), ("toxic", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordTable(model.word_scores)
        for b in batches:
            found = b.column(1).to_pylist()
            sums = [sum(x) for lo in range(0, len(found), 128) for x in known.rows([list(distinct_words(t)) for t in found[lo : lo + 128]])]
            above = model.above(sums)
            each = np.concatenate([np.ones((len(sums), 1)), above], axis=1) - np.concatenate([above, np.zeros((len(sums), 1))], axis=1)
            yield record(schema, b.column(0), pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] >= 0.5))

    return texts(df, "doc_id").mapInArrow(freed(run), "doc_id long, severity double, grade int, toxic boolean")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
