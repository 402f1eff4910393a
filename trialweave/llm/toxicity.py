"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words that go with the label is found on a bounded sample of labelled rows, beside a written seed list. Its
densities, their closeness to second-person words, capitals, punctuation and obfuscation rates are the features of
histogram-based boosted trees; pool-adjacent-violators on rows held back calibrates their sum to a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm import common

SAMPLE_ROWS = 16_000  # labelled documents, at most, from which lexicon, trees and calibration are learned
LEXICON_WORDS = 400
LEAST_DOCS = 4  # labelled toxic documents that a lexicon word is in, at least
FOLDS, HELD_OUT = 5, 0
CALIBRATION_FOLD = 1  # the trees leave it out, the calibration and its lexicon-free check use it

SEED = ("idiot", "stupid", "moron", "loser", "pathetic", "disgusting", "worthless", "trash", "scum", "clown", "dumb", "hate")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "tu", "te", "toi", "vous", "votre", "ton", "usted", "ti", "vos")
_FOLD = bytes.maketrans(b"013457@$!", b"oieastasi")
_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
_OBFUSCATED = re.compile(rb"[A-Za-z]+[0-9@$*!]+[A-Za-z]+")
FEATURES = (
    "log_words", "hits", "density", "distinct_hits", "strength", "best", "seed_density", "folded_hits", "near_you", "you_rate",
    "capitals", "bangs", "questions", "punctuation", "obfuscation", "longest_word",
)


@dataclass
class Lexicon:
    """Words and their weights (log odds of the label), the seed words and second-person words included."""

    weight: dict[bytes, float]

    def features(self, text: bytes) -> tuple:
        words = common.plain_words(text)
        n = max(len(words), 1)
        get = self.weight.get
        found = [(i, g) for i, g in enumerate(map(get, words)) if g is not None]
        you = [i for i, w in enumerate(words) if w in _YOU] if found else ()
        near = _closeness([i for i, _ in found], you) if you else 0.0
        odd = _OBFUSCATED.findall(text) if any(c in text for c in b"0123456789@$*!") else ()
        folded = sum(1 for w in odd if w.lower().translate(_FOLD) in self.weight)
        g = [x for _, x in found]
        distinct = {words[i] for i, _ in found}
        size = max(len(text), 1)
        return (
            np.log1p(len(words)), len(g), len(g) / n, len(distinct), sum(get(w) for w in distinct), max(g, default=0.0),
            sum(w in _SEED for w in distinct) / n, folded, near, len(you) / n,
            (len(text) - len(text.translate(None, _UPPER))) / max(len(text) - len(text.translate(None, _LETTERS)), 1),
            text.count(b"!") / n, text.count(b"?") / n, (len(text) - len(text.translate(None, b".,;:!?"))) / size,
            len(odd) / n, max(map(len, words), default=0),
        )


def _closeness(found: list[int], you: list[int]) -> float:
    """Sum of 1 / (1 + distance) from each place found to the nearest of the others, both in rising order."""
    at, to = np.array(found), np.array(you)
    k = np.searchsorted(to, at)
    away = np.minimum(np.abs(at - to[np.maximum(k - 1, 0)]), np.abs(at - to[np.minimum(k, len(to) - 1)]))
    return sum((1.0 / (1 + away)).tolist())  # in order, as the distances come


_SEED = frozenset(w.encode() for w in SEED)
_YOU = frozenset(w.encode() for w in SECOND_PERSON)


def learn_lexicon(rows: list[tuple[bytes, int]], most: int = LEXICON_WORDS, least: int = LEAST_DOCS) -> Lexicon:
    """Words in at least `least` toxic texts whose share of toxic ones is far above the whole, by log odds.

    The words of toxic texts are counted first, and clean texts for those of them alone that are frequent enough: what
    the driver holds follows the vocabulary of the toxic part of the sample.
    """
    toxic = sum(y for _, y in rows)
    clean = len(rows) - toxic
    in_toxic: Counter = Counter()
    for text, y in rows:
        if y:
            in_toxic.update(set(common.plain_words(text)))
    in_clean = {w: 0 for w, t in in_toxic.items() if t >= least}
    for text, y in rows:
        if not y:
            for w in in_clean.keys() & set(common.plain_words(text)):
                in_clean[w] += 1
    weight = {}
    for w, c in in_clean.items():
        odds = np.log((in_toxic[w] + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
        if odds > 1.5:
            weight[w] = float(odds)
    best = sorted(weight, key=lambda w: (-weight[w] * np.sqrt(in_toxic[w]), w))[:most]
    return Lexicon({w: 1.0 for w in _SEED} | {w: weight[w] for w in best})


class Trees:
    """Histogram gradient boosting with logistic loss; each tree is a full one of the given depth."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, f = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        b = np.stack([np.searchsorted(self.edges[j], x[:, j], side="right") for j in range(f)], 1)
        width = self.bins + 1
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(p / (1 - p)))
        raw = np.full(n, self.start)
        self.trees = []
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-raw))
            g, h = y - q, q * (1 - q)
            node = np.zeros(n, np.int64)
            split = np.zeros((2**self.depth - 1, 2), np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                best = np.full(count, 1e-6)
                for j in range(f):
                    key = (node - first) * width + b[:, j]
                    gl = np.bincount(key, g, count * width).reshape(count, width).cumsum(1)
                    hl = np.bincount(key, h, count * width).reshape(count, width).cumsum(1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[:, len(self.edges[j]) :] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(count), at]
                    for k in np.flatnonzero(top > best):
                        best[k], split[first + k] = top[k], (j, at[k])
                    # nodes without a useful split send all rows left
                for k in np.flatnonzero(best <= 1e-6):
                    split[first + k] = (0, width)
                s = split[node]
                node = 2 * node + 1 + (b[np.arange(n), s[:, 0]] > s[:, 1])
            leaf = node - (2**self.depth - 1)
            value = np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.ridge) * self.rate
            raw += value[leaf]
            self.trees.append((split, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for split, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                s = split[node]
                node = 2 * node + 1 + (b[rows, s[:, 0]] > s[:, 1])
            out += value[node - (2**self.depth - 1)]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and the non-decreasing values at them, the least-squares fit. Equal scores are pooled first.

    A block of pooled scores has a knot at either end, so that every score inside it gets its mean; lines run between blocks.
    """
    at, inverse = np.unique(raw, return_inverse=True)
    blocks: list[list[float]] = []  # sum, weight, first knot, last knot
    for k, (s, w) in enumerate(zip(np.bincount(inverse, y), np.bincount(inverse), strict=True)):
        blocks.append([s, w, k, k])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, w2, _, end = blocks.pop()
            blocks[-1][0] += s2
            blocks[-1][1] += w2
            blocks[-1][3] = end
    ends = [(k, b[0] / b[1]) for b in blocks for k in sorted({b[2], b[3]})]
    return at[[k for k, _ in ends]], np.array([v for _, v in ends])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: np.ndarray
    values: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), float(self.values[0]))
        raw = self.trees.raw(np.array([self.lexicon.features(t) for t in texts], float).reshape(-1, len(FEATURES)))
        calibrated = np.interp(raw, self.knots, self.values)
        # a little of the trees' own order stays, so that rows within one calibrated step differ; 0.5 is never crossed
        nudged = np.clip(calibrated, 1e-6, 1 - 1e-6) + 1e-6 * np.tanh(raw / 10)
        return np.clip(np.where((nudged >= 0.5) == (calibrated >= 0.5), nudged, calibrated), 0.0, 1.0)


def fit(rows: list[tuple[bytes, int, int]]) -> Model:
    """A model from (text, label, fold) rows: lexicon and trees from all folds but one, the calibration from that one."""
    labels = np.array([y for _, y, _ in rows], float)
    if len(rows) < 20 or labels.min() == labels.max():
        rate = float(labels.mean()) if len(rows) else 0.0
        return Model(Lexicon({w: 1.0 for w in _SEED}), None, np.zeros(1), np.array([rate]))
    train = [r for r in rows if r[2] != CALIBRATION_FOLD] or rows
    if len({y for _, y, _ in train}) < 2:
        train = rows
    # the lexicon of one half gives the features that the trees see of the other half: its words never fit their own rows
    halves = [train[::2], train[1::2]]
    split = [learn_lexicon([r[:2] for r in h]) for h in halves]
    x = [split[1 - k].features(t) for k, h in enumerate(halves) for t, _, _ in h]
    y = np.array([y for h in halves for _, y, _ in h], float)
    trees = Trees().fit(np.array(x, float), y)
    lexicon = learn_lexicon([r[:2] for r in train])
    held = [r for r in rows if r[2] == CALIBRATION_FOLD]
    if len({y for _, y, _ in held}) < 2:
        held = rows
    raw = trees.raw(np.array([lexicon.features(t) for t, _, _ in held], float))
    return Model(lexicon, trees, *isotonic(raw, np.array([y for _, y, _ in held], float)))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """From at most `rows` labelled documents outside the held-out fold, and `common.SAMPLE_BYTES` of their texts, taken in
    the order of a hash of their ids."""
    usable = labels.where(F.col("doc_id").isNotNull() & ~common.fold_is(F.col("doc_id"), FOLDS, HELD_OUT))
    sample = common.labelled_sample(usable, "toxic", rows)
    sample = sample.withColumn("fold", F.pmod(common.id_crc(F.col("doc_id")), F.lit(FOLDS)))
    got = [(bytes(r.text or b""), int(r.label > 0), int(r.fold)) for r in common.bounded_texts(common.id_and_text(docs), sample, rows)]
    return fit(got)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    A null text counts as empty and gets the score of an empty text. Repeated rows each give a row; a null doc_id is
    never held out and never learned from. With labels of one kind or too few, the score is their mean. Labels, lang,
    source and doc_id are no inputs of a score.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, rows))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in common.sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(common.texts(batch)), pa.float64())], ["doc_id", "score"])

    out = common.id_and_text(docs).mapInArrow(make, "doc_id long, score double")
    return out.select(
        "doc_id", common.fold_is(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
