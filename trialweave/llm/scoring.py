"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

Token counts come from all training documents. Frequent words (a bounded table) are known to every worker; rarer ones
meet their counts in a join. The neural model has two levels: it predicts a unit (a word of its own for the most frequent,
a class by word ending for others, one unit for all rarer words) and then the member of the class: each word of the
vocabulary is one, and all words of the class beyond the vocabulary are one more, shared by corpus counts. Every word of
the vocabulary has a vector of its own as context and as target. Both softmaxes run over all their members, so the
probabilities of all words, one unknown word included, sum to one.

A bounded sample gives the tables their first values; from these, every task trains on all training documents that it
reads, and each row of the tables becomes the mean of what the tasks make of it, by the tokens that they used it for.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm import common

FOLDS, HELD_OUT = 5, 1
FREQUENT = 400_000  # words of the broadcast table, at most
OWN_UNITS, CLASS_UNITS = 31, 100
VOCABULARY = 20_000  # words with vectors of their own
CONTEXT, WIDTH = 3, 16
BATCH, NOISE, NOISE_MEMBERS, RATE = 8192, 32, 2, 0.05  # of the training: tokens of a step, draws for a step and for a token
SAMPLE_DOCS = 1_500  # documents, at most, from which the neural model's tables get their first values
SAMPLE_TOKENS = 300_000
FIRST_BATCH, GROWS = 512, 32  # tokens of the first steps, and after how many steps they double, up to BATCH
GATHERED = 65_536  # tokens that a task gathers and mixes before it trains on them
FLUSH_WORDS = 200_000  # distinct words that a task counts before it hands them on
CLIP = 1_000  # counts from here on are one class when the table's least count is sought
END = b""  # the end token; no word is empty

_workers: dict = {}


def count_words(docs: DataFrame) -> DataFrame:
    """word, c: how often each token stands in the documents, the end of each document included."""

    def table(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in common.sliced(batches, 256):
            for text in common.texts(batch):
                seen.update(common.space_words(text))
            seen[END] += batch.num_rows
            if len(seen) > FLUSH_WORDS:
                yield table(seen)
                seen = Counter()
        yield table(+seen)

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(make, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def least_count(counts: DataFrame, most: int) -> int:
    """The least count with which at most `most` words qualify as frequent."""
    by = {r[0]: r[1] for r in counts.groupBy(F.least("c", F.lit(CLIP)).alias("k")).count().collect()}
    total, at = 0, CLIP
    for k in range(CLIP, 0, -1):
        total += by.get(k, 0)
        if total > most:
            break
        at = k
    if by.get(CLIP, 0) <= most:
        return at
    low, high = CLIP, counts.agg(F.max("c")).first()[0] + 1  # more words than fit have very high counts: bisect
    while low < high:
        middle = (low + high) // 2
        if counts.where(F.col("c") >= middle).count() <= most:
            high = middle
        else:
            low = middle + 1
    return low


@dataclass
class Words:
    """What becomes of the frequent words, by falling count: their units, members of classes and rows as context.

    Units: 0 for rarer words, then words of their own, then classes by ending. The members of class k stand from first[k]
    to first[k + 1]: all words beyond the vocabulary as one, then each of the vocabulary. Context rows: 0 for rarer words,
    then the vocabulary, then a row for each class.
    """

    unit: np.ndarray
    member: np.ndarray  # -1 for words of their own
    row: np.ndarray
    share: np.ndarray  # log10 of a word's share of its member
    first: np.ndarray
    mass: np.ndarray  # of the units
    members: np.ndarray  # mass of the members

    @property
    def n_rows(self) -> int:
        return 1 + VOCABULARY + CLASS_UNITS


def placed(words: list[bytes], counts: np.ndarray, total: int, distinct: int) -> Words:
    n = len(words)
    rank = np.arange(n)
    ending = np.fromiter((zlib.crc32(w[-3:]) % CLASS_UNITS for w in words), np.int64, n)
    own, known = rank < OWN_UNITS, rank < VOCABULARY
    unit = np.where(own, 1 + rank, 1 + OWN_UNITS + ending)
    sizes = 1 + np.bincount(ending[~own & known], minlength=CLASS_UNITS)
    first = np.concatenate(([0], np.cumsum(sizes)))
    member = np.where(own, -1, first[ending])
    inside = np.flatnonzero(~own & known)
    inside = inside[np.argsort(ending[inside], kind="stable")]
    member[inside] = first[ending[inside]] + 1 + np.arange(len(inside)) - (first[:-1] - np.arange(CLASS_UNITS))[ending[inside]]
    row = np.where(known, 1 + rank, 1 + VOCABULARY + ending)
    n_units = 1 + OWN_UNITS + CLASS_UNITS
    mass = np.bincount(unit, counts + 0.5, n_units).astype(float)
    mass[0] = max(total + 0.5 * (distinct + 1) - mass[1:].sum(), 0.5)
    members = np.bincount(member[~own], (counts + 0.5)[~own], first[-1]).astype(float)
    share = np.zeros(n)
    share[~own] = np.log10((counts + 0.5)[~own] / members[member[~own]])
    return Words(unit, member, row, share, first, mass, members)


def contexts(rows: np.ndarray, starts: np.ndarray, first: int) -> np.ndarray:
    """(tokens, CONTEXT) rows of the words before each token, `first` before a document's beginning."""
    at = np.arange(len(rows))
    out = np.empty((len(rows), CONTEXT), np.int64)
    for j in range(CONTEXT):
        back = at - j - 1
        out[:, j] = np.where(back >= starts, rows[np.maximum(back, 0)], first)
    return out


#: The tables, one below the other with a row of WIDTH numbers and a bias each: context rows, place weights, units, members.
PARTS = ("r", "c", "q", "m")


def part_sizes(words: Words) -> list[int]:
    return [words.n_rows, CONTEXT, len(words.mass), int(words.first[-1])]


def first_tables(words: Words, seed: int = 3) -> np.ndarray:
    """Small random vectors, falling weights of places, biases from the corpus."""
    sizes = part_sizes(words)
    out = np.random.default_rng(seed).normal(0, 0.1, (sum(sizes), WIDTH + 1)).astype(np.float32)
    r, c, q, _ = np.cumsum(sizes)
    out[:, WIDTH] = 0
    out[r:c, :WIDTH] = 1 / np.arange(1, CONTEXT + 1)[:, None]
    out[c:q, WIDTH] = np.log(np.maximum(words.mass, 0.5) / words.mass.sum())
    of = np.repeat(np.arange(CLASS_UNITS), np.diff(words.first))
    out[q:, :WIDTH] *= 0.3
    out[q:, WIDTH] = np.log(np.maximum(words.members, 0.5) / np.maximum(np.bincount(of, words.members, CLASS_UNITS)[of], 0.5))
    return out


def _added(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of the rows from each cut to the next. Pairs of float32 are added as one complex number: half the calls."""
    if values.dtype != np.float32 or values.shape[1] % 2:
        return np.add.reduceat(values, cuts, axis=0)
    return np.add.reduceat(np.ascontiguousarray(values).view(np.complex64), cuts, axis=0).view(np.float32)


def _summed(rows: np.ndarray, values: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the sums of their values and how often each stands there; `values` gives them in an order."""
    order = np.argsort(rows.astype(np.uint16) if rows.max() < 1 << 16 else rows, kind="stable")
    at = rows.take(order)
    cuts = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    times = np.diff(np.append(cuts, len(at)))
    out = values(order.take(cuts))  # most rows stand there once
    several = np.flatnonzero(times > 1)
    if len(several):
        sizes = times.take(several)
        out[several] = _added(values(order[np.repeat(times > 1, times)]), np.cumsum(sizes) - sizes)
    return at.take(cuts), out, times


class Trainer:
    """Noise-contrastive estimation of both levels; steps of Adagrad on the rows that a batch touches.

    Noise units come from the corpus and are shared within a batch; noise members come from the token's own class.
    """

    def __init__(self, words: Words, tables: np.ndarray, seed: int = 3, rate: float = RATE):
        common.one_thread()
        self.words, self.tables = words, tables.copy()
        self.squares = np.full(tables.shape, 1e-2, np.float32)
        self.used = np.zeros(len(tables), np.int64)
        self.begin = dict(zip(PARTS, np.concatenate(([0], np.cumsum(part_sizes(words))[:-1])).tolist(), strict=True))
        p = np.maximum(words.mass, 0.5)
        self.p = p / p.sum()
        self.offset = np.log(NOISE * self.p).astype(np.float32)
        mass = np.maximum(words.members, 1e-9)
        self.upto = np.cumsum(mass)
        edge = np.concatenate(([0.0], self.upto))[words.first]
        self.low, self.width = edge[:-1], np.diff(edge)
        of = np.repeat(np.arange(CLASS_UNITS), np.diff(words.first))
        self.of, self.member_offset = of, np.log(NOISE_MEMBERS * mass / self.width[of]).astype(np.float32)
        self.rng, self.rate, self.steps = np.random.default_rng(seed), rate, 0

    def run(self, units: np.ndarray, members: np.ndarray, ctx: np.ndarray) -> None:
        """One pass over the tokens in mixed order."""
        order = self.rng.permutation(len(units))
        at = 0
        while at < len(order):
            rows = order[at : at + min(BATCH, FIRST_BATCH << min(self.steps // GROWS, 20))]
            self._batch(units.take(rows), members.take(rows), ctx.take(rows, axis=0))
            at += len(rows)
            self.steps += 1

    def _step(self, rows: np.ndarray, g: np.ndarray, times: np.ndarray) -> None:
        g = g[:, : WIDTH + 1]
        s = g * g
        s += self.squares.take(rows, axis=0)
        self.squares[rows] = s
        s = np.divide(g, np.sqrt(s, out=s), out=s)
        s *= self.rate
        s += self.tables.take(rows, axis=0)
        self.tables[rows] = s
        self.used[rows] += times

    def _batch(self, units: np.ndarray, members: np.ndarray, ctx: np.ndarray) -> None:
        """Rows are taken by `take`, several times as fast as by an index; those that are summed have an even width."""
        t, n, w, even = self.tables, len(units), WIDTH, WIDTH + 2 - WIDTH % 2
        r0, c0, q0, m0 = (self.begin[k] for k in PARTS)
        rows = r0 + ctx
        places = np.zeros((CONTEXT, even), np.float32)
        places[:, :w] = t[c0 : c0 + CONTEXT, :w]
        vectors = [t.take(rows[:, j], axis=0)[:, :w] for j in range(CONTEXT)]
        both = np.zeros((n, even), np.float32)
        both[:, w] = 1
        hidden = both[:, :w]
        for v, place in zip(vectors, places, strict=True):
            hidden += v * place[:w]
        drawn = self.rng.choice(len(self.p), NOISE, p=self.p)
        own, noise = t.take(q0 + units, axis=0), t.take(q0 + drawn, axis=0)
        good = np.einsum("ij,ij->i", hidden, own[:, :w]) + own[:, w] - self.offset.take(units)
        bad = hidden @ noise[:, :w].T
        bad += noise[:, w] - self.offset[drawn]
        e_good = _missing(good)  # 1 - sigma
        e_bad = -_missing(np.negative(bad, out=bad))
        g_context = np.zeros((n, even), np.float32)
        g_hidden = g_context[:, :w]
        np.multiply(e_good[:, None], own[:, :w], out=g_hidden)
        g_hidden += e_bad @ noise[:, :w]
        picked_units = np.concatenate([units, drawn])
        g_units = np.concatenate([e_good[:, None] * both, e_bad.T @ both])
        steps = [_summed(q0 + picked_units, lambda order: g_units.take(order, axis=0))]
        inside = np.flatnonzero(members >= 0)
        if len(inside):
            true = members.take(inside)
            k = self.of.take(true)
            at = self.rng.random((len(inside), NOISE_MEMBERS)) * self.width.take(k)[:, None]
            at += self.low.take(k)[:, None]
            other = np.minimum(np.searchsorted(self.upto, at, side="right"), (self.words.first.take(k + 1) - 1)[:, None])
            picked = np.concatenate([true[:, None], other], 1)
            target = t.take(m0 + picked, axis=0)
            wide, per = both.take(inside, axis=0), picked.shape[1]
            score = np.einsum("ikj,ij->ik", target[:, :, :w], wide[:, :w]) + target[:, :, w] - self.member_offset.take(picked)
            e = -_missing(-score)
            e[:, 0] += 1
            g_hidden[inside] += np.einsum("ik,ikj->ij", e, target[:, :, :w])
            flat = e.ravel()
            steps.append(_summed(m0 + picked.ravel(), lambda order: flat.take(order)[:, None] * wide.take(order // per, axis=0)))
        g_places = np.zeros((CONTEXT, w + 1), np.float32)
        g_places[:, :w] = [np.einsum("ik,ik->k", v, g_hidden) for v in vectors]
        self._step(np.arange(c0, c0 + CONTEXT), g_places, np.full(CONTEXT, n))
        steps.append(_summed(rows.ravel(), lambda order: g_context.take(order // CONTEXT, axis=0) * places.take(order % CONTEXT, axis=0)))
        for step in steps:
            self._step(*step)


def _missing(scores: np.ndarray) -> np.ndarray:
    """1 - sigma of the scores, in their own array."""
    np.exp(np.clip(scores, -30, 30, out=scores), out=scores)
    scores += 1
    return np.divide(1, scores, out=scores)


class Coded:
    """Texts as units, members and context rows of their tokens."""

    def __init__(self, names: list[bytes], words: Words):
        self.number = {w: k for k, w in enumerate(names)}
        self.unit, self.member, self.row = (np.append(x, y) for x, y in ((words.unit, 0), (words.member, -1), (words.row, 0)))
        self.first = int(self.row[self.number.get(END, -1)])

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        """Numbers of the words, -1 for those that are not frequent: it is also the place of what these have."""
        return np.fromiter(map(self.number.get, tokens, repeat(-1)), np.int64, len(tokens))

    def trained(self, trainer: Trainer, docs: list[np.ndarray]) -> None:
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        k = np.concatenate(docs)
        trainer.run(self.unit.take(k), self.member.take(k), contexts(self.row.take(k), np.repeat(np.cumsum(sizes) - sizes, sizes), self.first))


def train_on_all(training: DataFrame, names: list[bytes], words: Words, tables: np.ndarray) -> np.ndarray:
    """The tables after a pass over all training documents: each row by the mean of the tasks' changes to it, weighed by
    how often they used it. Tasks hand on the rows that they used; these are summed by row before anything is collected."""
    spark = training.sparkSession
    shipped = spark.sparkContext.broadcast((names, words, tables))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, words, tables = shipped.value
        coded, trainer = Coded(names, words), Trainer(words, tables)
        docs: list[np.ndarray] = []
        size = 0
        for batch in common.sliced(batches, 256):
            for text in common.texts(batch):
                docs.append(coded.numbers([*common.space_words(text), END]))
                size += len(docs[-1])
                if size >= GATHERED:
                    coded.trained(trainer, docs)
                    docs, size = [], 0
        if docs:
            coded.trained(trainer, docs)
        rows = np.flatnonzero(trainer.used)
        n = trainer.used[rows].astype(np.float64)
        change = (trainer.tables[rows] - tables[rows]).astype(np.float64) * n[:, None]
        columns = [pa.array(np.ascontiguousarray(change[:, j])) for j in range(WIDTH + 1)]
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(n), *columns], names_of)

    names_of = ["row", "n", *[f"d{j}" for j in range(WIDTH + 1)]]
    trained = training.select(F.col("text").cast("binary").alias("text")).mapInArrow(make, "row long, " + ", ".join(f"{c} double" for c in names_of[1:]))
    means = [(F.sum(f"d{j}") / F.sum("n")).cast("float").alias(f"d{j}") for j in range(WIDTH + 1)]
    got = trained.groupBy("row").agg(*means).toArrow()  # a row for each of the tables, whose number is bounded
    shipped.unpersist()
    out = tables.copy()
    if got.num_rows:
        out[got.column("row").to_numpy()] += np.stack([got.column(f"d{j}").to_numpy() for j in range(WIDTH + 1)], 1).astype(np.float32)
    return out


@dataclass
class Model:
    """Frequent words, their counts and places, and the trained tables: the context's vectors already at their places."""

    blob: bytes
    counts: np.ndarray
    words: Words
    rare_log: float  # log10 of the mass of the rare unit
    context: np.ndarray  # (CONTEXT, rows, WIDTH)
    target: np.ndarray
    bias: np.ndarray
    member: np.ndarray
    member_bias: np.ndarray

    @property
    def names(self) -> list[bytes]:
        return self.blob.split(b"\n") if len(self.counts) else []


def build(names: list[bytes], counts: np.ndarray, total: int, distinct: int, sample: list[bytes], further: Callable | None = None, epochs: int = 3) -> Model:
    """The model from frequent words by falling count, the corpus totals and sample texts.

    `further` trains on, from names, places and tables.
    """
    words = placed(names, counts, total, distinct)
    tables = first_tables(words)
    if sample:
        coded, trainer = Coded(names, words), Trainer(words, tables)
        docs = [coded.numbers([*common.space_words(t), END]) for t in sample]
        for _ in range(epochs):
            coded.trained(trainer, docs)
        tables = further(names, words, trainer.tables) if further else trainer.tables
    r, c, q, m = np.split(tables, np.cumsum(part_sizes(words))[:-1])
    context = np.stack([r[:, :WIDTH] * c[j, :WIDTH] for j in range(CONTEXT)])
    # what has no word at all takes no probability
    bias = np.where(words.mass > 0, q[:, WIDTH], -1e4).astype(np.float32)
    member_bias = np.where(words.members > 0, m[:, WIDTH], -1e4).astype(np.float32)
    return Model(b"\n".join(names), counts, words, float(np.log10(words.mass[0])), context, q[:, :WIDTH], bias, m[:, :WIDTH], member_bias)


class Softmax:
    """Natural logs of a softmax at one place of each row, by a matrix product that holds the biases."""

    def __init__(self, target: np.ndarray, bias: np.ndarray):
        self.table = np.ascontiguousarray(np.concatenate([target, bias[:, None]], 1).T)
        self.length = float(np.sqrt((target**2).sum(1)).max())
        self.top = float(bias.max())
        self.ones = np.ones(len(bias), np.float32)

    def logs(self, hidden: np.ndarray, at: np.ndarray) -> np.ndarray:
        """hidden has a last column of ones."""
        scores = hidden @ self.table
        got = scores.ravel().take(np.arange(0, scores.size, scores.shape[1]) + at).astype(np.float64)
        if np.sqrt(np.einsum("ij,ij->i", hidden, hidden).max()) * self.length + self.top < 60:  # no score is too large for its exponential
            sums = np.exp(scores, out=scores) @ self.ones
            if sums.min() > 1e-20:
                return got - np.log(sums)
            scores = hidden @ self.table
        highest = scores.max(1)
        return got - highest - np.log(np.exp(scores - highest[:, None]).sum(1))


class Scorer:
    """A worker's copy of the model with the words in a dictionary."""

    def __init__(self, model: Model):
        common.one_thread()
        self.model, self.coded = model, Coded(model.names, model.words)
        first = model.words.first
        self.units = Softmax(model.target, model.bias)
        self.classes = [Softmax(model.member[a:b], model.member_bias[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        self.log_counts = np.append(np.log10(model.counts + 0.5), 0.0)
        self.share = np.append(model.words.share, -model.rare_log)

    def logs(self, numbers: np.ndarray, ctx: np.ndarray, block: int = 2048) -> np.ndarray:
        """log10 probabilities of words after their contexts, by batched matrix products over units and over the members of
        each class; for words that are not frequent, those of each of them but for its count."""
        m, coded = self.model, self.coded
        units, members = coded.unit.take(numbers), coded.member.take(numbers)
        out = np.empty(len(units))
        hidden = np.ones((len(units), WIDTH + 1), np.float32)
        for a in range(0, len(units), block):
            h = ctx[a : a + block]
            hidden[a : a + block, :WIDTH] = sum(m.context[j].take(h[:, j], axis=0) for j in range(CONTEXT))
            out[a : a + block] = self.units.logs(hidden[a : a + block], units[a : a + block])
        inside = np.flatnonzero(members >= 0)
        inside = inside[np.argsort(units[inside], kind="stable")]
        for rows in np.split(inside, np.flatnonzero(np.diff(units[inside])) + 1) if len(inside) else ():
            k = int(units[rows[0]]) - 1 - OWN_UNITS
            for a in range(0, len(rows), block):
                some = rows[a : a + block]
                out[some] += self.classes[k].logs(hidden.take(some, axis=0), members.take(some) - m.words.first[k])
        return out / np.log(10) + self.share[numbers]

    def score(self, docs: list[list[bytes]]) -> tuple:
        """For each document: tokens, frequent ones, their base and model logs, and its rare words with their numbers."""
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        flat = [w for d in docs for w in d]
        k = self.coded.numbers(flat)
        known = k >= 0
        of = np.repeat(np.arange(len(docs)), sizes)
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        logs = self.logs(k, contexts(self.coded.row[k], starts, self.coded.first))
        n = len(docs)
        places = np.flatnonzero(~known)
        cuts = np.searchsorted(of[places], np.arange(n + 1)).tolist()
        places = places.tolist()
        rare = [Counter(map(flat.__getitem__, places[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return sizes, np.bincount(of, known, n).astype(np.int64), np.bincount(of, self.log_counts[k], n), np.bincount(of, logs, n), rare


def learn(docs: DataFrame, frequent: int, sample_docs: int) -> tuple[Model, DataFrame, int, int, int]:
    """The model, all counts, the least count of a frequent word, and the numbers of tokens and words."""
    training = docs.where(~common.fold_is(F.col("doc_id"), FOLDS, HELD_OUT))
    counts = common.staged(count_words(training), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = least_count(counts, frequent)
    got = counts.where(F.col("c") >= least).toArrow()  # at most `frequent` rows
    words = [bytes(w) for w in got.column("word").to_pylist()]
    c = np.array(got.column("c").to_pylist(), np.float64)
    order = sorted(range(len(words)), key=lambda j: (-c[j], words[j]))
    words, c = [words[j] for j in order], c[order] if len(words) else c
    ids = training.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    sample, size = [], 0
    for row in common.bounded_texts(common.id_and_text(training), ids, sample_docs):
        if size < SAMPLE_TOKENS:
            sample.append(bytes(row.text or b""))
            size += 1 + len(sample[-1].split())
    return build(words, c, total, distinct, sample, partial(train_on_all, training)), counts, least, total, distinct


def _lists(rare: list[Counter]) -> pa.Array:
    """The words and numbers of each document as a list of structs."""
    ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in rare]))).astype(np.int32))
    words, numbers = pa.array([w for x in rare for w in x], pa.binary()), pa.array([k for x in rare for k in x.values()], pa.int64())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([words, numbers], ["word", "n"]))


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_frequent long, base double, model double, rare array<struct<word:binary,n:long>>"


def scores(docs: DataFrame, frequent: int = FREQUENT, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    A null text counts as empty: its end token alone. A null doc_id is in no fold and so among those learned from;
    repeated rows count and are scored each. Without training documents every token is unknown. Other columns are ignored.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model, counts, least, total, distinct = learn(plain, frequent, sample_docs)
    shipped = spark.sparkContext.broadcast(model)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _workers.get("model") is not shipped.value:
            _workers.update(model=shipped.value, scorer=Scorer(shipped.value))
        scorer, rid = _workers["scorer"], TaskContext.get().partitionId() << 40
        for batch in common.sliced(batches, 256):
            sizes, n, base, logs, rare = scorer.score([[*common.space_words(t), END] for t in common.texts(batch)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(rid, rid + len(sizes))), batch.column(0), batch.column(2), pa.array(sizes), pa.array(n), pa.array(base), pa.array(logs),
                    _lists(rare),
                ],
                ["rid", "doc_id", "held_out", "n_tokens", "n_frequent", "base", "model", "rare"],
            )
            rid += len(sizes)

    marked = common.id_and_text(plain).withColumn("held_out", common.fold_is(F.col("doc_id"), FOLDS, HELD_OUT))
    scored = common.staged(marked.mapInArrow(make, SCORED), "scored")
    rare = scored.select("rid", F.explode("rare").alias("x")).select("rid", "x.word", "x.n")
    found = (
        rare.join(counts.where(F.col("c") < least), "word", "left")
        .groupBy("rid")
        .agg(
            F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_log"),
            F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_rare"),
        )
    )
    norm = float(np.log10(total + 0.5 * (distinct + 1)))
    more = F.coalesce("rare_log", F.lit(0.0))
    return scored.drop("rare").join(found, "rid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * norm).alias("base_score"), (F.col("model") + more).alias("score"),
    )
