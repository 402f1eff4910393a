"""Language identification with a linear-chain conditional random field over words.

Hashed affixes, character n-grams and lexicon words give each word a score for each language, learned transitions tie
neighbours together, and forward-backward gives every word its probabilities; a text's language is the one that most of
its words' letters speak for. Code-switched texts so keep a label for each word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm import common

SAMPLE_DOCS = 2_400  # documents, at most, from which the field is learned
SAMPLE_CHUNKS = 4_000  # stretches of words of those documents, at most, drawn evenly over their lengths
CHUNK = 128  # words of a stretch: forward-backward runs over stretches, side by side, and what one ends with enters the next
PIECE = 24  # characters of the pieces that a longer run of letters is labelled in, as scripts without blanks have them
BUCKETS = 1 << 15  # weights of hashed features
LEXICON = 4_000  # words that have a feature of their own
CACHED = 400_000  # words whose scores a worker keeps
FOLDS, HELD_OUT = 4, 2

_LETTER = re.compile(r"[^\W\d_]")
_workers: dict = {}


def lower_words(text: bytes) -> list[bytes]:
    """The words of a text; a run of more than PIECE characters as consecutive pieces, none left out."""
    words = common.plain_words(text)
    if max(map(len, words), default=0) <= PIECE:
        return words
    out = []
    for w in words:
        if len(w) <= PIECE:
            out.append(w)
        else:
            chars = w.decode("utf-8", "replace")
            out += [chars[k : k + PIECE].encode() for k in range(0, len(chars), PIECE)]
    return out


@dataclass
class Field:
    """Languages, weights of hashed features by language, start and transition scores."""

    langs: list[str]
    lexicon: dict[bytes, int]
    weights: np.ndarray  # BUCKETS + lexicon + 1 by languages
    start: np.ndarray
    move: np.ndarray

    def features(self, word: bytes) -> list[int]:
        w = b"^" + word + b"$"
        grams = {w[k : k + n] for n in (2, 3) for k in range(len(w) - n + 1)}
        grams |= {b"p" + w[:4], b"p" + w[:5], b"s" + w[-4:], b"s" + w[-5:]}
        out = [zlib.crc32(g) % BUCKETS for g in grams]
        known = self.lexicon.get(word)
        return [*out, BUCKETS + known] if known is not None else out


def forward_backward(
    emit: np.ndarray, mask: np.ndarray, start: np.ndarray, move: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (sequences, words, labels), summed transition expectations and log normalisers.

    emit are scores, mask marks the words that there are; each sequence's words stand at its beginning. A sequence that is
    a stretch of a longer one has in `enter` what comes into its first word in place of exp(start), and in `leave` what
    the words behind it say of its last.
    """
    n, steps, k = emit.shape
    top = emit.max(2, keepdims=True)
    e = np.exp(emit - top)
    m = np.exp(move)
    alpha = np.zeros_like(e)
    scale = np.ones((n, steps), e.dtype)
    a = (np.exp(start) if enter is None else enter.astype(e.dtype)) * e[:, 0]
    scale[:, 0] = a.sum(1)
    alpha[:, 0] = a / scale[:, :1]
    for t in range(1, steps):
        a = (alpha[:, t - 1] @ m) * e[:, t]
        s = a.sum(1)
        on = mask[:, t]
        scale[:, t] = np.where(on, s, 1)
        alpha[:, t] = np.where(on[:, None], a / np.where(s > 0, s, 1)[:, None], alpha[:, t - 1])
    beta = np.ones((n, k), e.dtype) if leave is None else leave.astype(e.dtype)
    marginal = np.zeros_like(e)
    marginal[:, steps - 1] = alpha[:, steps - 1] * beta
    pairs = np.zeros((k, k))
    for t in range(steps - 1, 0, -1):
        on = mask[:, t]
        inner = e[:, t] * beta / scale[:, t : t + 1]
        if leave is None and on.any():
            pairs += (alpha[:, t - 1] * on[:, None]).T @ inner * m
        beta = np.where(on[:, None], inner @ m.T, beta)
        marginal[:, t - 1] = alpha[:, t - 1] * beta
    marginal /= np.maximum(marginal.sum(2, keepdims=True), 1e-30)
    log_z = (np.log(scale) * mask).sum(1) + (top[:, :, 0] * mask).sum(1)
    return marginal * mask[:, :, None], pairs, log_z


def transfers(emit: np.ndarray, mask: np.ndarray, move: np.ndarray) -> np.ndarray:
    """(sequences, labels, labels): what each sequence makes of a weight that comes into its first word's label, by the
    label of its last word; rescaled, as only proportions matter."""
    n, steps, k = emit.shape
    e = np.exp(emit - emit.max(2, keepdims=True))
    m = np.exp(move)
    out = np.eye(k, dtype=e.dtype)[None] * e[:, 0][:, None, :]
    for t in range(1, steps):
        new = (out.reshape(n * k, k) @ m).reshape(n, k, k) * e[:, t][:, None, :]
        new /= np.maximum(new.max((1, 2), keepdims=True), 1e-30)
        out = np.where(mask[:, t][:, None, None], new, out)
    return out


def carried(steps: list[np.ndarray], last: list[bool], start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """enter and leave of consecutive stretches by their transfers; `last` marks the stretches that end a text."""
    m = np.exp(move.astype(np.float64))
    k = len(m)
    enter, leave = np.empty((len(steps), k)), np.ones((len(steps), k))
    come = np.exp(start.astype(np.float64))
    for j, t in enumerate(steps):
        enter[j] = come
        go = come @ t
        come = np.exp(start.astype(np.float64)) if last[j] else (go / max(go.sum(), 1e-300)) @ m
    for j in range(len(steps) - 2, -1, -1):
        if not last[j]:
            back = m @ (steps[j + 1] @ leave[j + 1])
            leave[j] = back / max(back.sum(), 1e-300)
    return enter, leave


def learn_field(rows: list[tuple[bytes, str]], epochs: int = 4, batch: int = 64, rate: float = 0.08, seed: int = 5) -> Field | None:
    """Fits the field to texts with one label each: gradient steps (Adam) on the log-likelihood of the words' labels.

    After the first half of the epochs, words that the field itself gives another language with certainty keep no label
    of their text: switched stretches stop counting against the language that they are in.
    """
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    number = {x: k for k, x in enumerate(langs)}
    chunks = []
    for text, lang in rows:
        words = lower_words(text)
        chunks += [(words[k : k + CHUNK], number[lang]) for k in range(0, len(words), CHUNK)]
    rng = np.random.default_rng(seed)
    if len(chunks) > SAMPLE_CHUNKS:
        chunks = [chunks[k] for k in np.sort(rng.choice(len(chunks), SAMPLE_CHUNKS, replace=False))]
    counts = Counter(w for words, _ in chunks for w in words)
    lexicon = {w: k for k, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON])}
    k = len(langs)
    model = Field(langs, lexicon, np.zeros((BUCKETS + len(lexicon) + 1, k), np.float32), np.zeros(k, np.float32), np.zeros((k, k), np.float32))
    if k == 1 or not chunks:
        return model
    vocab = {w: j for j, w in enumerate(counts)}
    lists = [model.features(w) for w in counts]
    width = max(map(len, lists))
    pad = BUCKETS + len(lexicon)
    table = np.full((len(lists) + 1, width), pad, np.int64)
    for j, x in enumerate(lists):
        table[j, : len(x)] = x
    ids = np.full((len(chunks), CHUNK), len(lists), np.int64)
    for j, (words, _) in enumerate(chunks):
        ids[j, : len(words)] = [vocab[w] for w in words]
    labels = np.array([y for _, y in chunks])
    state = {n: [np.zeros_like(getattr(model, n)), np.zeros_like(getattr(model, n))] for n in ("weights", "start", "move")}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(chunks))
        for at in range(0, len(order), batch):
            rows_ = order[at : at + batch]
            w = ids[rows_]
            mask = w < len(lists)
            used, where = np.unique(w, return_inverse=True)
            scores = model.weights[table[used]].sum(1)
            emit = scores[where.reshape(w.shape)]
            got, pairs, _ = forward_backward(emit, mask, model.start, model.move)
            want = np.zeros_like(got)
            want[np.arange(len(rows_)), :, labels[rows_]] = 1
            want *= mask[:, :, None]
            if 2 * epoch >= epochs:
                own = got[np.arange(len(rows_)), :, labels[rows_]]
                other = mask & (own < 0.02)
                want[other] = got[other]
            diff = (want - got).reshape(-1, k)
            by_word = np.stack([np.bincount(where.ravel(), diff[:, j], len(used)) for j in range(k)], 1)
            flat = table[used].ravel()
            grad = np.stack([np.bincount(flat, np.repeat(by_word[:, j], width), len(model.weights)) for j in range(k)], 1)
            grad[pad] = 0
            hop = np.einsum("sti,stj->ij", want[:, :-1] * mask[:, 1:, None], want[:, 1:])
            step += 1
            for name, g in (("weights", grad), ("start", want[:, 0].sum(0) - got[:, 0].sum(0)), ("move", hop - pairs)):
                p = getattr(model, name)
                g = g / batch - 1e-4 * p
                m, v = state[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    np.clip(model.move, -6, 6, out=model.move)
    return model


@dataclass
class Labeller:
    """A worker's copy of the field with the scores of words seen so far."""

    model: Field
    known: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self):
        self.table = np.zeros((1024, len(self.model.langs)), np.float32)

    def ids(self, words: list[bytes]) -> np.ndarray:
        ids = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(ids < 0)
        if len(missing):
            fresh = [w for w in {words[j] for j in missing.tolist()} if w not in self.known]
            need = len(self.known) + len(fresh)
            while need > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            lists = [self.model.features(w) for w in fresh]
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter((x for f in lists for x in f), np.int64, int(lengths.sum()))
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            first = len(self.known)
            self.table[first:need] = np.add.reduceat(self.model.weights[flat], starts, axis=0)
            self.known.update(zip(fresh, range(first, need), strict=True))
            ids[missing] = [self.known[words[j]] for j in missing.tolist()]
        return ids

    def labelled(self, docs: list[list[bytes]], at_once: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """The probabilities of all words of all documents, one after the other, and the number of each word's document.

        Texts are cut into stretches that run side by side; the transfer of each stretch tells what enters the next one, so
        the chain runs over whole texts, however long.
        """
        k = len(self.model.langs)
        if len(self.known) > CACHED:
            self.known.clear()
        words = [w for d in docs for w in d]
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        out = np.zeros((len(words), k), np.float32)
        if not words:
            return out, np.zeros(0, np.int64)
        ids = self.ids(words)
        start, move = self.model.start, self.model.move
        of = np.repeat(np.arange(len(docs)), -(-sizes // CHUNK))
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        first = np.concatenate([np.arange(b, b + s, CHUNK) for b, s in zip(begins.tolist(), sizes.tolist(), strict=True)])
        length = np.minimum(CHUNK, (begins + sizes)[of] - first)
        last = np.append(of[1:] != of[:-1], True)
        part = np.flatnonzero(~last | np.append(False, ~last[:-1]))  # stretches of texts of several
        enter = np.broadcast_to(np.exp(start.astype(np.float64)), (len(first), k)).copy()
        leave = np.ones((len(first), k))

        def spots(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            mask = np.arange(int(length[rows].max())) < length[rows][:, None]
            return np.where(mask, first[rows][:, None] + np.arange(mask.shape[1]), 0), mask

        if len(part):
            steps = np.empty((len(part), k, k))
            order = np.argsort(length[part], kind="stable")
            for a in range(0, len(order), at_once):
                rows = order[a : a + at_once]
                spot, mask = spots(part[rows])
                steps[rows] = transfers(self.table[ids[spot]], mask, move)
            enter[part], leave[part] = carried(list(steps), last[part].tolist(), start, move)
        order = np.argsort(length, kind="stable")
        for a in range(0, len(order), at_once):
            rows = order[a : a + at_once]
            spot, mask = spots(rows)
            got, _, _ = forward_backward(self.table[ids[spot]], mask, start, move, enter[rows], leave[rows])
            out[spot[mask]] = got[mask]
        return out, np.repeat(np.arange(len(docs)), sizes)

    def marginals(self, docs: list[list[bytes]]) -> np.ndarray:
        """For each document, the sum of its words' language probabilities, each word weighed by its length."""
        got, of = self.labelled(docs)
        weight = np.fromiter((min(len(w), 12) for d in docs for w in d), np.float64, len(got))
        return np.stack([np.bincount(of, got[:, j] * weight, len(docs)) for j in range(got.shape[1])], 1)


def learn(docs: DataFrame, rows: int = SAMPLE_DOCS) -> Field | None:
    """From at most `rows` labelled documents outside the held-out fold, taken in the order of a hash of their ids."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~common.fold_is(F.col("doc_id"), FOLDS, HELD_OUT))
    ids = usable.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    plain = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"))
    return learn_field([(bytes(r.text), r.lang) for r in common.bounded_texts(plain, ids, rows)])


def languages(docs: DataFrame, rows: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and the share of the second language as `second` and `second_share`.

    A null text, or one without a letter, is "und" with score 0, as is everything where no row has a language. A null
    doc_id is never held out and never learned from; repeated rows each give a row. lang, source and doc_id are no
    inputs of a prediction; other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(learn(docs, rows))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        labeller = _workers.get("labeller")
        if labeller is None or labeller.model is not model:
            labeller = _workers["labeller"] = Labeller(model) if model is not None else None
        for batch in common.sliced(batches):
            raw = common.texts(batch)
            fine = [model is not None and bool(_LETTER.search(t.decode("utf-8", "replace"))) for t in raw]
            sums = labeller.marginals([lower_words(t) if ok else [] for t, ok in zip(raw, fine, strict=True)]) if model is not None else np.zeros((len(raw), 1))
            share = sums / np.maximum(sums.sum(1, keepdims=True), 1e-9)
            best = np.argsort(-share, axis=1, kind="stable")
            names = model.langs if model is not None else ["und"]
            each = range(len(raw))
            second = best[:, 1] if best.shape[1] > 1 else best[:, 0]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([names[best[j, 0]] if fine[j] else "und" for j in each]),
                    pa.array([min(1.0, float(share[j, best[j, 0]])) if fine[j] else 0.0 for j in each]),
                    pa.array([names[second[j]] if fine[j] and share.shape[1] > 1 else None for j in each], pa.string()),
                    pa.array([float(share[j, second[j]]) if fine[j] and share.shape[1] > 1 else 0.0 for j in each]),
                ],
                ["doc_id", "lang_pred", "score", "second", "second_share"],
            )

    out = common.id_and_text(docs).mapInArrow(make, "doc_id long, lang_pred string, score double, second string, second_share double")
    return out.withColumn("held_out", common.fold_is(F.col("doc_id"), FOLDS, HELD_OUT))
