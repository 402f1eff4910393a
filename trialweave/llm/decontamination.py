"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Training words stream through the automaton, which keeps the longest match that ends at each word. A match of at least
the window's length, or one that contains a whole shorter item, marks its words. Runs of words that no item has are
skipped beforehand, so the automaton only sees stretches long enough to hold a window.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm import common

WINDOW = 10
BLOCK_WORDS = 100_000  # words of items in one automaton, and so in one broadcast; more items make more passes
BROADCAST_NUMBERS = 2_000_000  # numbers in the hits of several blocks, up to which these are broadcast

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_workers: dict = {}


class Automaton:
    """Generalised suffix automaton of word sequences, with the windows that each of its states ends."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.short: dict[int, tuple[int, set[int]]] = {}  # state of a whole short item to its length and items
        self.windows: dict[int, set[int]] = {}  # state that holds a window to the window's items
        self.least = min((min(len(w), window) for _, w in items if w), default=window)
        coded = [(i, [self.words.setdefault(w, len(self.words) + 1) for w in words]) for i, words in items if words]
        for _, ids in coded:
            last = 0
            for x in ids:
                last = self._extend(last, x)
        for item, ids in coded:
            state = 0
            for n, x in enumerate(ids, 1):
                state = self.next[state][x]
                if n >= window:
                    self.windows.setdefault(self._holding(state), set()).add(item)
            if len(ids) < window:
                self.short.setdefault(state, (len(ids), set()))[1].add(item)
        self.shorter = [self._short_of(s) for s in range(len(self.next))] if self.short else []

    def _extend(self, last: int, x: int) -> int:
        if x in self.next[last]:
            q = self.next[last][x]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, x)
        new = self._state({}, self.length[last] + 1)
        p = last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][x]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, x)
        return new

    def _state(self, after: dict[int, int], length: int) -> int:
        self.next.append(after)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, x: int) -> int:
        copy = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = copy
            p = self.link[p]
        return copy

    def _holding(self, state: int) -> int:
        """The state that holds the suffix of window length of a longer match in `state`."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _short_of(self, state: int) -> list[int]:
        """States of whole short items that end wherever `state` does, longest first."""
        found = []
        while state > 0:
            if state in self.short:
                found.append(state)
            state = self.link[state]
        return found

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of hit words, disjoint and in order, and the items with a window among them."""
        if len(words) < self.least:
            return [], set()
        ids = np.fromiter(map(self.words.get, words, repeat(0)), np.int64, len(words))
        gaps = np.concatenate(([-1], np.flatnonzero(ids == 0), [len(ids)]))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for k in np.flatnonzero(np.diff(gaps) > self.least).tolist():
            self._stream(ids, int(gaps[k]) + 1, int(gaps[k + 1]), spans, items)
        return spans, items

    def _stream(self, ids: np.ndarray, start: int, end: int, spans: list[tuple[int, int]], items: set[int]) -> None:
        following, link, lengths, window, shorter = self.next, self.link, self.length, self.window, self.shorter
        state = size = 0
        for at, x in enumerate(ids[start:end].tolist(), start + 1):
            to = following[state].get(x)
            while to is None and state:
                state = link[state]
                size = lengths[state]
                to = following[state].get(x)
            if to is None:
                continue
            state, size = to, size + 1
            hit = 0
            if size >= window:
                hit = window
                items |= self.windows[self._holding(state)]
            if shorter:
                for s in shorter[state]:
                    n, of = self.short[s]
                    if n <= size:
                        hit = max(hit, n)
                        items |= of
            if hit:
                first = at - hit
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, at))


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items as (item_id, words) in blocks of bounded size, streamed through the driver. Null ids are left out."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).where(F.col("item_id").isNotNull())
    for item, text in rows.toLocalIterator():
        words = common.plain_words(bytes(text or b""))
        if words:
            block.append((item, words))
            size += len(words)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def _automaton(block: list[tuple[int, list[bytes]]], window: int) -> Automaton:
    """The worker's automaton of a block, built once for all its tasks."""
    if _workers.get("block") is not block or _workers["automaton"].window != window:
        _workers.update(block=block, automaton=Automaton(block, window))
    return _workers["automaton"]


def _several(benchmark: DataFrame, block_words: int) -> tuple[list[tuple[int, list[bytes]]], bool]:
    """The first block of items, and whether there are more."""
    blocks = item_blocks(benchmark, block_words)
    return next(blocks, []), next(blocks, None) is not None


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Flat, disjoint and ordered spans from any."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


FOUND = "spans array<long>, items array<long>"


def block_hits(texts: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> DataFrame:
    """digest, spans and items of every text (text, digest) that holds a window of any block.

    The blocks take their turns over all texts: one automaton, one broadcast and one worker for a core at a time. Only
    texts that are hit leave a row.
    """
    out = None
    for block in item_blocks(benchmark, block_words):
        shipped = texts.sparkSession.sparkContext.broadcast(block)

        def make(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shipped.value, window)
            for batch in common.sliced(batches):
                rows = {}
                for text, key in zip(common.texts(batch), common.column(batch, "digest"), strict=True):
                    spans, items = automaton.match(common.plain_words(text))
                    if spans:
                        rows[key] = ([x for s in spans for x in s], sorted(items))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(rows), pa.binary()), *[pa.array([r[k] for r in rows.values()], pa.list_(pa.int64())) for k in (0, 1)]],
                    ["digest", "spans", "items"],
                )

        part = common.staged(texts.select("text", "digest").mapInArrow(make, f"digest binary, {FOUND}").dropDuplicates(["digest"]), "hits")
        shipped.unpersist()
        out = part if out is None else out.union(part)
    lists = lambda c: F.flatten(F.collect_list(c)).alias(c)
    return common.staged(out.groupBy("digest").agg(lists("spans"), lists("items")), "hits")


def _with_hits(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows (with a digest) and what the blocks found in their texts; few hits are broadcast, by their summed size."""
    size = hits.agg(F.coalesce(F.sum(F.size("spans") + F.size("items") + 4), F.lit(0))).first()[0]
    return rows.join(F.broadcast(hits) if size <= BROADCAST_NUMBERS else hits, "digest", "left")


def _flat(spans: list[int] | None) -> list[int]:
    return merged(list(zip(spans[::2], spans[1::2], strict=True))) if spans else []


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text (as bytes), n_words, spans of hit words (flat: start, end, ...) and the items that hit.

    Null texts have no words; repeated rows each give a row; an item without words has no window. Items beyond
    `block_words` take further passes, each with its own automaton, so no broadcast exceeds that bound by more than one
    item; their hits, keyed by a digest of the text, are then joined to the rows.
    """
    rows = common.id_and_text(docs)
    block, several = _several(benchmark, block_words)
    if several:
        keyed = rows.withColumn("digest", F.unhex(F.md5("text")))
        rows = _with_hits(keyed, block_hits(keyed.where("text is not null"), benchmark, window, block_words)).select("doc_id", "text", "spans", "items")
    shipped = docs.sparkSession.sparkContext.broadcast([] if several else block)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = None if several else _automaton(shipped.value, window)
        for batch in common.sliced(batches):
            words = [common.plain_words(t) for t in common.texts(batch)]
            if several:
                spans = [_flat(s) for s in common.column(batch, "spans")]
                items = [sorted(set(x or ())) for x in common.column(batch, "items")]
            else:
                got = [automaton.match(w) for w in words]
                spans, items = [[x for s in a for x in s] for a, _ in got], [sorted(b) for _, b in got]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int64()),
                    pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.int64())),
                ],
                ["doc_id", "text", "n_words", "spans", "items"],
            )

    return rows.mapInArrow(make, f"doc_id long, text binary, n_words long, {FOUND}")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, items = common.column(batch, "spans"), common.column(batch, "items")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.names.index("doc_id")), batch.column(batch.schema.names.index("n_words")),
                    pa.array([sum(s[1::2]) - sum(s[::2]) for s in spans], pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in items], pa.string()),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"],
            )

    found = matches(docs, benchmark, window).select("doc_id", "n_words", "spans", "items")
    out = found.mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def cut_spans(text: bytes, spans: list[int]) -> bytes:
    """The text without the words of the spans and what stands between them; a line break takes their place."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out += [text[last : at[a][0]], b"\n"]
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def _cut(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> tuple[DataFrame, list[str]]:
    """Columns _0, _1, ... of the documents, the text among them as bytes without any window, and `cut` and `words`: how
    many words went and how many there were.

    Cutting can join two halves of an item, of whatever block, so all spans of all blocks are cut and what was cut is
    looked at again until nothing is left. Rows that nothing was cut from are done.
    """
    names = docs.columns
    at = names.index("text")
    rows = docs.select(
        *[(F.col(f"`{n}`").cast("binary") if i == at else F.col(f"`{n}`")).alias(f"_{i}") for i, n in enumerate(names)],
        F.lit(0).cast("long").alias("cut"), F.lit(None).cast("long").alias("words"),
    )
    own = rows.columns
    block, several = _several(benchmark, block_words)
    shipped = docs.sparkSession.sparkContext.broadcast([] if several else block)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = None if several else _automaton(shipped.value, window)
        for batch in common.sliced(batches):
            fresh, cuts, sizes = [], [], []
            found = common.column(batch, "spans") if several else [None] * batch.num_rows
            for text, cut, had, spans in zip(*(common.column(batch, c) for c in (f"_{at}", "cut", "words")), found, strict=True):
                words = common.plain_words(text or b"")
                sizes.append(len(words) if had is None else had)
                spans = _flat(spans) if several else [x for s in automaton.match(words)[0] for x in s]
                while spans:
                    cut += sum(spans[1::2]) - sum(spans[::2])
                    text = cut_spans(text, spans)
                    spans = [] if several else [x for s in automaton.match(common.plain_words(text))[0] for x in s]
                fresh.append(text)
                cuts.append(cut)
            new = {f"_{at}": pa.array(fresh, pa.binary()), "cut": pa.array(cuts, pa.int64()), "words": pa.array(sizes, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else common.own(batch, n) for n in own], own)

    if not several:
        return rows.mapInArrow(make, rows.schema), names
    done, left = None, rows
    while True:
        keyed = left.withColumn("digest", F.unhex(F.md5(f"_{at}")))
        texts = keyed.where(F.col(f"_{at}").isNotNull()).select(F.col(f"_{at}").alias("text"), "digest")
        hit = _with_hits(keyed, block_hits(texts, benchmark, window, block_words)).drop("digest", "items")
        same = hit.where("spans is null").mapInArrow(make, rows.schema)
        done = same if done is None else done.union(same)
        left = common.staged(hit.where("spans is not null").mapInArrow(make, rows.schema), "cut")
        if left.isEmpty():
            return done, names


def _named(names: list[str]) -> list[F.Column]:
    return [(F.col(f"_{i}").cast("string") if n == "text" else F.col(f"_{i}")).alias(n) for i, n in enumerate(names)]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The documents' columns with texts without test items, and `__coverage` and `__dropped`.

    Spans of at least the window (or of a whole shorter item) are cut; a document with more than `max_coverage` of its
    words hit is marked to be dropped. Documents must not have columns of these two names; `purified` adds none.
    """
    rows, names = _cut(docs, benchmark, window, block_words)
    return rows.select(*_named(names), coverage().alias("__coverage")).withColumn("__dropped", F.col("__coverage") > max_coverage)


def purified(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The documents' own columns, whatever their names, without test items in the texts and without documents that
    consist of them for more than `max_coverage` of their words: what the pipeline uses."""
    rows, names = _cut(docs, benchmark, window, block_words)
    return rows.where(coverage() <= max_coverage).select(*_named(names))


def coverage() -> F.Column:
    return F.col("cut") / F.greatest(F.col("words"), F.lit(1))
