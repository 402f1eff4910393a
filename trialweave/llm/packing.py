"""Sequence packing: shortest-pack-first over the histogram of piece lengths.

Documents become pieces of at most the capacity. Lengths are placed longest first, each into the pack that is shortest
so far, as whole counts: the plan depends on the histogram alone, never on the number of documents. Every (length, rank)
then has a place in the plan, and a join on them gives each piece its sequence and offset.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm import common, token_counts

CAPACITY = 2048
END_ID = 1
GROUP_ROWS = 50_000  # pieces ranked together in one group; a common length is split over many groups
CACHED = 700_000  # words that a worker keeps
PLAN_ROWS = 200_000  # plan rows up to which the plan is broadcast

_workers: dict = {}

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordIds(dict):
    """A white-space separated word, A-Z lower-cased, to its ids as little-endian 32-bit numbers.

    The tokenizer lower-cases, drops white space, never joins across it and cuts between letters and punctuation, so
    words are encoded apart, without the punctuation at their ends, and many at a time.
    """

    def __init__(self, path: str):
        self.tokenizer = token_counts.load(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)  # does the id end a word?
        self.last[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(_PUNCTUATION)
        if core and core != word and core[-1].lower()[-1].isalpha():
            ids = self[core] + self[word[len(core) :]]
        else:
            ids = self.encoded(word)
        self[word] = ids
        return ids

    def learn(self, words: set[str]) -> None:
        """Encodes words of letters together: each ends with an id that ends a word."""
        if len(self) + len(words) > CACHED:
            self.clear()
        cores = sorted({c for c in (w.rstrip(_PUNCTUATION) for w in words) if c.isalpha() and c not in self})
        parts = [cores[at : at + 100] for at in range(0, len(cores), 100)]
        encoded = self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)
        for some, got in zip(parts, encoded, strict=True):
            ids = np.array(got.ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
                self.update((w, raw[a:b]) for w, a, b in zip(some, cuts, cuts[1:]))

    def of_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole texts. What could be a special token, or white space to Python alone, is encoded as it stands."""
        plain = [None if b"<|" in t or any(c in t for c in _SEPARATORS) else t.lower().decode("utf-8", "replace").split() for t in texts]
        found = [None if w is None else list(map(self.get, w)) for w in plain]
        gaps = [[] if w is None else _gaps(got) for w, got in zip(plain, found, strict=True)]
        missing = {w[k] for w, at in zip(plain, gaps, strict=True) for k in at}
        if missing:
            self.learn(missing)
        out = []
        for text, w, got, at in zip(texts, plain, found, gaps, strict=True):
            if w is None:
                out.append(self.encoded(text.decode("utf-8", "replace")))
                continue
            for k in at:
                got[k] = self[w[k]]
            out.append(b"".join(got))
        return out


def _gaps(items: list) -> list[int]:
    """Places of None, by the list's own search."""
    out: list[int] = []
    try:
        at = -1
        while True:
            at = items.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out


_PUNCTUATION = ".,;:!?)]}*#$%&\""
_SEPARATORS = (b"\x1c", b"\x1d", b"\x1e", b"\x1f")


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document: its ids and the end id, cut after every `capacity` ids."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _workers.get(tokenizer_path)
        if words is None:
            words = _workers[tokenizer_path] = WordIds(tokenizer_path)
        for batch in common.sliced(batches, 256):
            rows: list[tuple] = []
            for doc_id, ids in zip(common.column(batch, "doc_id"), words.of_all(common.texts(batch)), strict=True):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    part = ids[4 * at : 4 * (at + capacity)]
                    rows.append((doc_id, at, len(part) // 4, zlib.crc32(part), n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5,
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return common.id_and_text(docs).mapInArrow(make, PIECES)


def shortest_pack_first(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Packing patterns as (number of packs, lengths in order) from the number of pieces of each length."""
    open_packs: dict[int, list[list]] = {}  # used length to patterns [number, lengths]
    used: list[int] = []  # heap of the used lengths

    def put(at: int, number: int, lengths: list[int]) -> None:
        if at not in open_packs:
            open_packs[at] = []
            heapq.heappush(used, at)
        open_packs[at].append([number, lengths])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not used or used[0] + length > capacity:
                fit = capacity // length
                for number, times in ((left // fit, fit), (1, left % fit)):
                    if number and times:
                        put(times * length, number, [length] * times)
                break
            stack = open_packs[used[0]]
            pattern = stack[-1]
            take = min(left, pattern[0])
            left -= take
            pattern[0] -= take
            if not pattern[0]:
                stack.pop()
                if not stack:
                    del open_packs[heapq.heappop(used)]
            put(sum(pattern[1]) + length, take, [*pattern[1], length])
    return [(number, lengths) for at in sorted(open_packs) for number, lengths in open_packs[at]]


def places(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """Plan rows (length, first rank, ranks, first sequence, offset): a rank range of a length fills one slot of a pattern."""
    next_rank: dict[int, int] = {}
    rows, first = [], 0
    for number, lengths in patterns:
        offset = 0
        for length in lengths:
            rank = next_rank.get(length, 0)
            rows.append((length, rank, number, first, offset))
            next_rank[length] = rank + number
            offset += length
        first += number
    return rows


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece with its sequence_id and offset there.

    A null or empty text is a document of the end id alone. Repeated rows are packed as often as they occur; a null
    doc_id stays null. Ties of length are broken by id, start and checksum. An empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = common.staged(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = places(shortest_pack_first(histogram, capacity))
    plan_df = spark.createDataFrame(
        plan or [(0, 0, 0, 0, 0)], "p_length long, p_rank long, p_ranks long, p_sequence long, p_offset long"
    )
    groups = spark.createDataFrame(
        [(k, max(1, -(-n // GROUP_ROWS))) for k, n in histogram.items()] or [(0, 1)], "g_length long, g_groups long"
    )
    grouped = (
        cut.join(F.broadcast(groups), F.col("length") == F.col("g_length"))
        .withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("g_groups")))
        .drop("g_length", "g_groups")
    )
    sizes = grouped.groupBy("length", "g").count()
    before = sizes.select(
        F.col("length").alias("b_length"),
        F.col("g").alias("b_g"),
        (F.sum("count").over(Window.partitionBy("length").orderBy("g")) - F.col("count")).alias("b_before"),
    )
    within = Window.partitionBy("length", "g").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (
        grouped.withColumn("r", F.row_number().over(within) - 1)
        .join(before, (F.col("length") == F.col("b_length")) & (F.col("g") == F.col("b_g")))
        .withColumn("r", F.col("r") + F.col("b_before"))
    )
    if len(plan) <= PLAN_ROWS:
        plan_df = F.broadcast(plan_df)
    rank = F.col("r") - F.col("p_rank")
    return ranked.join(
        plan_df, (F.col("length") == F.col("p_length")) & (rank >= 0) & (rank < F.col("p_ranks"))
    ).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("p_sequence") + rank).alias("sequence_id"), F.col("p_offset").alias("offset")
    )
