"""Token counts by a two-tier lookup on the map side.

The first tier is a broadcast table of frequent pre-tokens and their token counts, the second a cache in each Python
worker that the tokenizer itself fills. Pre-tokens are shuffled for the counts behind that table alone, once for each
task; the lookup shuffles none, and both tiers are bounded.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm import common

FREQUENT = 50_000  # pre-tokens in the broadcast table
WARM_DOCS = 4_000  # documents, at most, that a task counts before it hands their pre-tokens on; all documents are counted
CACHED = 300_000  # pre-tokens that a worker keeps before it starts again from the broadcast table
LONG = 100  # characters of a pre-token from which on it is encoded anew each time

# White space as the tokenizer's own expression knows it.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]")

_workers: dict = {}


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pre_tokens(text: str) -> list[str] | None:
    """Pieces at whose edges a byte-level tokenizer always cuts, without the line breaks between them.

    None where white space is anything but single blanks and line breaks between words: `all_pieces` cuts such a text.
    """
    if text.replace("\n", " ").split(" ") != text.split():
        return None
    return text.replace(" ", "\n ").split("\n")


def all_pieces(text: str) -> list[str]:
    """Pieces of any text: words with the blank before them, and of runs of white space all but the last character, which
    is a piece of its own where it is no blank before a word."""
    return _PIECE.findall(text)


class Lengths(dict):
    """Pre-token to token count; what is missing is encoded once."""

    def __init__(self, path: str, frequent: tuple[bytes, np.ndarray]):
        self.tokenizer, self.frequent = load(path), frequent
        self.special = [str(t) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.restart()
        self.line_break = self.count("\n")

    def restart(self) -> None:
        self.clear()
        blob, lengths = self.frequent
        if len(lengths):
            self.update(zip(blob.decode().split("\n"), lengths.tolist(), strict=True))

    def count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, piece: str) -> int:
        n = self.count(piece)
        if len(piece) < LONG:
            if len(self) >= CACHED:
                self.restart()
            self[piece] = n
        return n

    def of(self, text: str) -> int:
        if not text:
            return 0
        pieces = pre_tokens(text)
        if pieces is not None:
            return sum(map(self.__getitem__, pieces)) + text.count("\n") * self.line_break
        if any(x in text for x in self.special):  # a special token ends runs of white space before it
            return self.count(text)
        return sum(map(self.__getitem__, all_pieces(text)))


def frequent_lengths(docs: DataFrame, path: str) -> tuple[bytes, np.ndarray]:
    """The table to broadcast: the commonest pre-tokens of all documents, joined, and their token counts.

    Executors count the pre-tokens of every document and encode those that are kept.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, WARM_DOCS):
            seen: Counter = Counter()
            for raw in common.texts(batch):
                text = raw.decode("utf-8", "replace")
                seen.update(pre_tokens(text) or all_pieces(text))
            kept = [x for x in seen if len(x) < LONG and "\n" not in x]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([seen[x] for x in kept], pa.int64())], ["piece", "n"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            got = tokenizer.encode_batch(batch.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.ids) for x in got], pa.int64())], ["piece", "length"])

    texts = docs.where("text is not null").select(F.col("text").cast("binary").alias("text"))
    counted = texts.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    top = counted.where("n > 1").orderBy(F.desc("n"), "piece").limit(FREQUENT).select("piece").mapInArrow(encode, "piece string, length long").toArrow()
    return "\n".join(top.column("piece").to_pylist()).encode(), top.column("length").to_numpy().astype(np.uint32)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document.

    A null text counts as empty: no bytes, no tokens. Repeated rows each give a row; a null doc_id stays null. Strings
    of special tokens inside texts become those tokens, as the tokenizer does by default. Other columns are ignored.
    """
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_lengths(docs, tokenizer_path))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _workers.get(tokenizer_path)
        if lengths is None or lengths.frequent is not frequent.value:
            lengths = _workers[tokenizer_path] = Lengths(tokenizer_path, frequent.value)
        for batch in common.sliced(batches):
            raw = common.texts(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(b) for b in raw], pa.int64()),
                    pa.array([lengths.of(b.decode("utf-8", "replace")) for b in raw], pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    counted = common.id_and_text(docs).mapInArrow(make, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
