"""Quality rules: an ordered decision list learned by sequential covering from labelled statistics.

Statistics come from whole texts. On a bounded labelled sample, each rule for "reject" is grown condition by condition on
two thirds of the rows and pruned on the rest; the accepted rules become one ordered Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from trialweave.llm import common

SAMPLE_ROWS = 12_000  # labelled documents, at most, from which the rules are learned
REPEAT_WINDOW = 8
LOCAL = 64  # words of the stretches whose distinct words are counted, so that the rate does not fall with the length
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "distinct_rate", "bang_rate", "bar_rate", "digit_rate")
FEATURES = ("n_words", *RATIOS)

_SYMBOLS = b"#*$%&|<>"
_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
_MIX = np.array([pow(6364136223846793005, k + 1, 1 << 64) | 1 for k in range(64)], dtype=np.uint64)


def _left(text: bytes, drop: bytes) -> int:
    return len(text) - len(text.translate(None, drop))


def repeat_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words inside windows that the text holds at least twice, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    keys = np.zeros(n, np.uint64)
    for k in range(window):
        keys += hashes[k : k + n] * _MIX[k]
    order = np.sort(keys)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    # equal windows have equal keys; what has equal keys is compared word by word
    places = np.flatnonzero(np.isin(keys, again))
    groups: dict[tuple, list[int]] = {}
    for p in places.tolist():
        groups.setdefault(tuple(words[p : p + window]), []).append(p)
    hit = np.zeros(len(words) + 1, np.int64)
    for found in groups.values():
        if len(found) > 1:
            np.add.at(hit, found, 1)
            np.add.at(hit, np.array(found) + window, -1)
    return int((np.cumsum(hit) > 0).sum())


def text_statistics(text: bytes) -> tuple:
    """COUNTS and then RATIOS of a text."""
    words = text.split()
    n, size = len(words), max(len(text), 1)
    chars = len(text.translate(None, common.SPACES + common.CONTINUATION))
    symbols = _left(text, _SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    some = max(n, 1)
    return (
        n, chars, symbols, dup, repeats,
        chars / some, symbols / some, dup / max(len(lines), 1), repeats / some,
        _left(text, _UPPER) / max(_left(text, _LETTERS), 1),
        sum(len(set(words[k : k + LOCAL])) for k in range(0, n, LOCAL)) / some,
        text.count(b"!") / some, text.count(b"|") / some, _left(text, b"0123456789") / size,
    )


def statistics(df: DataFrame, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """`keep`, COUNTS and RATIOS of each row's text; null counts as empty. `keep` must be a long column."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            rows = [text_statistics(t) for t in common.texts(batch)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * (len(COUNTS) + len(RATIOS))
            kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(RATIOS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [keep, *COUNTS, *RATIOS]
            )

    schema = f"{keep} long, {', '.join(f'{c} long' for c in COUNTS)}, {', '.join(f'{c} double' for c in RATIOS)}"
    return df.select(F.col(keep).cast("long").alias(keep), F.col(text).cast("binary").alias("text")).mapInArrow(make, schema)


@dataclass
class Rule:
    """All conditions (feature, is it "at most", threshold) together mean reject."""

    conditions: list[tuple[str, bool, float]] = field(default_factory=list)

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, at_most, t in self.conditions:
            out &= (x[name] <= t) if at_most else (x[name] > t)
        return out

    def column(self) -> F.Column:
        out = F.lit(True)
        for name, at_most, t in self.conditions:
            out = out & ((F.col(name) <= F.lit(t)) if at_most else (F.col(name) > F.lit(t)))
        return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 4, cuts: int = 48) -> Rule:
    """Adds the condition of the largest FOIL gain until no good row is covered."""
    rule, inside = Rule(), np.ones(len(bad), bool)
    while len(rule.conditions) < most and (~bad[inside]).any():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        if not p0:
            break
        best = (1e-9, None)
        for name, values in x.items():
            v, y = values[inside], bad[inside]
            grid = np.unique(np.quantile(v, np.linspace(0, 1, cuts)))
            for t in (grid[1:] + grid[:-1]) / 2:
                low = v <= t
                for at_most, side in ((True, low), (False, ~low)):
                    p, n = y[side].sum(), (~y[side]).sum()
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0]:
                            best = (gain, (name, at_most, float(t)))
        if best[1] is None:
            break
        rule.conditions.append(best[1])
        inside = rule.covers(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drops last conditions while that doesn't lessen (p - n) / (p + n) on rows that the rule wasn't grown on."""

    def worth(r: Rule) -> float:
        c = r.covers(x)
        p, n = bad[c].sum(), (~bad[c]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule.conditions) - 1, 0, -1):
        shorter = Rule(rule.conditions[:k])
        if worth(shorter) >= worth(best):
            best = shorter
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.97, least: int = 3, most: int = 24) -> list[Rule]:
    """Sequential covering: rules in order, each accepted if it is precise on the rows held back, which it was not grown on."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    fold = np.arange(len(bad)) % 3
    while len(rules) < most:
        grow, hold = left & (fold != 2), left & (fold == 2)
        if bad[grow].sum() < least:
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow])
        if not rule.conditions:
            break
        if hold.any():
            rule = _prune(rule, {k: v[hold] for k, v in x.items()}, bad[hold])
        c = rule.covers(x) & left
        unseen = c & hold
        if bad[c].sum() < least or not unseen.any() or bad[unseen].mean() < precision:
            break
        rules.append(rule)
        left &= ~c
    return rules


def rejected(rules: list[Rule]) -> F.Column:
    """The ordered list as one conditional expression: the first rule that covers a row decides."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(rule.column(), F.lit(k)) if out is None else out.when(rule.column(), F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def learn_rules(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from at most `rows` labelled documents, taken in the order of a hash of their ids."""
    sample = common.labelled_sample(labels, "quality", rows)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(sample.select("doc_id")), "doc_id", "left_semi"
    )
    found = statistics(chosen).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", *COUNTS, *RATIOS).limit(2 * rows)
    got = found.toPandas().merge(sample.toPandas(), on="doc_id").sort_values(["doc_id", *COUNTS], kind="stable").reset_index(drop=True)
    got = got.sample(frac=1.0, random_state=7).reset_index(drop=True)
    return learn({k: got[k].to_numpy(float) for k in FEATURES}, got["label"].to_numpy() == 0) if len(got) else []


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judged(df: DataFrame, rules: list[Rule], text: str = "text", keep: str = "doc_id") -> DataFrame:
    """Statistics, base_failed, rule (number of the deciding rule, 0 for none) and kept of each row."""
    out = statistics(df, text, keep).withColumn("base_failed", base_failed()).withColumn("rule", rejected(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept of every document.

    A null text has no words and so fails the base rule. Repeated rows each give a row and the same verdict; a null
    doc_id stays null. Without usable labels the base rule decides alone. Other columns are ignored.
    """
    return judged(docs, learn_rules(docs, labels, rows)).select("doc_id", *COUNTS, "base_failed", "kept", "rule")


def keep(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that are kept, whole rows in their own columns: no join, no shuffle.

    Statistics are made as the rows stream by, in columns beside them; the ordered conditional expression of the rules
    then decides. Null texts fail the base rule.
    """
    names = docs.columns
    at = names.index("text")
    inner = docs.select(*[(F.col(f"`{n}`").cast("binary") if i == at else F.col(f"`{n}`")).alias(f"_{i}") for i, n in enumerate(names)])
    kinds = [*[(c, pa.int64(), LongType()) for c in COUNTS], *[(c, pa.float64(), DoubleType()) for c in RATIOS]]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            rows = [text_statistics(t) for t in common.texts(batch, f"_{at}")]
            made = [pa.array([r[j] for r in rows], k) for j, (_, k, _) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *[c for c, _, _ in kinds]])

    schema = StructType([*inner.schema, *[StructField(c, k) for c, _, k in kinds]])
    out = inner.mapInArrow(make, schema).where(~base_failed() & (rejected(rules) == 0))
    return out.select(*[(F.col(f"_{i}").cast("string") if i == at else F.col(f"_{i}")).alias(n) for i, n in enumerate(names)])
