"""Personal data by bootstrapped contextual extraction.

Seed entities (e-mail, IP, card and phone numbers found by their form) and secrets of a written form induce lexical
patterns: what stands before a token, its shape, what stands behind. Spark counts the graph of patterns and the
instances that they pick out over all documents and scores both sides in turns; patterns of high confidence then find
identifiers that no seed form covers.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from trialweave.llm import common

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 20  # turns of scoring patterns from instances and instances from patterns, at most: they end once scores settle
SETTLED = 1e-3  # mean change of the patterns' confidence by a turn below which they have
LEAST_INSTANCES = 5  # distinct instances of a pattern
LEAST_CONFIDENCE = 0.6
BROADCAST_PATTERNS = 200_000  # patterns of less than 100 bytes up to which they are sent to all workers; beyond it they are joined
BROADCAST_CONTEXTS = 200_000  # contexts whose words without digits are gathered in one pass over the documents
BROADCAST_INSTANCES = 1_000_000  # scored instances, of 20 bytes, up to which they are broadcast
SHAPE_BYTES, CONTEXT_BYTES = 24, 32  # longer shapes and contexts are named by a digest
CACHED = 300_000  # words of which a worker remembers whether they are a context

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(rb"[0-9]")
_NOT_DIGITS = bytes(c for c in range(256) if not 48 <= c <= 57)

#: Seeds beside the four kinds: tokens whose own form tells that they are secrets.
_SECRET_SEED = re.compile(rb"AKIA[0-9A-Z]{12,}|[0-9a-f]{40}|[0-9A-F]{40}|(?:sk|ghp|xox[bp])[-_][0-9A-Za-z_-]{16,}|eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}")
_TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")
_KEY = re.compile(rb"[A-Za-z_][A-Za-z0-9_]*[=:]")
_PLACEHOLDERS = frozenset(k.upper().encode() for k in (*KINDS, "secret"))  # what redaction leaves after a key is no identifier
_AFTER_KEY = re.compile(rb"[=:][\x20\x09-\x0D]*+(?=[^\x20\x09-\x0D])")
_STRIP = b"\"'`.,;:!?()[]{}<>#%*$&|"


def emails(text: bytes) -> list[tuple[int, int]]:
    """Leftmost matches: each holds one "@", with all local characters before it that no earlier match has."""
    out, free, at = [], 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find(b"@", max(at + 1, free))
    return out


def digits(raw: bytes) -> bytes:
    return raw.translate(None, _NOT_DIGITS)


def luhn(number: bytes) -> bool:
    """Do the digits pass Luhn's check?"""
    total = 0
    for k, c in enumerate(reversed(number)):
        d = c - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes by kind as listed and then by place."""
    out = [("email", a, b) for a, b in emails(text)] if b"@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x.lstrip(b"0")) <= 3 and int(x.lstrip(b"0") or b"0") <= 255 for x in m[0].split(b".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(n := digits(m[0])) <= 19 and luhn(n):
            out.append(("card", *m.span()))
    if b"+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def _short(name: bytes, most: int) -> bytes:
    """The name, a long one by its beginning, a digest and its last byte: nothing that differs becomes equal."""
    return name if len(name) <= most else name[:6] + b"~" + hashlib.blake2b(name, digest_size=8).hexdigest().encode() + name[-1:]


def shape(token: bytes) -> bytes:
    """Runs of letters, digits and both as a, 9 and x; other characters stay. Long mixed runs are marked."""

    def run(m: re.Match) -> bytes:
        r = m[0]
        d = sum(48 <= c <= 57 for c in r)
        kind = b"9" if d == len(r) else b"x" if d else b"a"
        return kind + (b"+" if len(r) >= 12 else b"")

    return _short(re.sub(rb"[A-Za-z0-9\x80-\xff]+", run, token), SHAPE_BYTES)


class Contexts(dict):
    """Word to whether it is one of some contexts, remembered by the word as it stands; `begins` is true where the
    beginning of a text is a context, and without contexts given every word is one."""

    def __init__(self, contexts: frozenset[bytes] | None):
        self.contexts, self.begins = contexts, contexts is None or b"^" in contexts
        # few contexts are looked for as they are before a text is taken apart; long ones go by a digest
        self.sought = () if self.begins or len(contexts) > 64 or any(len(c) > SHAPE_BYTES - 4 for c in contexts) else tuple(contexts)

    def may_be_in(self, text: bytes) -> bool:
        if not self.sought:
            return self.begins or bool(self.contexts)
        low = text.lower()
        return any(c in low for c in self.sought)

    def __missing__(self, word: bytes) -> bool:
        if len(self) >= CACHED:
            self.clear()
        known = self[word] = self.contexts is None or _clean(word) in self.contexts
        return known


NO_CONTEXTS = Contexts(frozenset())


def candidates(text: bytes, contexts: Contexts = NO_CONTEXTS) -> Iterator[tuple[int, int, bytes, tuple[bytes, ...], bool]]:
    """Tokens with digits, seeds, what follows a key, and what follows a context: (start, end, instance, patterns, is it a
    candidate by its context alone).

    A key before "=" or ":" belongs to the context, as do quotes: `password="x1"` is the instance x1 after "password=".
    The patterns are the context on the left alone, with the shape, with the context on the right too, and for long
    tokens of letters and digits the shape alone.
    """
    places = [m.start() for m in _DIGIT.finditer(text)]
    if b"@" in text:
        places += [a for a, _ in emails(text)]
    if b"=" in text or b":" in text:
        places += [m.end() for m in _AFTER_KEY.finditer(text)]
    after: set[int] = set()
    if contexts.may_be_in(text):
        after = {k + 1 for k, known in enumerate(map(contexts.__getitem__, text.split())) if known}
        if contexts.begins:
            after.add(0)
    if not places and not after:
        return
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts = [a for a, _ in tokens]
    after.discard(len(tokens))
    for k in sorted({bisect_right(starts, p) - 1 for p in places} | after):
        a, b = tokens[k]
        raw = text[a:b]
        left = _clean(text[slice(*tokens[k - 1])]) if k else b"^"
        before = _clean(text[slice(*tokens[k - 2])]) if k > 1 else b"^"
        right = _clean(text[slice(*tokens[k + 1])]) if k + 1 < len(tokens) else b"$"
        key = _KEY.match(raw)
        keyed = True
        if key and key.end() < len(raw):
            left, a, raw = _short(key[0].lower(), CONTEXT_BYTES), a + key.end(), raw[key.end() :]
        elif left in (b"=", b":"):
            left = _short(before + left, CONTEXT_BYTES)
        else:
            keyed = left[-1:] in (b"=", b":")
        head = len(raw) - len(raw.lstrip(_STRIP))
        core = raw.strip(_STRIP)
        if not core:
            continue
        told = keyed or b"@" in core or bool(_DIGIT.search(core))
        if not told and k not in after:
            continue
        a += head
        if core in _PLACEHOLDERS and text[a - 1 : a] == b"<":
            continue
        s = shape(core)
        forms = [(left, b"*", b"*"), (left, s, b"*"), (left, s, right)] + [(b"*", s, b"*")] * (b"x+" in s)
        yield a, a + len(core), core, tuple(b"\x1f".join(x) for x in forms), not told


def _clean(token: bytes) -> bytes:
    return _short(token.strip(b"\"'`.,;!?()[]{}<>#%*$&|").lower() or token, CONTEXT_BYTES)


def _seed(a: int, b: int, core: bytes, spans: list[tuple[str, int, int]]) -> int:
    """The number of the kind of seed that the token belongs to, from 1; 0 for none."""
    for kind, s, e in spans:
        if a < e and s < b:
            return KINDS.index(kind) + 1
    return len(KINDS) + 1 if _SECRET_SEED.fullmatch(core) else 0


FOUND_KINDS = (*KINDS, "secret")


def pattern_instances(docs: DataFrame, contexts: frozenset[bytes] = frozenset()) -> DataFrame:
    """The graph's edges over all documents: pattern, instance (as a hash) and the kind of seed that it is, if one.

    With contexts, only those of the tokens that are candidates by one of these alone.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(contexts)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Contexts(shipped.value)
        for batch in common.sliced(batches):
            edges: dict[tuple[bytes, int], int] = {}
            for text in common.texts(batch):
                spans = None
                for a, b, core, patterns, alone in candidates(text, known):
                    if alone != bool(known.contexts):
                        continue
                    spans = base_spans(text) if spans is None else spans
                    seed = _seed(a, b, core, spans)
                    instance = int.from_bytes(hashlib.blake2b(core, digest_size=8).digest(), "little", signed=True)
                    for p in patterns:
                        edges[p, instance] = max(edges.get((p, instance), 0), seed)
            cols = list(zip(*edges, strict=True)) if edges else [(), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(list(edges.values()), pa.int32())],
                ["pattern", "instance", "seed"],
            )

    df = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(make, "pattern binary, instance long, seed int")
    return df.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))


def scored_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, kind, confidence: both sides of the graph scored in turns until the patterns above the thresholds
    stay and their confidences settle, seeds at 1 throughout.

    A pattern's confidence is the mean score of its instances for its best kind, with one unknown instance added; an
    instance takes the confidence of its best pattern. Patterns with too few instances leave the graph at once, instances
    without a score ("1", a year) never meet a pattern, and sides of joins that are known to be few are broadcast.
    """
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("instances")).where(F.col("instances") >= LEAST_INSTANCES)
    sizes = common.staged(sizes, "sizes")
    wanted = F.broadcast(sizes) if sizes.count() <= BROADCAST_INSTANCES else sizes
    useful = common.staged(edges.select("pattern", "instance").join(wanted, "pattern"), "useful")
    seeds = edges.groupBy("instance").agg(F.max("seed").alias("kind")).where("kind > 0").withColumn("score", F.lit(1.0))
    seeds = common.staged(seeds.join(useful.select("instance"), "instance", "left_semi"), "seeds")
    few = useful.count() <= BROADCAST_INSTANCES  # and so are the instances that have a score
    numbers = range(1, len(FOUND_KINDS) + 1)
    scores, before, patterns = seeds, None, None
    for _ in range(rounds):
        sums = [F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(f"s{k}") for k in numbers]
        by = useful.join(F.broadcast(scores) if few else scores, "instance").groupBy("pattern").agg(F.max("instances").alias("instances"), *sums)
        best = F.greatest(*[F.col(f"s{k}") for k in numbers])
        kind = F.coalesce(*[F.when(F.col(f"s{k}") == best, F.lit(k)) for k in numbers])
        found = by.select("pattern", kind.alias("kind"), (best / (F.col("instances") + 1)).alias("confidence"))
        patterns = common.staged(found.where(F.col("confidence") >= LEAST_CONFIDENCE), "scored")
        if rounds == 1:
            break
        state = patterns.agg(F.count("*"), F.coalesce(F.sum("confidence"), F.lit(0.0))).first()
        if before is not None and state[0] == before[0] and abs(state[1] - before[1]) <= SETTLED * state[0]:
            break
        before = state
        named = patterns.select("pattern", F.col("kind").alias("by_kind"), "confidence")
        reached = (
            useful.select("pattern", "instance")
            .join(F.broadcast(named) if state[0] <= BROADCAST_PATTERNS else named, "pattern")
            .groupBy("instance")
            .agg(F.max(F.struct("confidence", "by_kind")).alias("best"))
            .join(seeds.select("instance"), "instance", "left_anti")
            .select("instance", F.col("best.by_kind").alias("kind"), F.col("best.confidence").alias("score"))
        )
        scores = seeds.union(reached)
    return patterns


def _context(pattern: bytes) -> bytes | None:
    """The context on the left, if the pattern can match words without digits: its shape is none or tells of none."""
    left, form, _ = pattern.split(b"\x1f")
    return left if left != b"*" and (b"~" in form or not re.search(rb"[9x]", form)) else None


def _with_left(patterns: DataFrame) -> DataFrame:
    """pattern, kind and left, the context on the left where words without digits can follow it, else null."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_context(p) for p in batch.column(0).to_pylist()], pa.binary())], ["pattern", "kind", "left"])

    return patterns.select("pattern", "kind").mapInArrow(make, "pattern binary, kind int, left binary")


def learn_patterns(docs: DataFrame) -> tuple[DataFrame, list | None]:
    """pattern, kind, free: all patterns of high confidence, `free` ones also find words without digits; and their rows,
    unless they are too many to be sent to all workers.

    Tokens with digits, seeds and what follows a key come first. In the contexts that seeds induce, of patterns that words
    without digits can match, all such words are gathered as instances too; then all are scored in turns. A context that
    ordinary words mostly follow so falls.
    """
    edges = common.staged(pattern_instances(docs), "patterns")
    contexts = _with_left(scored_patterns(edges, 1)).where("left is not null").select("left").distinct()
    words = [bytes(r[0]) for r in contexts.limit(BROADCAST_CONTEXTS + 1).collect()]
    if not words:
        contexts = None
    elif len(words) <= BROADCAST_CONTEXTS:
        edges = edges.union(common.staged(pattern_instances(docs, frozenset(words)), "patterns"))
        contexts = docs.sparkSession.createDataFrame([(w,) for w in words], "left binary")
    else:
        contexts = common.staged(contexts, "contexts")
        blocks = -(-contexts.count() // BROADCAST_CONTEXTS) + 1
        for block in range(blocks):
            some = contexts.where(F.pmod(F.xxhash64("left"), F.lit(blocks)) == block)
            edges = edges.union(common.staged(pattern_instances(docs, frozenset(bytes(r[0]) for r in some.toLocalIterator())), "patterns"))
    scored = _with_left(scored_patterns(edges))
    if contexts is None:
        learned = scored.select("pattern", "kind", F.lit(False).alias("free"))
    else:
        learned = scored.join(contexts.withColumn("free", F.lit(True)), "left", "left").select("pattern", "kind", F.coalesce("free", F.lit(False)).alias("free"))
    rows = learned.limit(BROADCAST_PATTERNS + 1).collect()
    return (learned, rows) if len(rows) <= BROADCAST_PATTERNS else (common.staged(learned, "learned"), None)


class Learned(dict):
    """Pattern to kind, and the contexts in which words without digits count."""

    def __init__(self, rows: list):
        super().__init__((bytes(r["pattern"]), FOUND_KINDS[r["kind"] - 1]) for r in rows)
        self.free = frozenset(_context(bytes(r["pattern"])) for r in rows if r["free"])
        self.contexts = Contexts(self.free)

    def __reduce__(self):
        return _learned, (dict(self), self.free)


def _learned(kinds: dict[bytes, str], free: frozenset[bytes]) -> Learned:
    out = Learned([])
    out.update(kinds)
    out.free, out.contexts = free, Contexts(free)
    return out


def with_patterns(rows: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """The rows with `__patterns`, those of the learned patterns that stand in the row's text; equal texts are read once."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            every = Contexts(None)
            found = {(k, p) for k, t in zip(common.column(batch, "__key"), common.texts(batch), strict=True) for _, _, _, of, _ in candidates(t, every) for p in of}
            cols = list(zip(*sorted(found), strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())], ["__key", "pattern"])

    keyed = rows.withColumn("__key", F.xxhash64(text))
    stand = keyed.select("__key", F.col(text).alias("text")).mapInArrow(make, "__key long, pattern binary").distinct()
    own = stand.join(patterns, "pattern").groupBy("__key").agg(F.collect_list(F.struct("pattern", "kind", "free")).alias("__patterns"))
    return keyed.join(own, "__key", "left").drop("__key")


def found_spans(text: bytes, patterns: Learned) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and those that patterns add beside them, both in bytes."""
    base = base_spans(text)
    if not patterns:
        return base, []
    taken, more = sorted((s, e) for _, s, e in base), []
    for a, b, _, of, _ in candidates(text, patterns.contexts):
        kind = next((patterns[p] for p in reversed(of) if p in patterns), None)
        if kind and not any(a < e and s < b for s, e in taken):
            more.append((kind, a, b))
    return base, more


def _ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (FOUND_KINDS.index(s[0]), s[1], s[2]))


def _listed(text: bytes, spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end in code points."""
    if not spans:
        return ""
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return ",".join(f"{k}:{points[a]}:{points[b]}" for k, a, b in _ordered(spans))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document.

    A null text counts as empty: no spans, the digest of nothing. Repeated rows each give a row, and count once as
    instances; a null doc_id stays null. Spans that patterns add never overlap base spans. Other columns are ignored.
    """
    learned, few = learn_patterns(docs)
    joined = few is None
    shipped = docs.sparkSession.sparkContext.broadcast(Learned(few or []))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            out: list[list] = [[] for _ in range(7)]
            own = map(Learned, (x or [] for x in common.column(batch, "__patterns"))) if joined else repeat(shipped.value)
            for text, patterns in zip(common.texts(batch), own, strict=joined):
                base, more = found_spans(text, patterns)
                row = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                row += [hashlib.sha256(_listed(text, base).encode()).hexdigest(), _listed(text, base + more), len(more)]
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    rows = common.id_and_text(docs)
    return (with_patterns(rows, "text", learned) if joined else rows).mapInArrow(make, SCHEMA)


def redacted_once(text: bytes, patterns: Learned) -> bytes | None:
    """The text with a placeholder in the place of each run of overlapping spans; None where nothing is found."""
    base, more = found_spans(text, patterns)
    if not base and not more:
        return None
    out, last = [], 0
    for kind, a, b in sorted(base + more, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], b"<", kind.upper().encode(), b">"]
        last = max(last, b)
    return b"".join([*out, text[last:]])


def redacted_text(text: bytes, patterns: Learned) -> bytes:
    """The text redacted until nothing is found any more."""
    while (new := redacted_once(text, patterns)) is not None:
        text = new
    return text


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data in `text` replaced by placeholders; null texts and other columns stay."""
    learned, few = learn_patterns(docs)
    joined = few is None
    shipped = docs.sparkSession.sparkContext.broadcast(Learned(few or []))
    names = [f.name for f in docs.schema]
    inner = docs.select(*[F.col(f"`{n}`").cast("binary").alias(f"_{i}") if n == "text" else F.col(f"`{n}`").alias(f"_{i}") for i, n in enumerate(names)])
    at = names.index("text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = shipped.value
        for batch in common.sliced(batches):
            new = pa.array([None if t is None else redacted_text(t, patterns) for t in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            old, own = batch.column(at).to_pylist(), common.column(batch, "__patterns")
            new = [None if t is None else redacted_once(t, Learned(x or [])) for t, x in zip(old, own, strict=True)]
            texts = pa.array([t if n is None else n for t, n in zip(old, new, strict=True)], pa.binary())
            columns = [texts if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n is not None for n in new], pa.bool_())], [*batch.schema.names[: len(names)], "__open"])

    if joined:  # contexts change with every turn, so each joins anew what still changes
        done, left, schema = None, inner, inner.schema
        while True:
            turned = common.staged(with_patterns(left, f"_{at}", learned).mapInArrow(turn, StructType([*schema, StructField("__open", BooleanType())])), "redacted")
            same, left = turned.where("not __open").drop("__open"), turned.where("__open").drop("__open")
            done = same if done is None else done.union(same)
            if left.isEmpty():
                break
        out = done
    else:
        out = inner.mapInArrow(make, inner.schema)
    return out.select(*[F.col(f"_{i}").cast("string").alias(n) if n == "text" else F.col(f"_{i}").alias(n) for i, n in enumerate(names)])
