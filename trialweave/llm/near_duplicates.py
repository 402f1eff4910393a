"""Near-duplicates: banded MinHash finds candidates, odd sketches sift them, full shingle sets confirm them.

1. Every text gives its shingle set's digest (equal sets are one class), band keys of MinHash values and odd sketches.
   An odd sketch folds a MinHash sample - the set's smallest hash values: all of a short set, a power-of-two share of a
   long one - into a parity bitmap; the population count of the XOR of two bitmaps tells how much two sets differ.
2. Classes that share a band key meet in groups of bounded size; larger buckets meet as pairs of blocks. In a group, the
   sketches alone tell which pairs are surely similar, which may be and which are not. A spanning forest of the sure
   pairs and the unsure pairs between its trees, until these leave little doubt, go on first: far fewer than all pairs.
3. These edges are confirmed on the full sets, and components are found by contraction. Groups that kept unsure pairs
   back meet again: what stands between classes that no confirmed link joins goes on, in growing numbers, until a link
   is found or no pair is left. Each component gets its smallest doc_id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm import common

ROWS = 4  # MinHash values of a band
MISS = 1e-5  # of the pairs exactly at the limit, the share that no band may catch
BITS = 1024  # of an odd sketch
SAMPLE = 512  # hash values in a sketch, at most about
BLOCK = 1024  # classes that meet in one group, of each of its two blocks
CACHED = 500_000  # words whose hashes a worker keeps
DOUBT = math.log(1e-6)  # log of the chance up to which unsure pairs of two trees wait for the first ones to be confirmed
FURTHER = 64  # unsure pairs of two components that a group sends on in the second round
GROWTH = 16  # times as many in every round after it
HOT_KEYS = 1024  # keys with more than one in so many rows, of which there are fewer than that, are joined by a broadcast
BROADCAST_KEYS = 2_000_000  # keys of rows whose sets are needed, up to which they are broadcast

_workers: dict = {}
_RNG = np.random.default_rng(20240229)
_MULTIPLY = _RNG.integers(1, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHINGLE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands with which a pair exactly at the limit shares none with a chance of at most `miss`."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows))))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of fewer words, of the whole sequence; of none, nothing."""
    words = common.space_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    hashes = _workers.get("hashes")
    if hashes is None:
        hashes = _workers["hashes"] = WordHashes()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(k, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out += h[j : j + n] * _SHINGLE[j]
    return np.unique(_mix(out))


def min_hashes(shingles: np.ndarray, number: int) -> np.ndarray:
    out = np.full(number, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 8192):
        part = shingles[at : at + 8192]
        np.minimum(out, (part[None, :] * _MULTIPLY[:number, None]).min(1), out=out)
    return out


def band_keys(shingles: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    values = _mix(min_hashes(shingles, bands * rows)).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _SHINGLE[40]
    for j in range(rows):
        key = _mix(key + values[:, j] * _SHINGLE[48 + j])
    return key.view(np.int64)


def level_of(n: int) -> int:
    return max(0, math.ceil(math.log2(n / SAMPLE))) if n else 0


def odd_sketch(shingles: np.ndarray, level: int) -> tuple[bytes, int]:
    """Parity bitmap of the hash values below 2**(64 - level), and how many those are."""
    part = shingles[: int(np.searchsorted(shingles, np.uint64(1) << np.uint64(64 - level)))] if level else shingles
    bit = ((part * _SHINGLE[60]) >> np.uint64(54)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=BITS) & 1).astype(np.uint8)).tobytes(), len(part)


SIGNED = "rk long, doc_id long, n_shingles long, cls binary, bands array<long>, level int, s1 int, s2 int, sketch binary"


def signatures(docs: DataFrame, k: int, bands: int) -> DataFrame:
    """A row for each document; what has no words has no class. `rk` is a hash of the id and the text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            out: list[list] = [[] for _ in range(7)]
            for text in common.texts(batch):
                s = shingle_set(text, k)
                if not len(s):
                    row = (0, None, None, None, None, None, None)
                else:
                    level = level_of(len(s))
                    (a, na), (b, nb) = odd_sketch(s, level), odd_sketch(s, level + 1)
                    row = (len(s), hashlib.md5(s.tobytes()).digest(), band_keys(s, bands), level, na, nb, a + b)
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(0), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]],
                ["rk", "doc_id", "n_shingles", "cls", "bands", "level", "s1", "s2", "sketch"],
            )

    return keyed(docs).mapInArrow(make, SIGNED)


def keyed(docs: DataFrame) -> DataFrame:
    return common.id_and_text(docs).withColumn("rk", F.xxhash64("doc_id", "text"))


def _expected(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the XOR's population count for sketched sets that differ in d values."""
    x = d / BITS
    var = BITS / 4 * -np.expm1(-4 * x) - BITS * x * np.exp(-4 * x)
    return BITS / 2 * -np.expm1(-2 * x), np.sqrt(np.maximum(var, 0.0))


def limits(total: np.ndarray, sampled: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts up to which a pair is surely similar and beyond which it surely isn't, by the two samples' summed size.

    Sets of a Jaccard similarity t differ in (1 - t) / (1 + t) of their summed size. A whole set's count never exceeds
    that difference; a sample's difference varies, and five deviations of it are allowed for on either side.
    """
    q = (100 - percent) / (100 + percent)
    d = q * total
    spare = 5 * np.sqrt(d) + 2 if sampled else 0.0
    mean, dev = _expected(d + spare)
    high = mean + np.maximum(6 * dev, 2.0)
    if not sampled:
        high = np.minimum(high, d)
    mean, dev = _expected(np.maximum(d - spare, 0.0))
    return mean - np.maximum(6 * dev, 2.0), high + 1e-9


def _doubt(z: np.ndarray, total: np.ndarray, sampled: bool, percent: int) -> np.ndarray:
    """Log of the chance that a pair with this count is not similar. Each element that meets another's bit hides two.

    Samples of one set err together, so a pair of sampled sets never counts for much.
    """
    if sampled:
        return np.full(z.shape, -1.0, np.float32)
    hidden = np.floor(((100 - percent) / (100 + percent) * total - z) / 2) + 1
    rate = (z + 2 * hidden) ** 2 / (2 * BITS)
    fact = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, BITS)))))
    log = hidden * np.log(np.maximum(rate, 1e-9)) - fact[np.clip(hidden, 0, BITS - 1).astype(int)]
    return np.minimum(log, -0.2).astype(np.float32)


def _classify(level: np.ndarray, s1: np.ndarray, s2: np.ndarray, sketch: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of surely similar pairs and, below 0, of the doubt about pairs that may be similar. Sets whose levels differ by two never are."""
    n = len(level)
    sure, doubt = np.zeros((n, n), bool), np.zeros((n, n), np.float32)
    for top in np.unique(level).tolist():
        rows = np.flatnonzero((level == top) | (level == top - 1))
        own = level[rows] == top
        bits = np.where(own[:, None], sketch[rows, :128], sketch[rows, 128:])
        total = np.where(own, s1[rows], s2[rows]).astype(float)
        total = total[:, None] + total[None, :]
        if len(rows) <= 32:
            z = np.bitwise_count((bits[:, None, :] ^ bits[None, :, :]).view(np.uint64)).sum(2).astype(float)
        else:
            signs = np.unpackbits(bits, axis=1).astype(np.float32) * 2 - 1
            z = (BITS - signs @ signs.T) / 2
        lo, hi = limits(total, top > 0, percent)
        both = own[:, None] | own[None, :]
        at = np.ix_(rows, rows)
        sure[at] |= (z <= lo) & both
        x, y = np.nonzero((z > lo) & (z <= hi) & both)
        doubt[rows[x], rows[y]] = _doubt(z[x, y], total[x, y], top > 0, percent)
    np.fill_diagonal(sure, False)
    np.fill_diagonal(doubt, 0)
    return sure, doubt


def _trees(sure: np.ndarray, names: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Components of the sure pairs and a spanning forest that grows from the members with most of them."""
    n = len(sure)
    rank = np.empty(n, np.int64)
    rank[sorted(range(n), key=lambda j: (-int(sure[j].sum()), names[j]))] = np.arange(n)
    of, edges, number = np.full(n, -1), [], 0
    for root in np.argsort(rank).tolist():
        if of[root] >= 0:
            continue
        of[root] = number
        queue = [root]
        while queue:
            u = queue.pop(0)
            new = np.flatnonzero(sure[u] & (of < 0))
            of[new] = number
            new = new[np.argsort(rank[new])].tolist()
            edges += [(u, v) for v in new]
            queue += new
        number += 1
    return of, edges


class _Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x


def _unsure(doubt: np.ndarray, of: np.ndarray, union: _Union, degree: np.ndarray) -> tuple[list[tuple[int, int]], bool]:
    """Unsure pairs between trees to confirm first, least doubtful first, and whether others wait for what comes of them.

    Trees whose pairs leave little doubt count as one here, which tells what to confirm first and links nothing.
    """
    root = np.array([union.find(x) for x in range(len(union.parent))])[of]
    x, y = np.nonzero(np.triu(doubt < 0) & (root[:, None] != root[None, :]))
    order = np.lexsort((-np.maximum(degree[x], degree[y]), doubt[x, y]))
    left: dict[tuple[int, int], float] = {}
    edges, waiting = [], False
    for i, j, log in zip(x[order].tolist(), y[order].tolist(), doubt[x, y][order].tolist(), strict=True):
        a, b = union.find(int(of[i])), union.find(int(of[j]))
        if a == b:
            waiting = True
            continue
        edges.append((i, j))
        key = (min(a, b), max(a, b))
        left[key] = left.get(key, 0.0) + log
        if left[key] <= DOUBT:
            union.parent[a] = b
    return edges, waiting


def group_edges(names: list[bytes], blocks: np.ndarray, level, s1, s2, sketch, percent: int) -> tuple[list[tuple[int, int]], bool]:
    """Edges to confirm first among classes that met, and whether others wait: all of a block with itself, only those across of two blocks."""
    if len(names) < 2:
        return [], False
    sure, doubt = _classify(level, s1, s2, sketch, percent)
    degree = sure.sum(1)
    if blocks.min() == blocks.max():
        of, edges = _trees(sure, names)
        more, waiting = _unsure(doubt, of, _Union(int(of.max()) + 1), degree)
        return edges + more, waiting
    other = blocks[:, None] != blocks[None, :]
    of, _ = _trees(sure & ~other, names)
    union, edges = _Union(int(of.max()) + 1), []
    pairs = np.argwhere(np.triu(sure & other & (of[:, None] != of[None, :])))
    if len(pairs):
        _, first = np.unique(of[pairs], axis=0, return_index=True)
        for i, j in pairs[np.sort(first)].tolist():
            a, b = union.find(int(of[i])), union.find(int(of[j]))
            if a != b:
                union.parent[a] = b
                edges.append((i, j))
    more, waiting = _unsure(np.where(other, doubt, 0), of, union, degree)
    return edges + more, waiting


def further_edges(root: np.ndarray, blocks: np.ndarray, level, s1, s2, sketch, percent: int, most: int) -> tuple[np.ndarray, bool]:
    """The first `most` pairs of every two components that met, least doubtful first, and whether there are more."""
    sure, doubt = _classify(level, s1, s2, sketch, percent)
    degree = sure.sum(1)
    open_ = (sure | (doubt < 0)) & (root[:, None] != root[None, :])
    if blocks.min() != blocks.max():
        open_ &= blocks[:, None] != blocks[None, :]
    x, y = np.nonzero(np.triu(open_))
    if not len(x):
        return np.zeros((0, 2), np.int64), False
    key = np.minimum(root[x], root[y]) * len(root) + np.maximum(root[x], root[y])
    order = np.lexsort((-np.maximum(degree[x], degree[y]), np.where(sure[x, y], -np.inf, doubt[x, y]), key))
    x, y, key = x[order], y[order], key[order]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    place = np.arange(len(key)) - np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    return np.stack([x, y], 1)[place < most], bool((place >= most).any())


def by_share(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """`rows` with the columns of `table`, which has one row a key and in `n` how many of the rows bear it.

    Keys with more than one in HOT_KEYS of the rows are fewer than HOT_KEYS, whatever the input: their rows meet a
    broadcast of them where they lie. No key of the shuffle that is left for the others holds more than that share.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_KEYS > total
    hot = F.broadcast(table.where(is_hot).drop("n"))
    others = rows.join(hot.select(key), key, "left_anti").join(table.where(~is_hot).drop("n"), key, how)
    return rows.join(hot, key).unionByName(others)


def candidate_edges(classes: DataFrame, percent: int, waiting: DataFrame | None = None, roots: DataFrame | None = None, most: int = 0) -> DataFrame:
    """Distinct pairs (a, b) of classes to confirm, and rows of nulls with the group `g` that has more.

    With groups that wait, those alone: their first `most` pairs of every two components, as confirmed links made them.
    """
    member = classes.select("cls", F.explode("bands").alias("band"))
    h = F.xxhash64("cls")
    # buckets of the same members, as several bands give them, meet once
    buckets = member.groupBy("band").agg(F.count("*").alias("size"), F.bit_xor(h).alias("x"), F.min(h).alias("lo"), F.max(h).alias("hi")).where("size > 1")
    buckets = buckets.groupBy("size", "x", "lo", "hi").agg(F.min("band").alias("band")).select("band", "size", F.col("size").alias("n"))
    buckets = common.staged(buckets, "buckets")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    met = (
        by_share(member, buckets, "band", "inner")
        .select("cls", "band", blocks.alias("blocks"), F.pmod(h, blocks).cast("int").alias("block"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cls", "block", F.xxhash64("band", F.least("block", "other"), F.greatest("block", "other")).alias("g"))
    )
    again = waiting is not None
    if again:
        met = met.join(waiting, "g", "left_semi")
    if roots is not None:
        met = met.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
    else:
        met = met.withColumn("root", F.lit(None).cast("binary"))
    met = (
        met.withColumn("root", F.coalesce("root", "cls"))
        .join(classes.select("cls", "level", "s1", "s2", "sketch"), "cls")
        .repartition("g")
        .sortWithinPartitions("g")
    )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if rest is not None:
                rows = pa.concat_tables([rest, rows])
            g = rows.column("g").to_numpy()
            cuts = np.flatnonzero(g[1:] != g[:-1]) + 1
            if not len(cuts):
                rest = rows
                continue
            last = int(cuts[-1])
            yield of_groups(rows.slice(0, last), [0, *cuts[:-1].tolist(), last])
            rest = rows.slice(last)
        if rest is not None and rest.num_rows:
            yield of_groups(rest, [0, rest.num_rows])

    def of_groups(rows: pa.Table, cuts: list[int]) -> pa.RecordBatch:
        names = rows.column("cls").to_pylist()
        block, level, s1, s2 = (rows.column(c).to_numpy() for c in ("block", "level", "s1", "s2"))
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, 256)
        roots = np.unique(np.array(rows.column("root").to_pylist(), object), return_inverse=True)[1] if again else None
        g = rows.column("g").to_numpy()
        found, more = set(), []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if again:
                of = np.unique(roots[a:b], return_inverse=True)[1]
                pairs, cut = further_edges(of, block[a:b], level[a:b], s1[a:b], s2[a:b], sketch[a:b], percent, most)
                pairs = pairs.tolist()
            else:
                pairs, cut = group_edges(names[a:b], block[a:b], level[a:b], s1[a:b], s2[a:b], sketch[a:b], percent)
            for i, j in pairs:
                x, y = names[a + i], names[a + j]
                found.add((min(x, y), max(x, y)))
            if cut:
                more.append(int(g[a]))
        cols = list(zip(*sorted(found), strict=True)) or [(), ()]
        none = [None] * len(more)
        return pa.RecordBatch.from_arrays(
            [*[pa.array([*c, *none], pa.binary()) for c in cols], pa.array([None] * len(found) + more, pa.int64())], ["a", "b", "g"]
        )

    return met.mapInArrow(make, "a binary, b binary, g long").distinct()


def full_sets(docs: DataFrame, classes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """cls and the whole shingle set of every class in an edge, from one document of the class each."""
    wanted = edges.select(F.col("a").alias("cls")).union(edges.select(F.col("b").alias("cls"))).distinct()
    rks = classes.join(wanted, "cls", "left_semi").select("rk")
    if wanted.count() <= BROADCAST_KEYS:
        rks = F.broadcast(rks)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in common.sliced(batches):
            keys, sets = [], []
            for text in common.texts(batch):
                s = shingle_set(text, k)
                cls = hashlib.md5(s.tobytes()).digest()
                if len(s) and cls not in seen:
                    keys.append(cls)
                    sets.append(s.view(np.int64))
                    if len(seen) < CACHED:
                        seen.add(cls)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["cls", "shingles"])

    return keyed(docs).join(rks, "rk", "left_semi").mapInArrow(make, "cls binary, shingles array<long>").dropDuplicates(["cls"])


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges whose sets have a Jaccard similarity of at least percent / 100, in whole numbers."""
    a = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return edges.join(a, "a").join(b, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def components(edges: DataFrame) -> DataFrame | None:
    """node, root for every node of the edges; None without edges.

    Each round, every node goes to its smallest neighbour if that is smaller, and the edges are drawn anew between what
    is left. Node names are digests, so chains of falling names are short and the rounds few.
    """
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"), F.count("*").alias("n")).select("node", F.least("node", "near").alias("to"), "n")
        up = common.staged(up, "up")
        if labels is None:
            labels = up.select("node", F.col("to").alias("root"))
        else:
            sizes = labels.groupBy("root").agg(F.count("*").alias("n")).join(up.select(F.col("node").alias("root"), "to"), "root", "left")
            labels = by_share(labels, common.staged(sizes, "sizes"), "root").select("node", F.coalesce("to", "root").alias("root"))
            labels = common.staged(labels, "labels")
        ends = common.staged(by_share(edges, up.select(F.col("node").alias("a"), F.col("to").alias("x"), "n"), "a"), "ends")
        ends = by_share(ends, up.select(F.col("node").alias("b"), F.col("to").alias("y"), "n"), "b")
        edges = (
            ends.where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        edges = common.staged(edges, "edges")
    return labels


def linked(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame | None:
    """node, root of the components of all confirmed links; None without any.

    Only confirmed links join: in every round, groups that kept pairs back send on more of those between components.
    """
    got = common.staged(candidate_edges(classes, percent), "candidates")
    tried = got.where("a is not null").select("a", "b")
    sets = common.staged(full_sets(docs, classes, tried, k), "sets")
    links = common.staged(confirmed(tried, sets, percent), "links")
    roots, most = components(links), FURTHER
    waiting = got.where("g is not null").select("g")
    while not waiting.isEmpty():
        got = common.staged(candidate_edges(classes, percent, waiting, roots, most), "candidates")
        new = common.staged(got.where("a is not null").select("a", "b").join(tried, ["a", "b"], "left_anti"), "further")
        if not new.isEmpty():
            unread = classes.join(sets.select("cls"), "cls", "left_anti")
            sets = sets.union(common.staged(full_sets(docs, unread, new, k), "sets"))
            found = common.staged(confirmed(new, sets, percent), "links")
            tried = tried.union(new)
            if not found.isEmpty():
                links = links.union(found)
                roots = components(links)
        waiting, most = got.where("g is not null").select("g"), most * GROWTH
    return roots


def classified(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Signed rows, and each class with its component's smallest doc_id and its number of rows, `n`."""
    signed = common.staged(signatures(docs, k, bands_for(percent)), "signed")
    classes = common.staged(
        signed.where("cls is not null")
        .groupBy("cls")
        .agg(F.min("doc_id").alias("least_id"), F.min("rk").alias("rk"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("bands", "level", "s1", "s2", "sketch")]),
        "classes",
    )
    roots = linked(docs, classes, k, percent)
    named = classes.select("cls", "least_id", "n")
    if roots is None:
        return signed, named.select("cls", F.col("least_id").alias("component_id"), "n")
    rooted = named.select("cls", "least_id").join(roots.withColumnRenamed("node", "cls"), "cls")
    least = common.staged(rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n")), "least")
    many = by_share(rooted, least, "root").select("cls", "component_id")
    of = named.join(many, "cls", "left").select("cls", F.coalesce("component_id", "least_id").alias("component_id"), "n")
    return signed, common.staged(of, "components")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Texts without words, null ones among them, are linked with nothing and are their own component. Repeated rows and
    equal sets share a component. Null ids count for no minimum: a component of null ids alone has a null component_id,
    and its documents are kept; beside other ids a null id isn't kept. Other columns are ignored.
    """
    signed, of = classified(docs, k, percent)
    rows = signed.select("doc_id", "n_shingles", "cls")
    out = by_share(rows.where("cls is not null"), of, "cls").select("doc_id", "n_shingles", "component_id")
    alone = rows.where("cls is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which one stays for each component, whole rows in their own columns.

    The row with the component's smallest doc_id stays; of rows that share it, the one with the smallest row hash, and
    of equal rows one. Texts without words all stay.
    """
    signed, of = classified(docs, k, percent)
    roots = by_share(signed.where("cls is not null").select("cls", "doc_id", "rk"), of, "cls")
    best = roots.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("cls")).alias("of")).agg(
        F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).alias("d"), "rk")).alias("best")
    )
    keep = best.select(F.col("best.rk").alias("__rk"), F.lit(True).alias("__keep"))
    rows = signed.where("cls is not null").select(F.col("rk").alias("__rk"), F.lit(1).alias("__one"))
    gone = common.staged(
        rows.groupBy("__rk").agg(F.count("*").alias("__n")).join(keep, "__rk", "left").where("__keep is null or __n > 1"), "gone"
    )
    if gone.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    names = [f"`{c}`" for c in docs.columns]
    marked = docs.withColumn("__rk", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("binary"))).join(gone, "__rk", "left")
    single = marked.where("__n is null").select(*names)
    # rows that stand there several times and of which one stays: few, and equal in id and text
    several = marked.where("__keep and __n > 1").dropDuplicates(["__rk"]).select(*names)
    return single.unionByName(several)
