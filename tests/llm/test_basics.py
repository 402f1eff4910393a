import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from trialweave.llm import decontamination, packing, token_counts  # noqa: E402

DOCS = "doc_id long, text string, lang string, n_words string, kept string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " ", "\n\n", "one", "a  b\t c \n\nd ", "Ünïcode ＡＢＣ 12,5 don't", "x<|endoftext|>y <|endoftext|>", "word " * 5000]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, t, "en", "x", "y") for i, t in enumerate(ODD)]
    words = ["alpha", "Beta", "gamma", "delta", "eps", "zeta"]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))), None, None, None) for i in range(60)]
    rows += [rows[-1], (None, "null id here", None, None, None), (100, "same id other text", None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def brute_contamination(docs, items, window=10):
    grams = defaultdict(set)
    for item, text in items:
        w = WORD.findall(lower(text))
        if item is None or not w:
            continue
        n = min(window, len(w))
        for p in range(max(len(w) - window, 0) + 1):
            grams[tuple(w[p : p + n])].add(item)
    out = []
    for doc_id, text in docs:
        w = WORD.findall(lower(text))
        hit, of = set(), set()
        for n in {len(g) for g in grams}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in grams:
                    hit |= set(range(p, p + n))
                    of |= grams[tuple(w[p : p + n])]
        sha = hashlib.sha256(",".join(sorted(map(str, of))).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(of), sha, bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("window,block", [(10, 10**6), (3, 12), (4, 1)])
def test_contamination_equals_brute_force(spark, docs, window, block):
    text = docs.where("doc_id = 110").first().text
    items = [(1, text), (2, text), (3, "beta gamma"), (4, None), (5, ""), (6, " ".join(text.split()[2:15])), (None, "alpha"), (10, "Zeta zeta zeta")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.matches(docs, bench, window, block)
    whole = decontamination.contamination(docs, bench, window)
    want = brute_contamination([(r.doc_id, r.text) for r in docs.collect()], items, window)
    assert Counter(tuple(r) for r in whole.collect()) == want
    got = Counter((r.doc_id, r.n_words, sum(r.spans[1::2]) - sum(r.spans[::2]), len(r["items"])) for r in found.collect())
    assert got == Counter(x[:4] for x in want.elements())


def test_contamination_without_items_or_documents(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(docs, bench).where("contaminated").count() == 0
    assert decontamination.contamination(docs.limit(0), bench).count() == 0


def test_decontaminate_leaves_no_window(spark):
    item = " ".join(f"w{i}" for i in range(12))
    halves = " ".join(f"w{i}" for i in range(5)) + " " + item + " " + " ".join(f"w{i}" for i in range(5, 12))
    rows = [(1, f"Before. {'x y z ' * 20}{item.upper()}! after {'p q ' * 20}"), (2, item), (3, None), (4, f"{'k ' * 60}{halves}"), (5, "clean")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, cut string")
    got = {r.doc_id: r for r in decontamination.decontaminate(docs, bench).collect()}
    assert not got[1]["__dropped"] and got[2]["__dropped"] and got[3].text is None and got[5].text == "clean" and got[1].cut == "z"
    clean = spark.createDataFrame([(i, r.text) for i, r in got.items()], "doc_id long, text string")
    assert decontamination.contamination(clean, bench).where("contaminated").count() == 0
    assert got[1].text.startswith("Before. x y z") and "after p q" in got[1].text


@pytest.mark.parametrize("block", [10**6, 12, 1])
def test_decontaminate_over_several_blocks(spark, block):
    inner, outer = [f"a{i}" for i in range(12)], [f"b{i}" for i in range(12)]
    nested = " ".join([*outer[:6], *inner, *outer[6:]])
    rows = [(1, f"{'p q ' * 40}{nested} {'r s ' * 40}"), (2, f"{'k ' * 60}{' '.join(outer[:5])} {nested} {' '.join(outer[5:])}"), (3, None), (4, "clean words"), (5, nested), (1, "clean too"), (6, "")]
    bench = spark.createDataFrame([(1, " ".join(inner)), (2, " ".join(outer)), (3, "only three words")], "item_id long, text string")
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], "doc_id long, text string, cut string, words string, `__coverage` string, digest string")
    got = decontamination.purified(docs, bench, block_words=block)
    assert got.columns == docs.columns
    left = {(r.doc_id, r.text) for r in got.select("doc_id", "text").collect()}
    assert {(3, None), (4, "clean words"), (1, "clean too"), (6, "")} <= left and 5 not in {i for i, _ in left}
    assert len(left) == 6 and decontamination.contamination(got, bench).where("contaminated").count() == 0
    assert all(t.split() == ["p", "q"] * 40 + ["r", "s"] * 40 for i, t in left if i == 1 and t != "clean too")


def test_packing_is_whole_and_gapless(spark, docs):
    path = P.path("word_bpe_49k.json")
    rows = packing.pack(docs, path, capacity=64).collect()
    tok = Tokenizer.from_file(path)
    want = Counter()
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 64):
            part = ids[at : at + 64]
            want[r.doc_id, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)), len(ids)] += 1
    assert Counter(tuple(r[:5]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(docs.limit(0), path).count() == 0


def test_shortest_pack_first_places_each_piece():
    rng = random.Random(3)
    for _ in range(50):
        counts = {rng.randrange(1, 33): rng.randrange(1, 40) for _ in range(rng.randrange(1, 12))}
        patterns = packing.shortest_pack_first(dict(counts), 32)
        placed = Counter()
        for n, lengths in patterns:
            assert n > 0 and sum(lengths) <= 32
            for x in lengths:
                placed[x] += n
        assert placed == Counter(counts)
        ranks = defaultdict(list)
        for length, rank, number, _, _ in packing.places(patterns):
            ranks[length] += range(rank, rank + number)
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in counts.items()}


def test_token_counts_equal_the_library(spark, docs):
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want = Counter()
    for r in docs.collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        want[r.doc_id, len((r.text or "").encode()), n, n > 1024] += 1
    assert Counter(tuple(r) for r in token_counts.token_counts(docs, path).collect()) == want
    assert token_counts.token_counts(docs.limit(0), path).count() == 0


def test_pre_tokens_never_change_a_count():
    lengths = token_counts.Lengths(P.path("byte_bpe_50k.json"), (b"", np.array([])))
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choice(["a", "Bc", " ", "  ", "\n", "\t", "é", "12", "'s", " ", "<|endoftext|>", "."]) for _ in range(rng.randrange(12)))
        assert lengths.of(text) == lengths.count(text), repr(text)


def test_odd_white_space_never_changes_a_count():
    path = P.path("byte_bpe_50k.json")
    lengths = token_counts.Lengths(path, (b"", np.array([])))
    rng = random.Random(7)
    bits = ["a", "Bc", " ", "  ", "\n", "\t", "é", "12", "'s", "\u00a0", "<|endoftext|>", ".", "\x1c", "\x85", "\u2009", "\u200b", "x" * 120, "\r\n", "\u3000"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(1500)]
    assert [lengths.of(t) for t in texts] == [lengths.count(t) for t in texts]
    assert any(len(token_counts.all_pieces(t)) > 3 for t in texts)


def test_the_broadcast_table_comes_from_all_documents(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "WARM_DOCS", 40)
    path = P.path("byte_bpe_50k.json")
    rows = [(i, f"common word{i % 3}  and\ttabs " * (2000 if i % 50 == 0 else 2)) for i in range(400)]
    blob, sizes = token_counts.frequent_lengths(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), path)
    words = blob.decode().split("\n")
    tok = Tokenizer.from_file(path)
    assert {" word0", " word1", " word2", " and"} <= set(words) and len(words) == len(sizes)
    assert [len(tok.encode(w, add_special_tokens=False).ids) for w in words] == sizes.tolist()


def test_the_broadcast_table_counts_every_document(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "WARM_DOCS", 40)
    rows = [(i, f"head pair{i // 2} tens{i // 10}" + " fifties" * (i % 50 == 7)) for i in range(400)] + [(None, "last  pair0"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    path = P.path("byte_bpe_50k.json")
    want = Counter(x for _, t in rows if t is not None for x in token_counts.all_pieces(t))
    assert set(token_counts.frequent_lengths(docs, path)[0].decode().split("\n")) == {x for x, n in want.items() if n > 1}
    monkeypatch.setattr(token_counts, "FREQUENT", 30)
    got = token_counts.frequent_lengths(docs, path)[0].decode().split("\n")
    assert got == sorted(want, key=lambda x: (-want[x], x))[:30]


def test_word_ids_equal_the_library():
    words = packing.WordIds(P.path("word_bpe_49k.json"))
    rng = random.Random(6)
    bits = ["a", "Bc", " ", "  ", "\n", "\t", "\u00e9", "\u00c9", "e\u0301", "12", "'s", "'", "\u00a0", "<|endoftext|>", ".", "!!", "\u00df", "\u0130", "\x1d", "%%%"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(800)]
    for at in range(0, 800, 50):
        some = texts[at : at + 50]
        assert words.of_all([t.encode() for t in some]) == [words.encoded(t) for t in some]
