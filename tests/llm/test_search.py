"""Resampling, lexical search and top-k search against plain versions, and on edge rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from cohortspark.llm import bitslices, lexical, resampling
from helpers import LONG, ROWS, edge_docs, empty_docs

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def low(text):
    return (text or "").translate(_LOWER)


# ------------------------------------------------------------------ importance resampling

def plain_draw(docs, target, size, buckets, percent, least, seed):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        w = word.findall(low(text))
        return w, [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, size + 1) for i in range(len(w) - n + 1)]
    own = [(k, *features(t)) for k, t in docs]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, _, f in own:
        np.add.at(s, f, 1)
    for text in target:
        np.add.at(t, features(text)[1], 1)
    gain = np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(int)
    rows = []
    for k, w, f in own:
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = int(gain[f].sum()) if f else 0
        rows.append([k, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    rank = {id(r): i + 1 for i, r in enumerate(order[:len(order) * percent // 100])}
    return sorted((str(r[0]), r[2], r[3], r[4], rank.get(id(r)) or 0) for r in rows)


@pytest.mark.parametrize("size", [1, 3])
def test_draw_equals_a_plain_one(spark, size):
    r = random.Random(size)
    words = ["Über", "naïve", "x" * 70, "y" * 65, "a1", "THE", "the", "of", "你好", "don", "t", "é", "7", *(f"w{i}" for i in range(40))]
    texts = [r.choice([" ", "-", "\x00", "\n\n", ". "]).join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(300)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(400, None), (401, ""), (402, " .,!"), (5, texts[5]), (None, texts[7])]
    target = [" ".join(r.choice(words[:12]) for _ in range(30)) for _ in range(20)] + [None, ""]
    d = spark.createDataFrame([(*x, 1, "z") for x in docs], "doc_id long, text string, weight int, rank string").repartition(5)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.importance_draw(d, t, size=size, buckets=97, percent=30, least_words=10, seed=3).collect()
    got = sorted((str(x["doc_id"]), x["n_features"], x["weight"], x["score"], x["rank"] or 0) for x in got)
    want = plain_draw(docs, target, size, 97, 30, 10, 3)
    # a repeated row is twice the same row, so either of the two may hold a place
    assert got == want


def test_draw_edges(spark):
    assert resampling.importance_draw(empty_docs(spark), edge_docs(spark)).collect() == []
    rows = resampling.importance_draw(edge_docs(spark), empty_docs(spark), percent=100, least_words=1).collect()
    assert len(rows) == len(ROWS)
    by = {x["doc_id"]: x for x in rows}
    assert all(by[k]["n_features"] == 0 and by[k]["weight"] == 0 and by[k]["rank"] is None for k in (2, 3, 4))
    assert sorted(x["rank"] for x in rows if x["rank"]) == list(range(1, len(ROWS) - 2)) and by[8]["n_features"] == 80000


# ------------------------------------------------------------------ lexical search

def plain_search(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    own = [(i, term.findall(low(t))) for i, t in docs if i is not None]
    n, total = sum(bool(w) for _, w in own), sum(len(w) for _, w in own)
    df = {}
    for _, w in own:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item in sorted({i for i, _ in items if i is not None}):
        terms = [t for i, x in items if i == item for t in term.findall(low(x))]
        scored = []
        for i, w in own:
            m = 100 - 75 + (75 * len(w) * n) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 8 * m)) for t in terms if t in w)
            if s > 0:
                scored.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("window", [7, 512])
def test_search_equals_a_plain_one(spark, monkeypatch, window):
    r = random.Random(window)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "你好", "X"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(r.choices(vocabulary, weights, k=r.randint(0, 80)))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, docs[3][1]), (503, docs[3][1]), (None, "w1 w2"), (3, docs[3][1])]
    items = [(i, " ".join(r.choices(vocabulary, weights, k=r.randint(1, 12)))) for i in range(30)] + [(40, None), (41, "zzz"), (1, "w5 w5 X"), (None, "w1")]
    monkeypatch.setattr(lexical.best_documents, "__defaults__", (window,))
    monkeypatch.setattr(lexical, "BLOCK", 16)
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, score int").repartition(3)
    q = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, doc_id string")
    got = sorted(tuple(x) for x in lexical.ranked_search(d, q, 6).collect())
    assert got == plain_search(docs, items, 6)


def test_blocks_are_rejected_before_unpacking():
    """A list of a weak term keeps most blocks packed: their maxima cannot lift a candidate over the tenth score."""
    import pyarrow as pa
    rng = np.random.default_rng(5)
    n = 20000
    texts = [("rare " * (3 if i < 40 else 1) if i % 50 == 0 or i < 40 else "") + ("often " if rng.random() < 0.6 else "") + "pad " * int(rng.integers(1, 9)) for i in range(n)]
    raw = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    words, counts = lexical.terms_of(np.frombuffer(raw, np.uint8), offsets)
    total = int(counts.sum())
    rows = pa.Table.from_batches(lexical.shard_rows(0, np.arange(n), [words], counts, n, total)).to_pandas()
    lists = rows[rows["term"].isin(["rare", "often"])].reset_index(drop=True)
    here = lexical.Lists(lists, counts, n, total)
    weight = np.array([3000 if t == "rare" else 40 for t in lists["term"]])
    doc, score = lexical.best_documents(here, np.arange(2), weight, n, 10)
    full = np.zeros(n, np.int64)
    fresh = lexical.Lists(lists, counts, n, total)
    for i in range(2):
        for b in range(len(fresh.last[i])):
            d, parts = fresh.block(i, b)
            full[d] += weight[i] * parts
    best = np.lexsort((np.arange(n), -full))[:10]
    assert (doc == best).all() and (score == full[best]).all()
    often = int(np.flatnonzero(lists["term"] == "often")[0])
    assert sum(i == often for i, _ in here.opened) < 0.2 * len(here.last[often])


def test_packed_numbers_round_trip():
    v = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**31])
    raw, ends = lexical.packed(v)
    assert (lexical.unpacked(raw) == v).all() and ends[-1] == len(raw) and list(np.diff(ends, prepend=0)) == [1, 1, 1, 2, 2, 3, 3, 4, 5, 5]


def test_search_edges(spark):
    items = spark.createDataFrame([(1, "lazy dog"), (2, None), (3, "你好 word5")], "item_id long, text string")
    assert lexical.ranked_search(empty_docs(spark), items).collect() == []
    assert lexical.ranked_search(edge_docs(spark), items.where("false")).collect() == []
    got = sorted((r["item_id"], r["rank"], r["doc_id"]) for r in lexical.ranked_search(edge_docs(spark), items).collect())
    assert got == [(1, 1, 1), (1, 2, 6), (1, 3, 7), (1, 4, 7), (3, 1, 12), (3, 2, 8), (3, 3, 9)]
    alone = lexical.ranked_search(spark.createDataFrame([(1, LONG)], "doc_id long, text string"), items).collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in alone] == [(3, 1, 1)]


# ------------------------------------------------------------------ top-k search

def plain_top(rows, k, every):
    own = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(256 * x) for x in v]
            own[i] = min(own.get(i, w), w)
    out = []
    for q, v in own.items():
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in own.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("coarse", [2, 128, 10**9])
def test_top_equals_a_plain_one(spark, coarse):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 0.1) for _ in range(9)]) for i in range(700)]
    rows += [(700 + i, rows[50][1]) for i in range(40)]                    # copies of a query, among them queries
    rows += [(800 + i, [0.0] * 9) for i in range(20)] + [(900, [5.0, -300.0, *[0.0] * 6, 1.0]), (901, [1.0]), (902, [])]
    rows += [(910, None), (911, [float("nan")] * 9), (912, [float("inf")] * 9), (913, [None] * 9), (None, [0.1] * 9), (3, rows[3][1]), (4, rows[5][1])]
    d = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(x) for x in bitslices.top_inner_products(d, 4, 10, block_rows=256, coarse=coarse).collect())
    assert got == plain_top(rows, 4, 10)


def test_bitmap_sums():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 500, (6, 1000))
    weights = [1, 3, 5, 2, 7, 4]
    columns = {}
    for row, w in zip(v, weights):
        for c, s in enumerate(bitslices.bitmaps(row)):
            for b in range(w.bit_length()):
                if w >> b & 1:
                    columns.setdefault(b + c, []).append(s)
    want = np.array(weights) @ v
    sums = bitslices.add_up(columns)
    got = sum(np.unpackbits(s.view(np.uint8), bitorder="little", count=1000).astype(int) << w for w, s in sums.items())
    assert (got == want).all()
    every = bitslices.Block(np.arange(1000), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 16), np.uint64)).valid
    for k in (1, 7, 500, 1000):
        assert bitslices.kth_largest(sums, every, k) == np.sort(want)[-k]
    assert bitslices.kth_largest(sums, every, 1001) == 0
    for t in (-5, 0, 1, 4000, 10**7):
        assert (bitslices.set_rows(bitslices.at_least(sums, every, t)) == np.flatnonzero(want >= t)).all()


def test_top_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert bitslices.top_inner_products(spark.createDataFrame([], kind)).collect() == []
    assert bitslices.top_inner_products(spark.createDataFrame([(0, [1.0, 2.0])], kind)).collect() == []
    got = bitslices.top_inner_products(spark.createDataFrame([(0, [1.0]), (7, [-1.0]), (50, None)], kind)).collect()
    assert [tuple(x) for x in got] == [(0, 1, 7, -65536)]
