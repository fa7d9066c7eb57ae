"""Ranked lexical search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fleetlens.llm import ranked_search as rs
from fleetlens.llm.catalog import QUERIES
from tests.compare import difference, duck

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    """(item row, rank, doc_id, score); null ids come last among equal scores."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    total, df = sum(n for _, _, n in bags), Counter(t for _, b, _ in bags for t in b)
    out = []
    for row, (item, text) in enumerate(items):
        found = []
        for d, b, n in bags:
            m = 100 - 50 + 50 * n * len(bags) // total
            s = sum(math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m))
                    for t in set(terms(text)) if t in b)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def got(df, items, k=50):
    return sorted((tuple(r) for r in rs.ranked_search(df, items, k).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "été", "naïve", "A1", "x_y", "ß"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 12, 80])))) for i in range(n)]
    docs += [(None, docs[3][1]), (None, "w50 w51"), (3, docs[3][1]), (9001, None), (9002, ""), (9003, "... --"), (-5, "W50, w51!")]
    docs += [(10_000 + i, "w7 w8 w9 w10") for i in range(70)]  # more equal scores than places
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 4, 20])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "unseen"), (103, "w50 W51"), (103, "w7"), (104, "w7 w8 w9 w10"), (None, "été w1")]
    return docs, items


@pytest.mark.parametrize("k", [1, 50])
def test_search_equals_brute_force(spark, k, monkeypatch):
    docs, items = corpus(1, 600)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, item long, terms string").repartition(3)
    bench = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    want = brute(docs, items, k)
    assert got(df, bench, k) == want
    monkeypatch.setattr(rs, "ITEM_TERMS", 40)  # items in many blocks
    if k == 1:
        assert got(df, bench, k) == want


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert got(df, bench) == brute([(1, "a b")], [(1, "a")], 50)
    for a, b in ((df.limit(0), bench), (df, bench.limit(0)), (df.limit(0), bench.limit(0))):
        out = rs.ranked_search(a, b)
        assert out.count() == 0 and dict(out.dtypes)["rank"] == "int"


@pytest.mark.parametrize("leaf, picks, postings", [(1, 3, 40), (4, 20_000, 300), (64, 20_000, 1 << 19)])
def test_shards_keep_the_best_of_all(leaf, picks, postings, monkeypatch):
    """Short leaves, few intervals a round and many small shards give the same results."""
    monkeypatch.setattr(rs, "LEAF", leaf)
    monkeypatch.setattr(rs, "PICKS", picks)
    monkeypatch.setattr(rs, "SHARD_POSTINGS", postings)
    docs, items = corpus(2, 500)
    names = sorted({t for _, x in items for t in terms(x)})
    place = {t: i for i, t in enumerate(names)}
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    df = Counter(t for _, b in bags for t in b)
    lists = [sorted({place[t] for t in terms(x)}) for _, x in items]
    q = rs.Queries(np.arange(len(items)), np.cumsum([0] + [len(x) for x in lists]), np.array([t for x in lists for t in x]),
                   np.array([rs.term_weight(len(bags), df[t]) if df[t] else 0 for t in names]), len(bags),
                   sum(sum(b.values()) for _, b in bags), 5)
    rows = [(d, sum(b.values()), sorted(place[t] for t in b if t in place)) for d, b in bags]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([d for d, _, _ in rows], pa.int64()), pa.array([n for _, n, _ in rows], pa.int64()), pa.array([x for _, _, x in rows], pa.list_(pa.int32())),
         pa.array([[b[names[t]] for t in x] for (_, _, x), (_, b) in zip(rows, bags)], pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])
    kept, shards = rs.Kept(len(items), 5), 0
    for void, ids, n, doc, term, tf in rs._shards(iter([batch.slice(0, 100), batch.slice(100, 1), batch.slice(101)])):
        shards += 1
        shard = rs.Shard(q, n, doc, term, tf)
        rs.search(shard, q, kept, void, ids)
    assert shards == 1 if postings > 10_000 else shards > 5
    found = sorted(zip(kept.item.tolist(), (-kept.score).tolist(), kept.void.tolist(), kept.doc.tolist()))
    want = {}
    for item, rank, d, s in brute(docs, list(enumerate(t for _, t in items)), 5):
        want.setdefault(item, []).append((rank, s, d))
    assert [(i, -s, None if v else d) for i, s, v, d in found] == [(i, s, d) for i in sorted(want) for _, s, d in sorted(want[i], key=lambda x: x[0])]


def test_range_maxima():
    rng = np.random.default_rng(1)
    q = rs.Queries(np.arange(1), np.array([0, 2]), np.array([0, 1]), np.array([5, 7]), 300, 9000, 5)
    n = rng.integers(1, 60, 300)
    doc = np.concatenate([np.arange(300), np.flatnonzero(rng.random(300) < 0.5)])
    shard = rs.Shard(q, n, doc, np.r_[np.zeros(300, int), np.ones(len(doc) - 300, int)], rng.integers(1, 9, len(doc)))
    for _ in range(300):
        a, b = sorted(rng.integers(0, 301, 2))
        if a < b:
            assert shard.impact[shard.top(np.array([a]), np.array([b]))[0]] == shard.impact[a:b].max()


def test_query(spark, small):
    run, sql = QUERIES["op13_ranked_search"]
    assert difference(run(spark, small), duck(small), sql) is None
