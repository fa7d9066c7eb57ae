"""Near-duplicates, repeated sequences and benchmark passages against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from fleetlens.llm import decontaminate, near_dup, substring_dedup
from fleetlens.llm.catalog import QUERIES

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, path):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in rows],
                                 "doc_id long, text string, cluster int, text_hash string, n int, _doc string")


# --- near-duplicates -----------------------------------------------------------

def brute_components(rows, size, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    index = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in index[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)), least.get(root(i)) == d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def found_components(df, *args, **kw):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df, *args, **kw).collect()), key=repr)


@pytest.mark.parametrize("none", [True, False])
def test_many_rows_with_one_id_or_none(spark, none):
    """Different texts under one id are told apart, and equal rows count once."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(400):
        base = [rng.choice(words) for _ in range(30)]
        rows += [(None if none else 7, " ".join(base)), (None if none else 7, " ".join([*base, "end"]))]
    rows += [(None if none else 7, "one text that very many rows share " * 4)] * 1500 + [(9, rows[0][1] + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = near_dup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    docs = near_dup.drop_near_duplicates(df).collect()
    assert len(docs) == 401  # one of each pair, one of the shared text


def test_near_dup_query(spark, small):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in QUERIES["op2_minhash_near_dedup"][0](spark, small).collect()), key=repr)
    assert got == brute_components(docs_of(spark, small), 3, 85)


@pytest.mark.parametrize("limit", [near_dup.CLUSTER_LIMIT, 300])
def test_near_dup_chains_and_odd_rows(spark, limit):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "One"), (905, "two words"), (None, "alone here")]
    base = [rng.choice(words) for _ in range(60)]
    for i in range(60):  # each differs a little from the one before: a chain, and a group of near copies
        rows.append((100 + i, " ".join(base)))
        base[rng.randrange(60)] = rng.choice(words)
    centre = [rng.choice(words) for _ in range(80)]
    for i in range(60):
        w = centre[:]
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(80)] = rng.choice(words)
        rows.append((300 + i, " ".join(w)))
    rows += [rows[20], (None, rows[20][1]), (5, "Z " * 20_000), (6, "z " * 20_000)]
    assert found_components(frame(spark, rows), 3, 85, cluster_limit=limit) == brute_components(rows, 3, 85)


def test_near_dup_empty_and_drop(spark):
    df = frame(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, "q"), (4, "a b c d e g h i")])
    assert near_dup.near_duplicates(df.limit(0)).count() == 0
    kept = near_dup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 3, 4, None]


def test_threshold_keeps_the_promise():
    from math import comb
    for percent in (80, 85, 95):
        k, p = near_dup.matches_needed(percent), percent / 100
        assert sum(comb(32, x) * p**x * (1 - p) ** (32 - x) for x in range(k)) < 2e-5


# --- repeated sequences --------------------------------------------------------

def brute_repeats(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    count = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=repr)


def test_repeats_query(spark, small):
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op5_substring_dedup"][0](spark, small).collect()), key=repr)
    assert got == [x[:4] for x in brute_repeats(docs_of(spark, small), 35)]


@pytest.mark.parametrize("window,piece", [(5, 400_000), (20, 400_000), (8, 100)])
def test_repeats_in_runs_periods_and_copies(spark, window, piece, monkeypatch):
    rng = random.Random(2)
    long = " ".join(rng.choice("abcdefghijkl") for _ in range(300))
    few = " ".join(rng.choice("ab") for _ in range(500))
    rows = [(1, None), (2, ""), (3, "x " * 30), (4, "x " * 200), (5, "a b " * 100), (6, long), (7, "q " + few), (8, long[40:220]),
            (9, few[100:300] + " zz " + long[10:190]), (10, long), (None, long), (10, long), (11, "one two three")]
    with monkeypatch.context() as m:
        m.setattr(substring_dedup, "PIECE_WORDS", piece)
        got = substring_dedup.remove_repeats(frame(spark, rows), window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got), key=repr) == brute_repeats(rows, window)


def test_repeats_empty(spark):
    assert substring_dedup.remove_repeats(frame(spark, [(1, "a")]).limit(0)).count() == 0


# --- benchmark passages ----------------------------------------------------------

def plain(t):
    t = (t or "").translate({i: i + 32 for i in [*range(65, 91), *(x for x in range(0xC0, 0xDF) if x != 0xD7)]})
    return re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", t).encode().split()


def brute_overlaps(docs, items):
    out = {}
    for d, t in docs:
        w, place = plain(t), defaultdict(list)
        for i, x in enumerate(w):
            place[x].append(i)
        for k, text in items:
            b = plain(text)
            width, need = (12, 10) if len(b) >= 12 else (len(b), len(b) - (len(b) >= 5))
            best = 0
            for shift in {p - j for j, x in enumerate(b) for p in place[x]}:
                lo, hi = max(0, shift), min(len(w), shift + len(b))
                same, inside = [w[q] == b[q - shift] for q in range(lo, hi)], set()
                for q in range(len(same) - width + 1):
                    if sum(same[q:q + width]) >= need:
                        inside |= {z for z in range(q, q + width) if same[z]}
                best = max(best, len(inside))
            if best:
                out[d, k] = best
    return out


def test_masks_hit_every_tolerated_stretch():
    from itertools import combinations
    for gaps in combinations(range(12), 2):
        assert any(all(o + p not in gaps for p in mask) for mask in decontaminate.MASKS for o in range(12 - mask[-1]))


def test_short_masks_hit_every_tolerated_item():
    for n in range(1, 12):
        masks = decontaminate.masks_for(n)
        for gap in range(n) if n >= 5 else [None]:
            assert any(gap not in m for m in masks), (n, gap)


def test_short_items_with_one_other_word(spark):
    """Items of 1 to 11 words, whole, with one other word at each place, and with two."""
    items, rows = [], [(1, None), (2, ""), (3, "unrelated words only")]
    for n in range(1, 12):
        words = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        rows.append((100 * n, "before " + ", ".join(words) + " after"))
        rows.append((100 * n + 50, " ".join(words)))
        for k in range(n):
            other = [*words[:k], "other", *words[k + 1:]]
            rows += [(100 * n + 1 + k, " ".join(["x"] * (k % 3) + other + ["y"] * (k % 2))),
                     (100 * n + 60 + k, " ".join([*other[:(k + 2) % n], "two", *other[(k + 2) % n + 1:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_equal for r in decontaminate.contaminated(df, bench).collect()}
    assert got == brute_overlaps(rows, items)
    assert all((100 * n, n) in got and ((100 * n + 1, n) in got) == (n >= 5) for n in range(1, 12))


def test_a_repeated_passage_costs_one_row_a_region(spark):
    item = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, (item + " gap ") * 2000)], "doc_id long, text string")
    got = decontaminate.contaminated(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.n_equal, r.first_word, r.end_word) for r in got] == [(1, 7, 30, 0, 30)]


def test_decontamination_query(spark, small):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.n_equal for r in QUERIES["op4_benchmark_decontamination"][0](spark, small).collect()}
    assert got and got == brute_overlaps(docs_of(spark, small), items)


def test_substituted_passages(spark, small):
    rng = random.Random(3)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    base = docs_of(spark, small)[:60]
    rows = base + [(None, None), (5000, ""), (5001, "one"), (7000, "xx short, item of exactly six words. yy"), (7001, "short item of exactly seven")]
    for i in range(60):
        w = rng.choice(items)[1].split()
        for q in range(len(w)):
            if rng.random() < rng.choice([0, 0.1, 0.2]):
                w[q] = f"zz{i}q{q}"
        host = base[i][1].split()
        p = rng.randrange(len(host) + 1)
        text = " ".join(host[:p] + w + host[p:])
        rows.append((6000 + i, text if i % 2 else text.upper()))
    rows.append(rows[-1])
    items += [(900, "Short item of five"), (901, "Short item of exactly six words"), (902, None), (903, "")]
    df, bench = frame(spark, rows), spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, words int")
    want = brute_overlaps(rows, items)
    assert {(r.doc_id, r.item_id): r.n_equal for r in decontaminate.contaminated(df, bench).collect()} == want
    left = decontaminate.without_contaminated(df, bench)
    assert left.columns == df.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted((d for d, _ in rows if d not in {x for x, _ in want}), key=repr)
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0
