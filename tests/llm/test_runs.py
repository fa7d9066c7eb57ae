"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from fleetlens.llm import periodic_runs
from fleetlens.llm.catalog import QUERIES


def brute_runs(words, least=24):
    """Every stretch of each period, then the smallest period of each stretch."""
    n, found = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 3 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((b, e - b, p) for (b, e), p in found.items())


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def cases():
    rng = random.Random(5)
    out = ["", " \n ", "one", "a " * 23, "a " * 24, "\ta" * 25 + "\x0bb", "x " * 5 + "a b " * 12, "a b " * 12 + "a c", ("a " * 30 + "b ") * 4,
           ("a b a b a c " * 5 + "d ") * 3 + "a b", "a a b " * 9 + "a a a", "u v w " * 12, "é ü " * 40 + "é"]
    for size in (2, 3, 6):  # few words: runs of many periods, touching and nested
        for n in (60, 300, 700):
            out.append(" ".join(rng.choice("abcdef"[:size]) for _ in range(n)))
    for p in [*range(1, 40), 47, 48, 49, 63, 64, 65, 90, 95, 96, 97, 127, 128, 129, 191, 192, 193, 300]:
        unit = [rng.choice("abcd" if rng.random() < 0.5 else [str(i) for i in range(1000)]) for _ in range(p)]
        for times in (2.9, 3, 3.4, 7):
            n = int(times * p)
            out.append(" ".join(["start"] * (p % 3) + (unit * 8)[:n] + ["the", "end"][:p % 4]))
    for _ in range(25):  # periods of periods
        unit = [rng.choice("ab") for _ in range(rng.randint(1, 5))] * rng.randint(1, 9) + [rng.choice("abc")] * rng.randint(0, 4)
        unit = unit * rng.randint(1, 4) + [rng.choice("abd")] * rng.randint(0, 3)
        out.append(" ".join(unit * rng.randint(1, 6)))
    word = ["a"]  # words of two hashes whose polynomials meet in arithmetic modulo 2 ** 64
    for _ in range(11):
        word += ["b" if x == "a" else "a" for x in word]
    out.append(" ".join(word))
    thue = " ".join(word[:1024] + ["b" if x == "a" else "a" for x in word[:1024]] + word[:1024] * 2)
    return out + [thue]


def test_runs_equal_brute_force(spark):
    texts = cases()
    rows = [(i, t, "r", 3) for i, t in enumerate(texts)] + [(None, None, "r", 1), (None, "a " * 30, "r", 1), (7, "a " * 30, "r", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").repartition(3)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(df).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        words = [x.decode() for x in (t or "").encode().split()]
        runs = brute_runs(words)
        want.append((i, len(words), runs, collapsed(words, runs)))
    assert got == sorted(want, key=repr)
    assert sum(len(x[2]) > 0 for x in want) > 100


def test_least_length(spark):
    df = spark.createDataFrame([(1, "a b " * 5 + "c " * 40)], "doc_id long, text string")
    got = {least: [tuple(x) for x in periodic_runs.periodic_runs(df, least).first().runs] for least in (6, 24, 50)}
    assert got == {6: [(0, 10, 2), (10, 40, 1)], 24: [(10, 40, 1)], 50: []}


def test_equal_hashes_of_other_words():
    words = np.array([1, 2, 3, 1, 2, 3, 1, 2, 3, 1, 2, 9, 1, 2, 3])
    same = periodic_runs.Extensions(words, np.zeros(len(words), np.uint64))  # every hash is equal
    assert [x.tolist() for x in same.runs(np.array([2]), np.array([3]))] == [[0], [11], [3]]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.periodic_runs(df).count() == 0


def brute_row(doc_id, text):
    words = [x.decode() for x in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(collapsed(words, runs)))


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    short = {i: t for i, t in rows if len((t or "").split()) < 1500}
    got = {r.doc_id: tuple(r) for r in QUERIES["op12_periodic_runs"][0](spark, small).collect()}
    assert set(got) == {i for i, _ in rows} and len(got) == len(rows)
    for i, t in short.items():
        assert got[i] == brute_row(i, t), i
    assert sum(got[i][1] > 0 for i in short) > 5
