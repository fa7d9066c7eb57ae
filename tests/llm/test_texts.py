"""Url filters, quality rules and model, secrets, packing, pages, conversations, pipeline."""

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fleetlens.llm import html_text, packing, quality_model, quality_rules, quotes, secrets, tokens, url_filters, words
from fleetlens.llm.catalog import QUERIES
from tests.compare import difference, duck

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, kept int, numbers string")


def texts_of(spark, path):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}


# --- words -------------------------------------------------------------------------

def test_words_across_pieces(monkeypatch):
    monkeypatch.setattr(words, "PIECE", 64)
    monkeypatch.setattr(words, "LONG_WORD", 16)
    texts = pa.array(["a bb", "", "ccc" + "x" * 200 + " d", None, "e", "\n\n", " f " * 50, "zz" * 40, "q", "é\x0bü"])
    buf, at = words.text_bytes(texts)
    w = words.find_words(buf, at)
    got = [[buf[s:e].tobytes() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.first, w.first[1:])]
    assert got == [(t or "").encode().split() for t in texts.to_pylist()]
    by_word = {}
    for x, h in zip((x for ws in got for x in ws), w.hash):
        assert by_word.setdefault(x, h) == h
    assert len(set(by_word.values())) == len(by_word)


# --- urls --------------------------------------------------------------------------

def test_url_query(spark, small):
    run, sql = QUERIES["op1_url_filters"]
    assert difference(run(spark, small), duck(small), sql) is None


@pytest.mark.parametrize("limit", [url_filters.BROADCAST_BYTES, 0])
def test_url_precedence(spark, limit):
    urls = [(1, "https://a.B.com/en/x?q#f"), (2, "http://com"), (3, "http://xcom/en/"), (4, None), (5, "no url"), (6, ""), (7, "s://b.com/en/"),
            (7, "s://b.com/en/"), (None, "s://c.com/"), (8, "s://b.com/de/"), (9, "s://a..com/")]
    pages = spark.createDataFrame([(i, u, "h", "d") for i, u in urls], "page_id long, url string, host string, digest string")
    rules = url_filters.rule_table(spark, [("com", "/", "allow"), ("b.com", "/en/", "block"), ("b.com", "/en/", "allow"), ("b.com", "/", "block")])
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(pages, rules, broadcast_bytes=limit).collect()), key=repr)
    assert got == sorted([
        (1, "a.b.com", "/en/x", "b.com/en/", "block"), (2, "com", "", None, "allow"), (3, "xcom", "/en/", None, "allow"), (4, "", "", None, "allow"),
        (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "b.com", "/en/", "b.com/en/", "block"), (7, "b.com", "/en/", "b.com/en/", "block"),
        (None, "c.com", "/", "com/", "allow"), (8, "b.com", "/de/", "b.com/", "block"), (9, "a..com", "/", "com/", "allow")], key=repr)
    assert url_filters.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filters.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


# --- quality rules -------------------------------------------------------------------

def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup, cover = set(), 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    for i in range(len(w) - 2):
        if c[tuple(w[i:i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def counts_of(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_quality_rules_query(spark, small):
    texts, rows = texts_of(spark, small), QUERIES["op3_quality_rules"][0](spark, small).collect()
    assert len(rows) == len(texts)
    assert all(counts_of(r) == brute_counts(texts[r.doc_id]) and not (r.base_failed and r.kept) for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert np.mean(good) >= 0.95


def test_quality_rules_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "é # \n\n \n x x x x\nx x x x\n"), (3, "a\tb\x0bc"), (None, " ".join(f"w{i}" for i in range(60))), (5, "ab " * 40_000)]
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    out = quality_rules.quality_rules(frame(spark, rows), labels).collect()
    assert sorted(((r.doc_id, *counts_of(r)) for r in out), key=repr) == sorted(((i, *brute_counts(t)) for i, t in rows), key=repr)
    assert [r.doc_id for r in out if r.kept] == [None] and all(r.strangeness is None for r in out)
    assert quality_rules.quality_rules(frame(spark, rows).limit(0), labels).count() == 0
    assert quality_rules.keep_good(frame(spark, rows), labels).columns == ["doc_id", "text", "kept", "numbers"]


def test_forest_isolates_what_lies_apart():
    rng = np.random.default_rng(0)
    good = rng.normal(0, 1, (500, 3))
    far = np.array([[9.0, 0, 0], [0, -9, 0]])
    forest = quality_rules.IsolationForest(good, np.full(3, -10.0), np.full(3, 10.0))
    assert forest.score(far).min() > np.quantile(forest.score(good), 0.99)


def test_counted_forest_isolates_what_lies_apart():
    """Rows may be counted in any parts, and the far ones end in empty parts of the box."""
    rng = np.random.default_rng(0)
    good = rng.normal(0, 1, (5000, 3))
    far = np.array([[9.0, 0, 0], [0, -9, 0]])
    forest = quality_rules.CountedForest(np.full(3, -10.0), np.full(3, 10.0))
    counts = forest.counted(good[:1200]) + forest.counted(good[1200:])
    assert (counts == forest.counted(good)).all() and (counts.sum(axis=1) == 5000).all()
    forest.settle(counts)
    assert forest.score(far).min() > np.quantile(forest.score(good), 0.99)
    flat = quality_rules.CountedForest(np.ones(3), np.ones(3))
    flat.settle(flat.counted(np.ones((9, 3))))
    assert np.allclose(flat.score(np.ones((2, 3))), 0.5)


def test_forest_counts_every_labelled_row(spark, monkeypatch):
    """Strangeness and threshold equal those of one forest over all rows, here more than a sample once held."""
    from fleetlens.functions import ordered
    rng = np.random.default_rng(2)
    sizes, marks = rng.integers(2, 9, 21_000), rng.integers(0, 12, 21_000)
    rows = [(i, " ".join(["A" * int(n) + str(j) for j in range(50)] + ["#"] * int(m))) for i, (n, m) in enumerate(zip(sizes, marks))]
    rows[777] = (777, " ".join(f"w{j}####" for j in range(400)))
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(len(rows))], "doc_id long, quality int").repartition(3)
    x = [None] * len(rows)
    for i, (_, text) in enumerate(rows):
        words_of = text.split()
        chars, upper = sum(map(len, words_of)), sum(c == "A" for c in text)
        window = [tuple(words_of[k:k + 3]) for k in range(len(words_of) - 2)]
        again = {w for w, n in Counter(window).items() if n > 1}
        repeated = {k + j for k, w in enumerate(window) if w in again for j in range(3)}
        x[i] = [chars / len(words_of), np.log1p(text.count("#") / len(words_of)), len(repeated) / len(words_of), upper / chars]
    x, good = np.array(x), np.arange(len(rows)) % 10 > 0
    forest = quality_rules.CountedForest(x.min(axis=0), x.max(axis=0))
    forest.settle(forest.counted(x[good]))
    want = forest.score(x)
    limit = np.sort(want[good])[int(np.floor(good.sum() * (1 - quality_rules.GOOD_LOSS)))]
    for small in (ordered.BROADCAST_ROWS, 0):
        monkeypatch.setattr(ordered, "BROADCAST_ROWS", small)
        got = quality_rules.quality_rules(frame(spark, rows), labels).collect()
        assert len(got) == len(rows) and np.allclose([r.strangeness for r in got], want[[r.doc_id for r in got]])
        assert all(r.kept == (want[r.doc_id] <= limit) for r in got if abs(want[r.doc_id] - limit) > 1e-9)
    assert want[777] == want.max() and sum(r.kept for r in got if good[r.doc_id]) >= (1 - quality_rules.GOOD_LOSS) * good.sum()


def test_value_at_a_place(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "BUCKETS", 7)
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.random(300), np.full(90, 0.25), 0.25 + np.arange(40) * 2.0 ** -54, [0.0, 1.0, 5e-324]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").cache()
    for place in (0, 1, 2, 100, 150, 431, 432):
        assert quality_rules.value_at(df, "v", place) == np.sort(values)[place]
    assert quality_rules.value_at(df.filter("v = 0.25"), "v", 5) == 0.25


# --- quality model ---------------------------------------------------------------------

def test_model_on_held_out_rows(spark, small):
    path = small.replace("sf0.001", "sf0.01")
    rows = QUERIES["op7_quality_classifier"][0](spark, path).collect()
    assert len(rows) == len(texts_of(spark, path))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]) >= 0.9


def test_model_sees_the_whole_text():
    net = quality_model.ByteNetwork()
    rng = np.random.default_rng(1)
    long = rng.integers(97, 123, 5000).astype(np.uint8)
    x, begin = quality_model.symbols(long, np.array([0, 5000]))
    start, size, _ = quality_model.chunk_starts(begin)
    raw = quality_model.responses(net.table, x, start, size)
    for c in range(len(start)):  # direct evaluation of every filter at every place
        places = [sum(net.table[k, x[t + k]] for k in range(quality_model.WIDTH)) for t in range(start[c], start[c] + size[c])]
        assert np.allclose(np.max(places, axis=0), raw[c], atol=1e-5)
    assert size.sum() == 5000
    both = np.concatenate([long, long[:7]])
    together = net.score(both, np.array([0, 5000, 5000, 5007]))
    alone = [net.score(long, np.array([0, 5000]))[0], net.score(long[:0], np.array([0, 0]))[0], net.score(long[:7], np.array([0, 7]))[0]]
    assert np.allclose(together, alone)


def test_model_without_labels(spark):
    df = frame(spark, [(1, None), (2, ""), (None, "x" * 100_000), (2, "")])
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert [r.score for r in quality_model.quality_scores(df, labels).collect()] == [0.5] * 4
    assert quality_model.quality_scores(df.limit(0), labels).count() == 0


# --- secrets ------------------------------------------------------------------------------

BASE = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def brute_spans(text):
    spans = sorted((m.start(), k, name, m.end()) for k, (name, rx, ok) in enumerate(BASE) for m in rx.finditer(text or "") if ok(m))
    return [(name, a, b) for a, _, name, b in spans]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_secrets_query(spark, small):
    path = small.replace("sf0.001", "sf0.01")
    texts, rows = texts_of(spark, path), QUERIES["op8_secret_scans"][0](spark, path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_spans(texts[r.doc_id])
        n = Counter(k for k, *_ in want)
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (n["assign"], n["access"], n["hex"], digest(want))
    assert sum(r.n_assign for r in rows) > 0


def test_secrets_odd_rows_and_redaction(spark):
    rows = [(1, None), (2, ""), (3, "Token=token: abcdefgh tOKEN='abcdefg' secret:x"), (None, "token=abcdef"), (4, "x"), (5, "token=abcdef " * 3000),
            (4, "é" * 5 + 'password = "pass/w=rd1" AKIA' + "A" * 16 + " " + "a1" * 12 + " ghp_" + "a" * 36), (6, "İtoken=abcdef"),
            (7, "API_KEY:aaaaaa apikey:'bbbbbbb api__key:cccccc"), (3, "Token=token: abcdefgh tOKEN='abcdefg' secret:x")]
    df = frame(spark, rows)
    out = secrets.find_secrets(df)
    assert out.columns == [*df.columns, "secret_spans"]
    got = Counter((r.doc_id, r.text, tuple((secrets.RULES[s.kind].kind, s.start, s.end) for s in r.secret_spans if s.kind < 3)) for r in out.collect())
    assert got == Counter((i, t, tuple(brute_spans(t))) for i, t in rows)
    clean = secrets.redact(df)
    assert clean.columns == df.columns
    by_id = {r.doc_id: r.text for r in clean.collect()}
    assert by_id[1] is None and by_id[2] == "" and by_id[5] == "[REDACTED] " * 3000 and by_id[6] == "İ[REDACTED]"
    assert secrets.find_secrets(df.limit(0)).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_trigram_queries():
    assert secrets.trigram_query(r"[0-9a-f]{24,}") is None
    assert secrets.trigram_query(r"AKIA[A-Z0-9]{16,}") == [frozenset({"aki", "kia"})]
    assert secrets.trigram_query(r"ab(c|de)y") == [frozenset({"abc", "bcy"}), frozenset({"abd", "bde", "dey"})]
    assert secrets.trigram_query(r"abcd+efgh*") == [frozenset({"abc", "efg"})]
    assert secrets.trigram_query(r"ab(c|de)+f") is None
    assert secrets.trigram_query(r"ab?c") is None


def test_running_sums(spark):
    lists = [[1, 2, 3, 4, 5, 6, 7], [], [5], list(range(1000))]
    df = spark.createDataFrame([(x,) for x in lists], "a array<int>")
    for r in df.select("a", secrets.running_sums(F.col("a")).alias("s")).collect():
        assert r.s == np.cumsum(r.a, dtype=int).tolist()


# --- packing --------------------------------------------------------------------------------

def check_packing(rows, ids, limit=2048):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert docs.keys() == ids.keys()
    for i, v in ids.items():
        at = 0
        for r in sorted(docs[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(v) and r.ids_crc32 == zlib.crc32(v[at:at + r.length].tobytes())
            at += r.length
        assert at == len(v)
    padding = 0
    for v in sequences.values():
        at = 0
        for r in sorted(v, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit
        padding += 0 if at & (at - 1) == 0 else limit - at
    return padding


def test_packing_query(spark, small):
    library = Tokenizer.from_file(TOKENIZER)
    ids = {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in texts_of(spark, small).items()}
    assert check_packing(QUERIES["op10_packing"][0](spark, small).collect(), ids) == 0


def test_packing_with_prompts_and_binding_limits(spark, small):
    """Every limit stops some sequence, and none is passed."""
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(150)
    df = docs.selectExpr("doc_id", "text", "cast(case when doc_id % 3 = 0 then 400 when doc_id % 3 = 1 then 5 end as int) AS quiet").repartition(2)
    quiet = {r.doc_id: r.quiet or 0 for r in df.collect()}
    limits = {"tokens": 512, "segments": 4, "loss_tokens": 300}
    rows = packing.pack(df, TOKENIZER, **limits, prompt_column="quiet", with_ids=False).collect()
    got = {}
    for r in rows:
        s = got.setdefault(r.sequence_id, [0, 0, 0])
        s[0] += r.length
        s[1] += 1
        s[2] += max(0, r.start + r.length - max(r.start, quiet[r.doc_id]))
    assert all(x <= y for s in got.values() for x, y in zip(s, limits.values()))
    assert all(sum(s[i] == y for s in got.values()) > 2 for i, y in enumerate(limits.values()))
    whole = {}
    for r in rows:
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    for (_, n), parts in whole.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == n


def test_packing_odd_rows(spark):
    df = frame(spark, [(1, None), (2, ""), (3, "Hello world " * 4000), (None, "x"), (4, "a")])
    rows = packing.pack(df, TOKENIZER).collect()
    library = Tokenizer.from_file(TOKENIZER)
    assert check_packing(rows, {r.doc_id: np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4") for r in df.collect()}) == 0
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert packing.pack(df.limit(0), TOKENIZER).count() == 0


@pytest.mark.parametrize("limits", [(100, 3, 50), (64, 2, 64), (64, 4, 10)])
def test_three_limits(limits):
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 90, 1500)
    prompts = [int(rng.integers(0, s + 1)) for s in sizes]
    p = packing.Packer(*limits, 0)
    for i, s in enumerate(sizes):
        p.add(i, int(s), prompts[i])
    p.finish()
    done, sequences = Counter(), defaultdict(list)
    for i, start, n, seq, _ in p.out:
        assert done[i] == start
        done[i] += n
        sequences[seq].append((i, start, n))
    assert all(done[i] == s for i, s in enumerate(sizes))
    for v in sequences.values():
        loss = sum(max(0, n - max(0, prompts[i] - start)) for i, start, n in v)
        assert sum(n for *_, n in v) <= limits[0] and len(v) <= limits[1] and loss <= limits[2]


def test_runs_equal_the_library():
    odd = ["Don't WE'LL it's 12345 a1b22", "naïve ÀÉÎ×÷ß ñandú ÿ", "e\u0301 café <|endoftext|> x<|startoftext|>y", "中文 字符 日本　語 x", "a\x1cb \x0b c\x85d", None,
           "", " \n ", "😀 %%%$$$ «hola»", "ΣΑΣ Σ", "x" * 5000 + " " + "y" * 3, "'", "''s", "Ǆ ﬁ ½", "a_b-c;d||<e|f"]
    t = tokens.RunTokenizer(TOKENIZER)
    buf, at = words.text_bytes(pa.array(odd))
    assert [x.tolist() for x in tokens.text_ids(t, buf, at)] == [t.library.encode(x or "", add_special_tokens=False).ids for x in odd]


# --- pages ------------------------------------------------------------------------------------

def brute_article(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", inner)
    lines = [" ".join(html.unescape(re.sub(r"</?b>", "", p).replace("<br>", " ")).split()) for p in parts]
    return "\n".join(x for x in lines if x)


def test_html_query(spark, small):
    rows = QUERIES["op6_html_extraction"][0](spark, small).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    assert all(r.text == brute_article(pages[r.page_id]) and r.n_chars == len(r.text) for r in rows)


def test_html_of_other_make(spark, small):
    pages = sorted(r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect())
    model = html_text.learn(pages[:-15])
    rng, right, pages = np.random.default_rng(42), 0, pages[-15:] * 3
    for p in pages:
        v = html_text.varied(p, rng)
        nodes, y = html_text.labelled(v)
        right += model.texts([html_text._SIDE.sub("", v)])[0] == html_text.joined_text(nodes, (y > 0).tolist())
    assert right >= 0.9 * len(pages)


def test_html_odd_rows(spark):
    odd = [(1, None), (2, ""), (3, "<p>a &amp; b"), (4, "<<<>>"), (5, "<div>" * 3000 + "x"), (5, "<p" * 1000), (None, "<script>x"), (6, "y" * 200_000)]
    df = spark.createDataFrame([(i, None, h, 0) for i, h in odd], "page_id long, url string, html string, text int")
    rows = html_text.extract_text(df).collect()
    assert len(rows) == len(odd) and all(r.n_chars == len(r.text) for r in rows)
    assert {r.text for r in rows if r.page_id == 3} == {"a & b"}
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_decoding_has_no_contradiction():
    nodes = html_text.parse("<div><div><p>a</p><p>b</p></div><div><p>c</p></div></div>")
    keep, drop = [2.0, 2.0, 0.1, 0.1, 2.0, 0.1, 2.0], [0.1, 0.1, 2.0, 2.0, 0.1, 2.0, 0.1]
    for scale in (0.01, 1, 100):
        kept = html_text.decode(nodes, [scale * x for x in keep[:len(nodes)]], [scale * x for x in drop[:len(nodes)]])
        if scale == 0.01:  # too little evidence to decide inside
            assert len(set(kept)) == 1


# --- conversations -------------------------------------------------------------------------------

def test_quotations(spark):
    rows = [(1, 0, "u", "Hello there. How do I sort a list?"), (1, 1, "a", "Use sorted. It returns a new list."),
            (1, 2, "u", "> Use sorted. It returns\n> a new list.\n\nThanks! And in place?"),
            (1, 3, "a", "On Monday, a user wrote:\n> How do I sort a list?\nAlternatively use list.sort."),
            (1, 4, "u", "> > Use sorted. It returns a new list.\n> Thanks! And in place?\nI mean this. What else?"), (1, 5, "x", None), (1, 6, "x", ""),
            (1, 6, "y", "> nothing known.\nq"), (None, 1, "u", "> Hello there.\na"), (2, None, "u", "b"), (2, 0, "u", "Hello there."), (2, 1, "u", "> hello   there.\n")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "conv_id long, turn long, role string, text string, row int, position int")
    got = sorted(((r.conv_id, r.position, r.turn, r.reply_to, r.thread, r.depth, r.text) for r in quotes.reply_order(df).collect()), key=repr)
    assert got == sorted([
        (1, 1, 0, None, 0, 0, "Hello there. How do I sort a list?"), (1, 2, 3, 0, 0, 1, "Alternatively use list.sort."),
        (1, 3, 1, None, 1, 0, "Use sorted. It returns a new list."), (1, 4, 2, 1, 1, 1, "Thanks! And in place?"),
        (1, 5, 4, 2, 1, 2, "I mean this. What else?"), (1, 6, 5, None, 5, 0, None), (1, 7, 6, None, 6, 0, ""), (1, 8, 6, None, 6, 0, "q"),
        (None, 1, 1, None, 1, 0, "a"), (2, 1, None, None, None, 0, "b"), (2, 2, 0, None, 0, 0, "Hello there."), (2, 3, 1, 0, 0, 1, "")], key=repr)
    assert quotes.reply_order(df.limit(0)).count() == 0


def test_long_reply_chain(spark):
    n = 70
    rows = [(1, i, "u", (f"> Message number {i - 1}.\n" if i else "") + f"Message number {i}.") for i in range(n)]
    out = quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all((r.thread, r.depth, r.position, r.text) == (0, r.turn, r.turn + 1, f"Message number {r.turn}.") for r in out)


def test_conversations_query(spark, small):
    rows = QUERIES["op9_chat_formatting"][0](spark, small).collect()
    given = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{small}/conversations.parquet").collect()}
    assert len(rows) == len(given)
    for r in rows:  # these tables quote nothing: order and texts stay
        text, passages = quotes.split_quotes(given[r.conv_id, r.turn])
        assert r.text == text and r.n_quotes == len(passages)


# --- pipeline ---------------------------------------------------------------------------------------

def test_pipeline_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    tables = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        if k < 4:
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        tables[name], docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
    texts = {k: {r.doc_id: r.text for r in v.collect()} for k, v in tables.items()}
    assert all(not brute_counts(t)[5] for t in texts["near_dedup"].values())
    from tests.llm.test_pairs import brute_components, brute_overlaps
    kept = {x[0] for x in brute_components(list(texts["near_dedup"].items()), 5, 80) if x[3]}
    assert kept == texts["decontamination"].keys()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    flagged = {d for d, _ in brute_overlaps(list(texts["decontamination"].items()), items)}
    assert texts["decontamination"].keys() - flagged == texts["secret_scans"].keys()
    for d, t in texts["packing"].items():
        assert not brute_spans(t) and (t == texts["secret_scans"][d] or "[REDACTED]" in t)
    library = Tokenizer.from_file(TOKENIZER)
    ids = {d: np.array(library.encode(t, add_special_tokens=False).ids + [1], "<u4") for d, t in texts["packing"].items()}
    assert check_packing(docs.collect(), ids) == 0


def test_pipeline_on_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0
