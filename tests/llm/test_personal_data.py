"""Personal data: the given rules against plain regular expressions, found identifiers against a plain graph."""

import hashlib
import math
import random
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm import personal_data
from fleetlens.llm.catalog import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and plain_luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15]
    return sorted(out)


@settings(max_examples=3000, deadline=None)
@given(st.text(st.sampled_from("aB9012.@-+_%() é"), max_size=40))
def test_rules_equal_plain_expressions(text):
    assert personal_data.rule_spans(text) == plain_spans(text)


def test_rules_on_cases():
    for text in ("a@b.c_d@e.f", "a@b.c@d.e.f", "x@y", "@a.b", "1.2.3.4.5.6.7.8.9", "1.2.3.400.5.6.7.8", "001.2.3.00255 é 1.2.3",
                 "4111 1111 1111 1111", "4111-1111  1111 1111", "+1 (974) 555-3436, +49 30 1234567 8", "+12 ( ) + 1", "4111111111111111 4111",
                 "é" * 50 + " ü@a-b.de 4111 1111 1111 1111"):
        assert personal_data.rule_spans(text) == plain_spans(text), text


def test_rules_read_long_texts_once():
    for text in ("9" * 300_000, "a" * 300_000, "a." * 150_000, "1." * 150_000, "+1 " * 100_000, "a@" * 150_000, "4111 1111 1111 1111" * 10_000):
        personal_data.other_spans(text, personal_data.rule_spans(text))


# --- identifiers found by context -----------------------------------------------------------------

TOKEN = re.compile(r"""[^\x09-\x0D\x20:="'`<>()\[\]{},;|]+""")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain_found(texts, support=3, confidence=0.8, rounds=4):
    mentions, places = [], defaultdict(int)
    for i, text in enumerate(texts):
        tokens = [(lower(m.group()), m.start(), m.end()) for m in TOKEN.finditer(text)]
        words = [None, None, *(t for t, _, _ in tokens), None, None]

        def patterns(a, b):
            return ("before", words[a], words[a + 1]), ("around", words[a + 1], words[b + 3])
        for k in range(len(tokens)):
            for p in patterns(k, k):
                places[p] += 1
        base = plain_spans(text)
        for s, e, k in [(s, e, k) for s, k, e in base] + [(s, e, -1) for s, e in personal_data.other_spans(text, base)]:
            inside = [n for n, (_, a, b) in enumerate(tokens) if a < e and b > s]
            mentions.append((i, s, e, k, text[s:e], patterns(inside[0], inside[-1])))
    edges = defaultdict(int)
    kinds = {}
    for *_, k, v, ps in mentions:
        for p in ps:
            edges[p, v] += 1
            kinds[p, v] = max(k, kinds.get((p, v), -1))
    known = {}
    for _ in range(rounds):
        held, seeds = defaultdict(int), defaultdict(int)
        for (p, v), n in edges.items():
            k = kinds[p, v] if kinds[p, v] >= 0 else known.get(v)
            if k is not None:
                held[p, k] += n
                seeds[p, k] += 1
        best = {}
        for (p, k), n in held.items():
            best[p] = max(best.get(p, (0, 0, 0)), (n, -k, seeds[p, k]))
        vouch = {p: (-k, n / max(n, places[p])) for p, (n, k, d) in best.items() if d >= support and n / max(n, places[p]) >= confidence}
        votes = defaultdict(int)
        for p, v in edges:
            if kinds[p, v] < 0 and p in vouch:
                k, share = vouch[p]
                votes[v, k] += round(-math.log(max(1e-6, 1 - share)) * 1e6)
        new = {}
        for (v, k), w in votes.items():
            new[v] = max(new.get(v, (0, 0)), (w, -k))
        new = {v: -k for v, (w, k) in new.items() if w >= -math.log(1 - confidence) * 1e6 - 1}
        if new.keys() == known.keys():
            known = new
            break
        known = new
    out = [sorted(plain_spans(t)) for t in texts]
    for i, s, e, k, v, _ in mentions:
        if k < 0 and v in known:
            out[i].append((s, known[v] + 4, e))
    return [sorted(x) for x in out]


def corpus():
    rng = random.Random(3)
    texts = []
    for i in range(40):
        texts.append(f"Hello. Call me at +1 (555) 010-{1000 + i} today, or mail: user{i}@mail.example.org please.")
        texts.append(f"filler {rng.choice(['about', 'on'])} the number {rng.randint(10**7, 10**8)} of things")
    for i in range(6):
        texts.append(f"é Call me at 555-0{i}77-31{i} today! My badge id {700 + i}AB{i}CD99 opened it.")
        texts.append(f"Please write down badge id {700 + i}AB{i}CD99 now. Ask extension 555-0{i}77-31{i} about it.")
        texts.append(f"Write a letter, or mail: somebody{i}@localhost please. Order 4{i}4-8{i}8-66{i} came")
    texts.append("Ask extension 999-111-2222 about it")  # vouched for in a later round only
    return [*texts, "", "nothing here", "Call me at noon today"] + ["Card 4111 1111 1111 1111 at home"] * 30


def test_found_by_context(spark):
    texts = corpus()
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (None, None, "x", 1), (None, texts[0], "x", 1)],
                               "doc_id long, text string, base string, row int").repartition(4)
    got = personal_data.find_personal_data(df).collect()
    assert len(got) == len(rows) + 2
    want = plain_found([*texts, texts[0]])
    for r in got:
        spans = [tuple(s) for s in r.spans]
        if r.doc_id is not None:
            assert spans == want[r.doc_id], (texts[r.doc_id], spans)
            assert [tuple(s) for s in r.base] == plain_spans(texts[r.doc_id])
    found = {texts[r.doc_id][s.start:s.end]: s.kind for r in got if r.doc_id is not None for s in r.spans if s.kind >= 4}
    assert found["555-0177-311"] == 7 and found["somebody1@localhost"] == 4
    assert found["999-111-2222"] == 7
    assert not any(re.fullmatch("[0-9]{8}", v) for v in found)


def test_nothing_to_go_on(spark):
    df = spark.createDataFrame([(1, "see 12345678 there"), (2, "")], "doc_id long, text string")
    assert [tuple(r) for r in personal_data.find_personal_data(df).orderBy("doc_id").collect()] == [(1, [], []), (2, [], [])]
    assert personal_data.find_personal_data(df.limit(0)).count() == 0


def test_query(spark, small):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = QUERIES["op11_personal_data"][0](spark, small).collect()
    assert len(got) == len(rows)

    def named(spans):
        return ",".join(f"{(personal_data.KINDS + personal_data.LIKE)[k]}:{s}:{e}" for s, k, e in spans)
    want = dict(zip(rows, plain_found(list(rows.values()))))
    for r in got:
        base = plain_spans(rows[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for _, k, _ in base) for n in range(4))
        assert r.base_sha256 == hashlib.sha256(named(base).encode()).hexdigest()
        assert r.spans == named(want[r.doc_id])
