"""Personal data by bootstrapped contextual extraction.

Rules find e-mail and IP addresses, card and phone numbers; these are the seeds. A pattern is what
stands around an identifier: its kind of context and the words there ("mail me at _", "card _
expires"). A pattern's confidence is the share of all places in the corpus with these words, whatever
stands in between, that are held by known identifiers; a pattern needs several different ones.
Other strings that look like identifiers are instances; patterns of high confidence vouch for the
instances they surround, those that are believed count as known identifiers in the next round, and
so further patterns come up. Spark scores this graph of patterns and instances round by round; every
occurrence of a believed instance is added to the spans of the rules, which stay as they are.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.tables import MAX_BITS, SMALL_ROWS, arrow_map, bit_table, in_bits
from fleetlens.llm.words import find_words, mix, slices, text_bytes
from fleetlens.session import durable

# fixed values: the kinds of the rules in the order in which spans of one start are listed;
# a string found by context has the kind of the identifiers it stands among, marked as like them
KINDS = ("email", "ip", "card", "phone")
LIKE = tuple(f"like_{k}" for k in KINDS)
SUPPORT = 3        # different known identifiers that a pattern needs
CONFIDENCE = 0.8   # share of a pattern's places that known identifiers must hold
ROUNDS = 4
SCALE = 1_000_000  # scores are added as whole numbers, so that their order does not matter

# context words: everything but white space and the marks that join a name with its value
CONTEXT_BYTE = np.ones(256, bool)
CONTEXT_BYTE[9:14] = False
CONTEXT_BYTE[[ord(c) for c in " :=\"'`<>()[]{},;|"]] = False

# fixed values: the given rules. Digits are taken in whole chains, from which the matches follow,
# and an address around its @, so that no text is read more than a fixed number of times.
_AT = re.compile("@")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]++(?:[\x20./-][0-9]++)*+")
_CODE = re.compile(r"[A-Za-z0-9@._%+/-]++")
_LUHN = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
MIN_DIGITS, MAX_DIGITS = 7, 19     # of a number that may be an identifier
MIN_CODE, MAX_CODE = 6, 64         # characters of a code that may be one


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(_LUHN[v] for v in values[1::2])) % 10 == 0


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all matches of the rules, by start, then kind."""
    out = []
    after = 0
    for m in _AT.finditer(text):
        before = text[after:m.start()]
        after = m.end()
        local = len(before) - len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, m.end()) if local else None
        if domain:
            out.append((m.start() - local, 0, domain.end()))
            after = domain.end()
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                out.append((at, 1, end))
            at = end + 1
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def other_spans(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of strings that look like identifiers and touch no known one, without overlap."""
    found = []
    for m in _NUMBER.finditer(text):
        if MIN_DIGITS <= sum(c.isdigit() for c in m.group()) <= MAX_DIGITS:
            found.append((m.start(), m.end()))
    for m in _CODE.finditer(text):
        code = m.group().strip("._%+/-")
        if MIN_CODE <= len(code) <= MAX_CODE and ("@" in code or (
                sum(c.isdigit() for c in code) >= 4 and any(c.isalpha() for c in code))):
            start = text.index(code, m.start())
            found.append((start, start + len(code)))
    out, taken = [], [(s, e) for s, _, e in known]
    for s, e in sorted(found, key=lambda x: (x[0], -x[1])):
        if not (out and s < out[-1][1]):
            out.append((s, e))
    if not taken:
        return out
    starts = np.array([s for s, _ in taken])
    reach = np.maximum.accumulate([e for _, e in taken])
    kept = []
    for s, e in out:
        i = int(np.searchsorted(starts, e)) - 1
        if i < 0 or reach[i] <= s:
            kept.append((s, e))
    return kept


def context_hashes(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patterns of the places words[first:last + 1]: the two words before, and one to each side.

    ``words`` has two numbers in front of every text and behind it that stand for its edges.
    """
    before = mix(words[first - 2] * np.uint64(3) + mix(words[first - 1]))
    around = mix(words[first - 1] * np.uint64(5) + mix(words[last + 1] + np.uint64(7)))
    return before, around


def _edged(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with two edge marks around every text, and where the words of each text begin."""
    size = np.diff(first)
    place = first[:-1] + 2 + 4 * np.arange(len(size))
    out = np.full(len(hashes) + 4 * len(size), np.uint64(11))
    out[np.arange(len(hashes)) + np.repeat(place - first[:-1], size)] = hashes
    return out, place


def _may_hold(raw: np.ndarray) -> bool:
    return bool(((raw >= 48) & (raw <= 57)).any() or (raw == 64).any())


def find_mentions(documents: DataFrame) -> DataFrame:
    """``doc_id, base, others`` of every row: spans of the rules, and the strings that may be identifiers.

    ``others`` includes the rules' spans (kind 0 and up; -1: no rule) with a hash of their text and their patterns.
    """
    def of_text(text: str) -> tuple[list, list]:
        base = rule_spans(text)
        spans = [(s, e, k) for s, k, e in base] + [(s, e, -1) for s, e in other_spans(text, base)]
        if not spans:
            return base, []
        raw = text.encode()
        buf = np.frombuffer(raw, np.uint8)
        w = find_words(buf, np.array([0, len(raw)]), lower=True, chars=CONTEXT_BYTE)
        words, place = _edged(w.hash, w.first)
        start, end = (np.array([x[i] for x in spans]) for i in (0, 1))
        if len(raw) != len(text):  # places in the text to places in its bytes
            chars = np.flatnonzero((buf & 0xC0) != 0x80)
            chars = np.r_[chars, len(raw)]
            start, end = chars[start], chars[end]
        first = np.searchsorted(w.end, start, "right")
        last = np.searchsorted(w.start, end) - 1
        before, around = context_hashes(words, place[0] + first, place[0] + last)
        names = [xxhash.xxh64_intdigest(text[s:e].encode()) for s, e, _ in spans]
        rows = [{"start": s, "end": e, "kind": k, "value": v - 2**64 if v >= 2**63 else v, "patterns": [b, a]}
                for (s, e, k), v, b, a in zip(spans, names, before.view(np.int64).tolist(), around.view(np.int64).tolist())]
        return base, rows

    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    other = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("value", pa.int64()),
                       ("patterns", pa.list_(pa.int64()))])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        buf, at = text_bytes(b.column("text"))
        base, others = [], []
        for i in range(b.num_rows):
            raw = buf[at[i]:at[i + 1]]
            found = of_text(raw.tobytes().decode()) if _may_hold(raw) else ([], [])
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in found[0]])
            others.append(found[1])
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(base, pa.list_(span)), pa.array(others, pa.list_(other))], ["doc_id", "base", "others"])
    rows = documents.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, run, f"doc_id {kind}, base array<struct<start:bigint,kind:int,end:bigint>>, others "
                     "array<struct<start:bigint,end:bigint,kind:int,value:bigint,patterns:array<bigint>>>")


def context_counts(documents: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern, places``: how often the words of each pattern stand around a single word anywhere."""
    bits = bit_table(patterns, "pattern", MAX_BITS // 8)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        buf, at = text_bytes(b.column("text"))
        found = []
        for lo, hi in slices(at):
            w = find_words(buf, at[lo:hi + 1], lower=True, chars=CONTEXT_BYTE)
            words, place = _edged(w.hash, w.first)
            own = np.arange(len(w.hash)) + np.repeat(place - w.first[:-1], np.diff(w.first))
            for hashes in context_hashes(words, own, own):
                found.append(hashes[in_bits(bits, hashes)])
        value, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n, pa.int64())], ["pattern", "n"])
    return arrow_map(documents.select("text"), run, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("places"))


def _small(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it was counted and is short."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def believed(documents: DataFrame, mentions: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE,
             rounds: int = ROUNDS) -> DataFrame | None:
    """``value, kind``: strings that patterns vouch for; None if there is no pattern to begin with."""
    edges = mentions.select(F.explode("others").alias("m")).select("m.value", "m.kind", F.explode("m.patterns").alias("pattern"))
    edges = edges.groupBy("pattern", "value").agg(F.max("kind").alias("kind"), F.count("*").alias("n"))
    edges = durable(edges)
    # a pattern that will ever count has as many different values
    usable = edges.groupBy("pattern").agg(F.count("*").alias("values"), F.count_if(F.col("kind") < 0).alias("open")).filter(
        (F.col("values") >= support) & (F.col("open") > 0)).select("pattern")
    usable = durable(usable)
    if usable.isEmpty():
        return None
    counts = durable(context_counts(documents, usable))
    graph = edges.join(_small(usable), "pattern")
    seeds = durable(graph.filter("kind >= 0").groupBy("pattern", "kind").agg(
        F.count("*").alias("seeds"), F.sum("n").alias("held")))
    unknown = durable(graph.filter("kind < 0").select("pattern", "value", "n"))
    known, told = None, -1
    for _ in range(rounds):
        held = seeds
        if known is not None:
            more = unknown.join(_small(known), "value").groupBy("pattern", "kind").agg(
                F.count("*").alias("seeds"), F.sum("n").alias("held"))
            held = seeds.unionByName(more).groupBy("pattern", "kind").agg(
                F.sum("seeds").alias("seeds"), F.sum("held").alias("held"))
        # of several kinds of identifiers around one pattern the most frequent one counts
        best = held.groupBy("pattern").agg(F.max(F.struct("held", (-F.col("kind")).alias("order"), "seeds")).alias("b"))
        vouching = best.join(counts, "pattern").select(
            "pattern", (-F.col("b.order")).alias("kind"), "b.seeds",
            (F.col("b.held") / F.greatest("places", "b.held")).alias("share"))
        vouching = durable(vouching.filter((F.col("seeds") >= support) & (F.col("share") >= confidence)).select(
            "pattern", "kind", F.round(-F.log(F.greatest(F.lit(1e-6), 1 - F.col("share"))) * SCALE).cast("long").alias("weight")))
        # an instance is wrong only if all patterns around it are: independent chances multiply
        votes = unknown.join(_small(vouching), "pattern").groupBy("value", "kind").agg(F.sum("weight").alias("weight"))
        best = votes.groupBy("value").agg(F.max(F.struct("weight", (-F.col("kind")).alias("order"))).alias("b"))
        enough = round(-math.log(1 - confidence) * SCALE)
        known = durable(best.filter(F.col("b.weight") >= enough - 1).select("value", (-F.col("b.order")).alias("kind")))
        now = known.count()
        if now == told or not now:
            break
        told = now
    return known


def find_personal_data(documents: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE,
                       rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, base, spans`` of every row of ``documents`` (doc_id, text).

    ``base`` and ``spans`` are arrays of (start, kind, end) in code points, end exclusive, by start,
    then kind; kinds are places in ``KINDS + LIKE``. ``spans`` holds the base spans and those found by
    context, which touch no base span. Null and empty texts have no spans; rows with null or repeated
    ids are rows of their own; other columns are ignored; an empty table gives an empty result.
    """
    mentions = durable(find_mentions(documents).withColumn("row", F.monotonically_increasing_id()))
    names = believed(documents, mentions, support, confidence, rounds)
    if names is None or names.isEmpty():
        return mentions.select("doc_id", "base", F.col("base").alias("spans"))
    added = mentions.select("row", F.explode("others").alias("m")).filter("m.kind < 0").select("row", "m.*")
    added = added.join(_small(names.withColumnRenamed("kind", "like")), "value").groupBy("row").agg(F.collect_list(
        F.struct("start", (F.col("like") + len(KINDS)).cast("int").alias("kind"), "end")).alias("added"))  # spans of one text
    added = durable(added)
    joined = mentions.select("row", "doc_id", "base").join(_small(added), "row", "left")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return joined.select("doc_id", "base", spans.alias("spans"))


def spans_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS + LIKE])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")

