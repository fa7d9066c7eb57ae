"""Secrets in texts: a trigram index proposes documents, rules verify them.

Each rule's regex is turned into a Boolean query over lower-case trigrams that every match must
contain (an OR of ANDs). The index holds one posting (trigram, document) for each trigram that
some query mentions; postings are intersected per alternative, and only the candidates of a rule
are searched with its regex. A rule without mandatory trigrams is searched in every document.
DataFrame functions only; span positions are code points.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.tables import free_names

MAX_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` (syntax common to Java and Python); a match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# A private key reaches from its BEGIN line to the matching END line if only the key can be between
# them (no other run of five dashes). Else it reaches over header lines to the last line of base64;
# a short one counts as the last if it stands alone on its line. Lines may be quoted or escaped as in JSON.
# Possessive repeats never go back, so a text is read a fixed number of times.
_BREAK = r"""(?:[ \t\r\n>"',]|\\+[nrt])"""
_LINE = r"""[ \t"',]*+(?:\r?\n|(?:\\+r)?\\+n)[ \t>"',]*+"""
_PRIVATE = (r"-----BEGIN ((?:[A-Z]+ )*)PRIVATE KEY-----(?:"
            r"[^-]*+(?:-(?!----)[^-]*+)*+-----END \1PRIVATE KEY-----|"
            rf"(?:(?:{_LINE}[A-Za-z][A-Za-z0-9-]*+: [^\r\n\\]*+)*+(?:{_BREAK}++[A-Za-z0-9+/]{{20,}}+={{0,2}})++"
            rf"""(?:{_LINE}[A-Za-z0-9+/]++={{0,2}}(?=[ \t\r\n"',\\]|$))?)?)""")

# fixed values: the first three kinds are given, the others add well-known key formats.
# A run of hex digits or of access key characters is matched whole, so a length within the
# pattern finds what a filter behind it would leave.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private", _PRIVATE),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
BASE = 3  # rules at the front that make up the base result


def _paths(parsed) -> list[list[str]] | None:
    """Alternatives of a regex, each a list of literals any match contains; "" marks a gap."""
    out: list[list[str]] = [[""]]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            nexts = [[chr(arg).lower()]]
        elif name == "IN" and len(arg) <= 8 and all(str(o) == "LITERAL" for o, _ in arg):
            nexts = [[c] for c in sorted({chr(a).lower() for _, a in arg})]
        elif name == "SUBPATTERN":
            nexts = _paths(arg[3])
        elif name == "BRANCH":
            parts = [_paths(p) for p in arg[1]]
            nexts = None if None in parts else [x for p in parts for x in p]
        elif name == "MAX_REPEAT" and arg[:2] == (0, 1):
            inner = _paths(arg[2])
            nexts = None if inner is None else [[""]] + inner
        elif name == "MAX_REPEAT" and arg[0] > 0:
            inner = _paths(arg[2]) if arg[0] == 1 else None
            nexts = [["", "", *x, "", ""] for x in inner] if inner else [["", "", ""]]
        elif name == "AT":
            nexts = [[""]]
        else:
            nexts = [["", "", ""]]
        if nexts is None:
            return None
        if len(out) * len(nexts) > MAX_ALTERNATIVES:
            nexts = [["", "", ""]]  # asking for less is always safe
        # the last literal so far goes on with the first of what follows
        out = [[*a[:-1], a[-1] + b[0], *b[1:]] for a in out for b in nexts]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """OR of ANDs over lower-case trigrams that every match contains; None: nothing is mandatory."""
    paths = _paths(re._parser.parse(pattern))
    if paths is None:
        return None
    query = {frozenset(s[i:i + 3] for s in p for i in range(len(s) - 2)) for p in paths}
    query = {q for q in query if not any(other < q for other in query)}  # a longer alternative adds nothing
    return None if frozenset() in query else sorted(query, key=sorted)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sums(a: Column) -> Column:
    return F.aggregate(a, F.array().cast("array<bigint>"), lambda acc, x: F.concat(
        acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint")) + x)))


def running_sums(a: Column) -> Column:
    """Running sums of an array, in blocks of about its root, so n values cost n ** 1.5."""
    def blocks(v: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int"))),
                          lambda b: _sums(F.slice(v, b * width + 1, width)))
        return _let(cut, lambda c: F.flatten(F.zip_with(
            c, F.slice(F.concat(F.array(F.lit(0).cast("bigint")),
                                _sums(F.transform(c, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0).cast("bigint"))))),
                       1, F.size(c)),
            lambda p, before: F.transform(p, lambda x: x + before))))
    return _let(a, blocks)


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Spans (start, number, end) of a rule's matches, leftmost and without overlap."""
    def placed(v: Column) -> Column:
        # what lies between matches, the matches, and the part of each that counts
        triples = F.arrays_zip(F.transform(v.gaps, F.char_length).alias("gap"), F.transform(v.hits, F.char_length).alias("hit"),
                               F.transform(v.parts, F.char_length).alias("part"))
        ends = running_sums(F.transform(triples, lambda t: (t.gap + F.coalesce(t.hit, F.lit(0))).cast("bigint")))
        return F.transform(
            F.filter(F.zip_with(triples, ends, lambda t, e: F.struct(t.hit.alias("hit"), t.part.alias("part"), e.alias("end"))),
                     lambda t: t.part >= rule.least),
            lambda t: F.struct((t.end - t.hit).alias("start"), F.lit(number).alias("kind"), t.end.alias("end")))
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, 0)
    parts = hits if rule.group == 0 else F.regexp_extract_all(text, pattern, rule.group)
    value = F.struct(F.split(text, rule.pattern, -1).alias("gaps"), hits.alias("hits"), parts.alias("parts"))
    return F.when(text.rlike(rule.pattern), _let(value, placed)).otherwise(
        F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))


def secret_candidates(documents: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``doc_id, text_hash, numbers``: the rules whose trigram query a text fulfils."""
    queries = [(n, q) for n, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None]
    grams = sorted({g for _, q in queries for alt in q for g in alt})
    found = _let(F.lower("text"), lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in grams])))
    postings = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(found).alias("gram")).distinct()
    terms = [F.struct(F.lit(n).alias("number"), F.lit(a).alias("alternative"), F.lit(g).alias("gram"), F.lit(len(alt)).alias("grams"))
             for n, q in queries for a, alt in enumerate(q) for g in sorted(alt)]
    terms = documents.sparkSession.range(1).select(F.inline(F.array(*terms)))  # as long as the rules
    return (postings.join(F.broadcast(terms), "gram").groupBy("doc_id", "text_hash", "number", "alternative", "grams")
            .count().filter("count = grams")
            .groupBy("doc_id", "text_hash").agg(F.collect_set("number").alias("numbers")))


def find_secrets(documents: DataFrame, rules: Sequence[Rule] = RULES, column: str = "secret_spans") -> DataFrame:
    """All columns of ``documents`` (doc_id, text, ...) and ``column``, an array of (start, kind, end).

    ``kind`` is the rule's place in ``rules``; spans are sorted by start, then kind. A null or
    empty text has no spans. Rows with a null doc_id and repeated rows are treated like all
    others and stay as they are; a column of the input called ``column`` is replaced, others stay,
    whatever they are called. An empty table gives an empty result.
    """
    a, b, n_rules = free_names(documents, "_doc", "_hash", "_numbers")
    found = secret_candidates(documents, rules).select(
        F.col("doc_id").alias(a), F.col("text_hash").alias(b), F.col("numbers").alias(n_rules))
    joined = documents.join(found, F.col("doc_id").eqNullSafe(F.col(a)) & (F.xxhash64("text") == F.col(b)), "left")
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    spans = [_spans(text, r, n) if trigram_query(r.pattern) is None
             else F.when(F.array_contains(n_rules, F.lit(n)), _spans(text, r, n)).otherwise(none)
             for n, r in enumerate(rules)]
    return joined.withColumn(column, F.array_sort(F.concat(*spans))).drop(a, b, n_rules)


def count_kind(spans: Column, number: int) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == number)).cast("long")


def spans_text(spans: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def redact(documents: DataFrame, mark: str = "[REDACTED]", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``documents`` with every secret replaced by ``mark``; spans that overlap become one.

    Texts without a secret, null and empty texts stay as they are; columns and rows too, also a
    column ``secret_spans``. Rows that repeat an id or have none are masked each by its own text.
    """
    name = free_names(documents, "secret_spans")[0]
    hit = F.col(name)
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    merged = F.aggregate(hit, empty, lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)).end > s.start),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.try_element_at(acc, F.lit(-1)).start.alias("start"),
            F.greatest(F.try_element_at(acc, F.lit(-1)).end, s.end).alias("end")))))
        .otherwise(F.concat(acc, F.array(F.struct(s.start.alias("start"), s.end.alias("end"))))))
    def cut(v: Column) -> Column:
        starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(v, lambda s: s.end))
        ends = F.concat(F.transform(v, lambda s: s.start), F.array(F.char_length("text").cast("bigint")))
        return F.array_join(F.zip_with(starts, ends, lambda a, b: F.substr(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))), mark)
    found = find_secrets(documents, rules, name)
    return found.withColumn("text", F.when(F.size(hit) > 0, _let(merged, cut)).otherwise(F.col("text"))).select(*documents.columns)
