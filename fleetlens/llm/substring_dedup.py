"""Removal of long word sequences that occur more than once, by recompression.

A text is parsed in rounds. First runs of equal words, then in each round pairs of neighbouring
symbols become new symbols; a pair merges if the first symbol lies in the round's left half of
the alphabet and the second in the right half. Names are 64-bit hashes of what they stand for, so
they are global without a table: equal sequences get equal symbols wherever the choice does not
depend on what lies around them. For every symbol the stretch of words that decided it (its
reach) is tracked, so a window of words knows which symbols every equal window has too. Each
window is filed under the longest such symbol (its anchor), or under itself if it has none.

Spark counts the anchors of the whole corpus. Windows under an anchor that occurs once occur
once; the others are compared as whole blocks (all windows of one anchor), and only blocks that
share their anchor with a different block are compared window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.tables import arrow_map, bit_table, in_bits
from fleetlens.llm.words import Words, find_words, mix, powers, slices, text_bytes
from fleetlens.session import durable

ROUNDS = 4
PIECE_WORDS = 400_000   # longer texts are parsed in pieces that overlap by a window
FAR = 1 << 40           # a reach beyond the text
_SIDES = np.random.default_rng(3).integers(1, 2**63, ROUNDS, dtype=np.uint64)
_A, _B, _RUN, _SELF = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_MULT = 0x2545F4914F6CDD1D
_POW: np.ndarray = powers(_MULT, 1)
_INV: np.ndarray = powers(pow(_MULT, -1, 2**64), 1)


def _tables(n: int) -> None:
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << n.bit_length()
        _POW, _INV = powers(_MULT, size), powers(pow(_MULT, -1, 2**64), size)


class RangeHash:
    """Hash of any range of words in constant time."""

    def __init__(self, words: np.ndarray):
        _tables(len(words) + 1)
        self.total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * _POW[:len(words)], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * _INV[start] + (end - start).astype(np.uint64) * _SELF)


def parse(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """Symbols after all rounds: name, start, end, and the reach (first word, word after the last).

    ``text`` numbers the text of each word; symbols stay inside a text, and what depends on a
    text's edge has a reach beyond it.
    """
    n = len(words)
    same = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    head = np.ones(n, bool)
    head[1:] = ~same
    start = np.flatnonzero(head)
    end = np.append(start[1:], n)
    length = end - start
    name = np.where(length > 1, mix(words[start] * _A + length.astype(np.uint64) * _RUN), words[start])
    own = text[start]
    inner = own[1:] == own[:-1]
    # a run, or being alone, is decided by one word on each side
    low, high = np.full(len(start), -FAR), np.full(len(start), FAR)
    low[1:][inner] = start[1:][inner] - 1
    high[:-1][inner] = end[:-1][inner] + 1
    for side in _SIDES:
        if len(name) < 2:
            break
        left = (mix(name ^ side) >> np.uint64(63)).astype(bool)
        inner = own[1:] == own[:-1]
        pair = left[:-1] & ~left[1:] & inner
        first = np.append(pair, False)
        second = np.append(False, pair)
        alone = ~first & ~second
        # alone: a left symbol because of what follows, a right symbol because of what precedes
        after = np.append(np.where(inner, high[1:], FAR), FAR)
        before = np.append(-FAR, np.where(inner, low[:-1], -FAR))
        new_high = np.where(alone & left, np.maximum(high, after), high)
        new_low = np.where(alone & ~left, np.minimum(low, before), low)
        k = np.flatnonzero(first)
        name = name.copy()
        name[k] = mix(name[k] * _A + name[k + 1] * _B)
        end = end.copy()
        end[k] = end[k + 1]
        new_low[k] = np.minimum(low[k], low[k + 1])
        new_high[k] = np.maximum(high[k], high[k + 1])
        keep = ~second
        name, start, end, own, low, high = name[keep], start[keep], end[keep], own[keep], new_low[keep], new_high[keep]
    return name, start, end, low, high


def blocks(words: np.ndarray, text: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Windows filed under anchors: key, block hash, first window and number of windows of each block."""
    n = len(words)
    starts = np.flatnonzero(text[:n - window + 1] == text[window - 1:]) if n >= window else np.zeros(0, np.int64)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z
    hashed = RangeHash(words)
    name, start, end, low, high = parse(words, text)
    usable = np.flatnonzero((low > -FAR) & (high < FAR) & (high - low <= window))
    best = np.full(len(starts), -1, np.int64)
    if len(usable):
        name, start, end, low, high = (x[usable] for x in (name, start, end, low, high))
        # reaches ascend with the symbols; make sure, so that ranges of symbols are exact
        a = np.searchsorted(np.minimum.accumulate(low[::-1])[::-1], starts)
        b = np.searchsorted(np.maximum.accumulate(high), starts + window, "right")
        bits = max(1, int(len(name)).bit_length())
        rank = ((np.minimum(end - start, 63).astype(np.uint64) << np.uint64(58))
                | ((mix(name) >> np.uint64(6 + bits)) << np.uint64(bits))
                | np.arange(len(name), 0, -1, dtype=np.uint64))
        top = [rank]
        while 2 << (len(top) - 1) <= window and len(top[-1]) > 1 << (len(top) - 1):
            half = 1 << (len(top) - 1)
            top.append(np.maximum(top[-1][:-half], top[-1][half:]))
        size = b - a
        for k, t in enumerate(top):
            q = np.flatnonzero((size >> k == 1) if k + 1 < len(top) else (size >> k >= 1))
            if len(q):
                value = np.maximum(t[a[q]], t[b[q] - (1 << k)])
                best[q] = len(name) - (value & np.uint64((1 << bits) - 1)).astype(np.int64)
    alone = best < 0
    anchor = np.where(alone, -1 - starts, best)
    cut = np.ones(len(starts), bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)
    at = np.flatnonzero(cut)
    count = np.diff(np.append(at, len(starts)))
    first, anchor = starts[at], anchor[at]
    key = hashed(first, first + window) ^ _SELF
    place = first.copy()
    some = np.flatnonzero(anchor >= 0)
    if len(some):
        s = anchor[some]
        key[some] = hashed(low[s], high[s])
        place[some] = start[s]
    whole = mix(hashed(first, first + count + window - 1) + (place - first).astype(np.uint64) * _A)
    return key, whole, first, count


def _pieces(w: Words, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Words, their text numbers and the place of the first word, for whole texts or parts of long ones."""
    lo, n = 0, len(w.first) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(w.first, w.first[lo] + PIECE_WORDS, "right")) - 1)
        a, b = int(w.first[lo]), int(w.first[hi])
        if hi - lo == 1:
            for x in range(a, b, PIECE_WORDS):
                y = min(b, x + PIECE_WORDS + window - 1)
                if y - x >= window:
                    yield w.hash[x:y], np.full(y - x, lo), x
        elif b > a:
            yield w.hash[a:b], np.repeat(np.arange(lo, hi), np.diff(w.first[lo:hi + 1])), a
        lo = hi


def _all_blocks(buf: np.ndarray, at: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """key, block hash, text number, first window (in its text), windows."""
    for lo, hi in slices(at):
        w = find_words(buf, at[lo:hi + 1])
        for words, text, begin in _pieces(w, window):
            key, whole, first, count = blocks(words, text, window)
            if len(key):
                doc = text[first]
                yield key, whole, doc + lo, first + begin - w.first[doc], count


def _keys(window: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [x[0] for x in _all_blocks(*text_bytes(batch.column(0)), window)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["key"]) if found else None
    return run


def _live_blocks(bits: np.ndarray, window: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = []
        for x in _all_blocks(*text_bytes(batch.column(2)), window):
            live = in_bits(bits, x[0])
            parts.append(tuple(v[live] for v in x))
        if not parts:
            return None
        key, whole, doc, first, count = (np.concatenate(x) for x in zip(*parts))
        take = pa.array(doc)
        return pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take),
             pa.array(first.astype(np.int64)), pa.array(count.astype(np.int64))], ["key", "whole", "doc_id", "text_hash", "first", "windows"])
    return run


def _packed_texts(bits: np.ndarray, summary: bool):
    """Texts whose hash is in the bit table, compressed; with ``summary`` also what is known of all texts."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        buf, at = text_bytes(batch.column(2))
        wanted = in_bits(bits, batch.column(1).to_numpy().view(np.uint64))
        pack = zstandard.ZstdCompressor(level=3)
        packed = [pack.compress(buf[a:b].tobytes()) if y else None for a, b, y in zip(at, at[1:], wanted)]
        if not summary:
            keep = pa.array(np.flatnonzero(wanted))
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(keep), batch.column(1).take(keep), pa.array([p for p in packed if p is not None], pa.binary())],
                ["doc_id", "text_hash", "packed"])
        words = [buf[a:b].tobytes().split() for a, b in zip(at, at[1:])]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array([len(w) for w in words], pa.int64()),
             pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words])],
            ["doc_id", "text_hash", "packed", "n_words", "sha256"])
    return run


def _windows(window: int):
    """Window hashes of the blocks listed with a text."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        unpack = zstandard.ZstdDecompressor()
        doc, spot, hashes, single = [], [], [], []
        for i, (packed, listed) in enumerate(zip(batch.column("packed").to_pylist(), batch.column("blocks").to_pylist())):
            raw = np.frombuffer(unpack.decompress(packed), np.uint8)
            hashed = RangeHash(find_words(raw, np.array([0, len(raw)])).hash)
            for b in listed:
                s = np.arange(b["first"], b["first"] + b["windows"])
                doc.append(np.full(len(s), i))
                spot.append(s)
                hashes.append(hashed(s, s + window))
                single.append(np.full(len(s), b["n"] == 1))
        if not doc:
            return None
        take = pa.array(np.concatenate(doc))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(single)), batch.column("doc_id").take(take),
             batch.column("text_hash").take(take), pa.array(np.concatenate(spot))], ["hash", "single", "doc_id", "text_hash", "first"])
    return run


def kept_words(words: list[bytes], ranges: list[tuple[int, int]]) -> list[bytes]:
    gone = np.zeros(len(words) + 1, np.int64)
    for a, b in ranges:
        gone[a] += 1
        gone[b] -= 1
    return [w for w, g in zip(words, np.cumsum(gone[:-1])) if g == 0]


def _result(with_text: bool):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpack = zstandard.ZstdDecompressor()
        removed, sha, texts = [], [], []
        rows = zip(batch.column("packed").to_pylist(), batch.column("ranges").to_pylist(), batch.column("sha256").to_pylist(),
                   batch.column("n_words").to_pylist())
        for packed, ranges, known, n in rows:
            if ranges is None and not with_text:
                removed.append(0)
                sha.append(known)
                texts.append(None)
                continue
            words = kept_words(unpack.decompress(packed).split(), [(r["a"], r["b"]) for r in ranges or []])
            text = b" ".join(words)
            removed.append(n - len(words))
            sha.append(hashlib.sha256(text).hexdigest())
            texts.append(text.decode() if with_text else None)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()),
             pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])
    return run


def repeated_ranges(docs: DataFrame, window: int) -> tuple[DataFrame, np.ndarray]:
    """Word ranges covered by repeated windows, (doc_id, text_hash, a, b), and a bit table of text hashes."""
    live = durable(arrow_map(docs.select("text"), _keys(window), "key long").groupBy("key").count().filter("count > 1").select("key"))
    found = durable(arrow_map(docs, _live_blocks(bit_table(live, "key"), window),
                              "key long, whole long, doc_id long, text_hash long, first long, windows long"))
    kinds = found.groupBy("key", "whole").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "first", "windows")).alias("one"))
    kinds = durable(kinds)
    per_key = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 AND least = 1")
    open_blocks = (kinds.join(per_key.select("key"), "key")
                   .groupBy("one.doc_id", "one.text_hash").agg(F.collect_list(F.struct("one.first", "one.windows", "n")).alias("blocks")))
    open_blocks = durable(open_blocks)
    texts = arrow_map(docs, _packed_texts(bit_table(open_blocks, "text_hash"), False), "doc_id long, text_hash long, packed binary")
    texts = texts.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash"))
    # a repeated row carries the same blocks; one copy is enough
    listed = texts.join(open_blocks, same).select("doc_id", "text_hash", "packed", "blocks")
    rows = durable(arrow_map(listed, _windows(window), "hash long, single boolean, doc_id long, text_hash long, first long")
                   .groupBy("hash", "single", "doc_id", "text_hash", "first").agg(F.lit(1).alias("one")).drop("one"))
    twice = rows.groupBy("hash").count().filter("count > 1").select("hash")
    part = rows.filter("single").join(twice, "hash").select("doc_id", "text_hash", F.col("first").alias("a"), (F.col("first") + window).alias("b"))
    whole = found.join(kinds.filter("n > 1").select("key", "whole"), ["key", "whole"]).select(
        "doc_id", "text_hash", F.col("first").alias("a"), (F.col("first") + F.col("windows") + window - 1).alias("b"))
    ranges = durable(whole.union(part).distinct().groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("a", "b")).alias("ranges")))
    return ranges, bit_table(ranges, "text_hash")


def remove_repeats(documents: DataFrame, window: int = 50, with_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text`` for every row of ``documents`` (doc_id, text).

    Words are runs of characters other than blank and \\x09-\\x0D. Every word in a window of
    ``window`` words whose sequence also starts anywhere else, in the same or another row, is
    removed; all windows are judged on the input. ``kept_text`` joins the kept words by one blank
    (null without ``with_text``), ``kept_sha256`` is its hash.

    A null or empty text has no words and an empty kept text. Rows with the same doc_id and text
    count as two texts, so they lose all their windows. A null doc_id stays null, other columns
    are not read, an empty table gives an empty result.
    """
    docs = documents.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("text_hash"), "text")
    ranges, bits = repeated_ranges(docs, window)
    if with_text:
        bits = np.full(1, 2**64 - 1, np.uint64)
    texts = arrow_map(docs, _packed_texts(bits, True), "doc_id long, text_hash long, packed binary, n_words long, sha256 string")
    named = ranges.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash"))
    return arrow_map(texts.join(named, same, "left").select("doc_id", "packed", "n_words", "sha256", "ranges"), _result(with_text),
                     "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
