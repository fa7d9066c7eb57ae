"""Periodic runs of words: string synchronising sets at dyadic scales propose periods.

A run is a stretch of words with smallest period q, at least three times as long as q, that no
neighbouring word extends. For every scale t (a power of two) the words are sampled: a position is
chosen if it or the position t later has the smallest hash of t words among all t + 1 positions
between them, leaving out positions that begin t words of a period up to t / 3. The choice depends
on the 2t words that follow and on nothing else, so two places with equal 2t words are chosen
alike, and any t neighbours hold a chosen position unless the words around them have such a small
period. A run of period q in [3t/2, 3t) therefore holds a chosen position that occurs again q words
later with equal context: pairs of equal contexts that far apart propose q, and common extensions
to both sides give the run. Chosen positions of equal context are more than t / 3 apart, so each
has at most nine partners. Periods that a scale leaves out are known from the scales below; the
smallest ones (up to 8 words) are found directly, by comparing the words with themselves shifted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetlens.llm.tables import arrow_map
from fleetlens.llm.words import find_words, mix, powers, slices, text_bytes

LEAST, TIMES = 24, 3     # words of a run, and its length in periods
SMALL = 8                # periods up to here are looked for directly
FIRST_SCALE = 4          # its periods begin below SMALL
_BASE = 0xD1342543DE82EF95
_TOP = np.uint64(2**64 - 1)
JOINED_WORDS = 1 << 16


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every stretch of true values."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edge[::2], edge[1::2]


def covered(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of ``n`` positions lie in some range first[i]:last[i]."""
    change = np.bincount(first, minlength=n + 1) - np.bincount(last, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every ``width`` neighbours, from running minima of blocks to both sides."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, _TOP)
    padded[:len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


class Extensions:
    """Common extensions of places of equal words, by hashes of prefixes."""

    def __init__(self, words: np.ndarray, hashes: np.ndarray):
        self.words = words
        self.power = powers(_BASE, len(words) + 1)
        self.prefix = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(hashes * self.power[:-1], out=self.prefix[1:])

    def _common(self, at: np.ndarray, gap: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from ``at`` (before it, if ``back``) equal those ``gap`` later."""
        low, high = np.zeros(len(at), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            a, b = (at - mid, at) if back else (at, at + mid)
            same = ((self.prefix[b] - self.prefix[a]) * self.power[gap]
                    == self.prefix[b + gap] - self.prefix[a + gap])
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def runs(self, at: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, ...]:
        """(begin, end, period) of the longest stretch of period ``gap`` around each place, checked on words."""
        begin = at - self._common(at, gap, at, True)
        end = at + gap + self._common(at, gap, len(self.words) - at - gap, False)
        keep = end - begin >= TIMES * gap
        found, one = np.unique(np.stack([begin[keep], end[keep], gap[keep]]), axis=1, return_index=True)
        at = at[keep][one]
        for i, (b, e, p) in enumerate(found.T.tolist()):
            if not np.array_equal(self.words[b:e - p], self.words[b + p:e]):  # equal hashes of other words
                found[:2, i] = self._exact(int(at[i]), p)
        return found[0], found[1], found[2]

    def _exact(self, at: int, gap: int) -> tuple[int, int]:
        same = self.words[:-gap] == self.words[gap:]
        gaps = np.flatnonzero(~same)
        i = int(np.searchsorted(gaps, at))
        return (int(gaps[i - 1]) + 1 if i else 0), (int(gaps[i]) if i < len(gaps) else len(same)) + gap


def find_runs(words: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(begin, end, smallest period) of all runs of several texts put one behind the other.

    ``words`` are numbers below len(words), equal for equal words; ``lengths`` fall, and behind
    every text stands a number of its own, so that no run reaches from one text into the next.
    """
    begins, ends, periods = [], [], []  # stretches of a period, at least three times as long

    def note(b: np.ndarray, e: np.ndarray, p: np.ndarray) -> None:
        begins.append(b)
        ends.append(e)
        periods.append(p)
    for p in range(1, min(SMALL, len(words) - 1) + 1):
        b, e = stretches(words[p:] == words[:-p])
        e = e + p
        keep = e - b >= max(FIRST_SCALE, TIMES * p)
        note(b[keep], e[keep], np.full(int(keep.sum()), p))
    stops = np.cumsum(lengths + 1)
    longest = int(lengths.max(initial=0))
    t, extend = FIRST_SCALE, None
    if 3 * t // 2 <= longest // TIMES:
        hashes = mix(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        extend = Extensions(words, hashes)
        level, width = hashes, 1
    while 3 * t // 2 <= longest // TIMES:
        # texts too short for a period of this scale stand at the end
        n = int(stops[np.searchsorted(-lengths, -(TIMES * 3 * t // 2), "right") - 1])
        while width < t:
            level = _doubled(level, width)
            width *= 2
        level = level[:n - t + 1]
        double = _doubled(level, t)
        begin, end, period = (np.concatenate(x) for x in (begins, ends, periods))
        known = (period <= t // 3) & (end - begin >= t) & (end <= n)
        order = level.copy()
        order[covered(len(order), begin[known], end[known] - t + 1)] = _TOP
        least_of = window_min(order, t + 1)[:len(double)]
        chosen = np.flatnonzero((least_of != _TOP) & (
            (order[:len(least_of)] == least_of) | (order[t:t + len(least_of)] == least_of)))
        context = double[chosen]
        by = np.argsort(context, kind="stable")
        chosen, context = chosen[by], context[by]
        at, gap = [], []
        step = 1
        while step < len(chosen):
            near = np.flatnonzero(context[step:] == context[:-step])
            far = chosen[near + step] - chosen[near]
            near, far = near[far < 3 * t], far[far < 3 * t]
            if not len(near):
                break
            wide = far >= max(3 * t // 2, SMALL + 1)
            at.append(chosen[near[wide]])
            gap.append(far[wide])
            step += 1
        if at:
            note(*extend.runs(np.concatenate(at), np.concatenate(gap)))
        t *= 2
    begin, end, period = (np.concatenate(x) for x in (begins, ends, periods))
    keep = end - begin >= np.maximum(least, TIMES * period)
    begin, end, period = begin[keep], end[keep], period[keep]
    order = np.lexsort((period, end, begin))  # multiples of a period give the same stretch
    begin, end, period = begin[order], end[order], period[order]
    first = np.r_[True, (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])] if len(begin) else np.zeros(0, bool)
    begin, end, period = begin[first], end[first], period[first]
    order = np.lexsort((period, begin))
    return begin[order], end[order], period[order]


def _doubled(level: np.ndarray, width: int) -> np.ndarray:
    """Hashes of 2 * width words from those of width words; never the reserved top value."""
    left, right = level[:max(0, len(level) - width)], level[width:]
    return np.minimum(mix(left * np.uint64(_BASE) + mix(right)), _TOP - np.uint64(1))


def _texts(batch: pa.Array, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """For each text: number of words, runs (begin, end, period; words counted from 0) and its kept words."""
    buf, at = text_bytes(batch)
    for lo, hi in slices(at):
        w = find_words(buf, at[lo:hi + 1])
        size = np.diff(w.first)
        order = np.argsort(-size, kind="stable")
        lengths = size[order]
        starts = np.r_[0, np.cumsum(lengths + 1)]
        # put the texts in falling length, each followed by a number of its own
        place = np.empty(len(size), np.int64)
        place[order] = starts[:-1]
        _, number = np.unique(w.hash, return_inverse=True)
        joined = np.zeros(int(starts[-1]), np.int64)
        joined[starts[1:] - 1] = len(number) + np.arange(len(size))
        joined[np.arange(len(number)) + np.repeat(place - w.first[:-1], size)] = number
        begin, end, period = find_runs(joined, lengths, least)
        gone = covered(len(joined), begin + period, end)
        for i in range(hi - lo):
            mine = slice(*np.searchsorted(begin, (place[i], place[i] + size[i])))
            a, b = int(w.first[i]), int(w.first[i + 1])
            kept = np.flatnonzero(~gone[place[i]:place[i] + size[i]]) + a
            yield (b - a, begin[mine] - place[i], end[mine] - begin[mine], period[mine],
                   joined_words(buf, w.start[kept], w.end[kept]))


def joined_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The words ``buf[start:end]`` with one space between them."""
    parts = []
    for lo in range(0, len(start), JOINED_WORDS):
        s, e = start[lo:lo + JOINED_WORDS], end[lo:lo + JOINED_WORDS]
        size = e - s + 1
        out = np.cumsum(size)
        where = np.arange(out[-1]) + np.repeat(s - (out - size), size)
        where[out - 1] = 0
        piece = buf[where]
        piece[out - 1] = 32
        parts.append(piece[:-1].tobytes())
    return b" ".join(parts)


def periodic_runs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``documents`` (doc_id, text).

    Words are runs of characters other than blank and \\x09-\\x0D. ``runs`` is an array of (start,
    length, period), in words, by start, then period: all stretches with smallest period ``period``
    of at least ``least`` words and three periods. ``collapsed`` is the words that no run contains
    after its first period, joined by one space. Null and empty texts have no words, no runs and an
    empty ``collapsed``; rows with null or repeated ids are rows of their own; other columns are
    ignored, and an empty table gives an empty result. Equal words are found by 64-bit hashes.
    """
    fields = [pa.field(c, pa.int64()) for c in ("start", "length", "period")]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n_words, texts, counts, spans = [], [], [], []
        for n, begin, length, period, kept in _texts(b.column("text"), least):
            n_words.append(n)
            texts.append(kept)
            counts.append(len(begin))
            spans.append(np.stack([begin, length, period]))
        flat = np.concatenate(spans, axis=1).astype(np.int64)
        runs = pa.ListArray.from_arrays(
            pa.array(np.r_[0, np.cumsum(counts)], pa.int32()),
            pa.StructArray.from_arrays([pa.array(x) for x in flat], fields=fields))
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n_words, pa.int64()), runs, pa.array(texts, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"])
    rows = documents.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, run, f"doc_id {kind}, n_words bigint, "
                     "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
