"""Words of whole texts as 64-bit hashes, computed over Arrow buffers without a Python loop.

A word is a run of characters other than blank and \\x09-\\x0D, which in UTF-8 are single bytes,
so words can be found and hashed on bytes. Equal words have equal hashes everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

PIECE = 1 << 17        # bytes hashed at once
LONG_WORD = 1 << 15    # words from here on are hashed one by one
_rng = np.random.default_rng(20240917)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[32, 9, 10, 11, 12, 13]] = False
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = powers(_BASE, PIECE + 1)
_INV = powers(pow(_BASE, -1, 2**64), PIECE + 1)


@dataclass
class Words:
    """Words of some texts: hash, byte span, and where each text's words begin (one entry more)."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset of each (one entry more); nulls are empty."""
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, at


def slices(at: np.ndarray, limit: int = 4 * PIECE) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` bytes; a larger text stands alone."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def find_words(buf: np.ndarray, at: np.ndarray, lower: bool = False, chars: np.ndarray = _WORD_BYTE) -> Words:
    """Words of the texts ``buf[at[i]:at[i + 1]]``; byte spans are positions in ``buf``.

    ``chars`` says which of the 256 bytes belong to words; those of multi-byte characters go together.
    """
    lo, hi = int(at[0]), int(at[-1])
    table = _BYTE_LOWER if lower else _BYTE
    hashes, starts, ends = [], [], []
    bounds = np.unique(at)
    while lo < hi:
        top = min(hi, lo + PIECE)
        part = buf[lo:top]
        inside = chars[part]
        if top < hi and inside[-1] and top not in at:  # do not cut a word
            gaps = np.flatnonzero(~inside)
            cuts = bounds[np.searchsorted(bounds, lo, "right"):np.searchsorted(bounds, top, "right")]
            cut = max(lo + int(gaps[-1]) + 1 if len(gaps) else lo, int(cuts[-1]) if len(cuts) else lo)
            if cut == lo:  # one word longer than a piece
                end = top
                stop = int(bounds[np.searchsorted(bounds, lo, "right")])
                while end < stop and chars[buf[end]]:
                    step = chars[buf[end:min(stop, end + PIECE)]]
                    end += int(np.argmin(step)) if not step.all() else len(step)
                hashes.append(np.array([_long(buf[lo:end], lower)], np.uint64))
                starts.append(np.array([lo]))
                ends.append(np.array([end]))
                lo = end
                continue
            top = cut
            part, inside = part[:top - lo], inside[:top - lo]
        edge = np.zeros(len(part) + 1, bool)
        cuts = bounds[np.searchsorted(bounds, lo):np.searchsorted(bounds, top, "right")] - lo
        edge[cuts] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        close = inside.copy()
        close[:-1] &= ~inside[1:] | edge[1:-1]
        s, e = np.flatnonzero(begin), np.flatnonzero(close) + 1
        if len(s):
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(table[part] * _POW[:len(part)], out=total[1:])
            h = mix((total[e] - total[s]) * _INV[s])
            for i in np.flatnonzero(e - s >= LONG_WORD):
                h[i] = _long(part[s[i]:e[i]], lower)
            hashes.append(h)
            starts.append(s + lo)
            ends.append(e + lo)
        lo = top
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return Words(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), start,
                 np.concatenate(ends) if ends else np.zeros(0, np.int64), np.searchsorted(start, at))


def _long(part: np.ndarray, lower: bool) -> int:
    raw = part.tobytes()
    return xxhash.xxh64_intdigest(raw.lower() if lower else raw)
