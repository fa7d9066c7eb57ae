"""Token ids of whole texts with a word-level vocabulary file.

The tokenizer never looks across white space, and inside a word it works on runs of letters,
single digits and runs of other signs. So every distinct run is encoded once by the library
and all texts are put together from the runs' ids. Words with anything but ASCII and Latin-1
letters, with an apostrophe (contractions) or with a special token's bracket are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np

from fleetlens.llm.words import _BYTE, find_words, mix, powers

SLICE = 1 << 20          # bytes handled at once
CACHE_RUNS = 300_000     # distinct runs a worker remembers
_WHOLE = np.uint64(0xA0761D6478BD642F)

_CLASS = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 other, 4 part of a word kept whole
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = _CLASS[0x80:0xC0] = _CLASS[0xC3] = 1
_ODD = np.zeros(256, bool)
_ODD[:32] = _ODD[127] = _ODD[39] = _ODD[0xC0:] = True
_ODD[[9, 10, 11, 12, 13, 0xC3]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POW = powers(0x9E3779B97F4A7C15, 1 << 12)


class RunTokenizer:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.path, self.library = path, Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.lengths = np.zeros(1 << 16, np.int64)
        self.begins = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _add(self, keys: list[int], ids: list[list[int]]) -> None:
        n, at = len(self.known), self.used
        sizes = np.array([len(x) for x in ids], np.int64)
        need = at + int(sizes.sum())
        while n + len(keys) > len(self.lengths):
            self.lengths, self.begins = np.resize(self.lengths, 2 * len(self.lengths)), np.resize(self.begins, 2 * len(self.begins))
        while need > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[at:need] = np.fromiter((i for x in ids for i in x), np.uint32, need - at)
        self.lengths[n:n + len(keys)] = sizes
        self.begins[n:n + len(keys)] = at + np.cumsum(sizes) - sizes
        self.known.update(zip(keys, range(n, n + len(keys))))
        self.used = need

    def _encode_runs(self, runs: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(0, len(runs), 2000):
            some = runs[i:i + 2000]
            e = self.library.encode(" ".join(some), add_special_tokens=False)
            parts: list[list[int]] = [[] for _ in some]
            for k, w in zip(e.ids, e.word_ids):
                parts[w].append(k)
            out += parts
        return out

    def encode(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts ``buf[at[i]:at[i + 1]]`` in one array, and where each text's begin."""
        lo, hi = int(at[0]), int(at[-1])
        part, cuts = buf[lo:hi], at - lo
        cls, odd = _CLASS[part], _ODD[part]
        if len(part) > 1:
            low = part[1:]
            after = part[:-1] == 0xC3
            odd[1:] |= ((low >= 0x80) & (low < 0xC0) & ~after) | (after & ((low == 0x97) | (low == 0xB7)))
            odd[1:] |= (low == 0x7C) & (part[:-1] == 0x3C)
        norm = _LOWER[part]
        if len(part) > 1:
            up = np.flatnonzero(after & (low < 0x9F)) + 1
            norm[up] += 32
        if odd.any():
            w = find_words(part, cuts)
            hit = np.unique(np.searchsorted(w.start, np.flatnonzero(odd), "right") - 1)
            step = np.zeros(len(part) + 1, np.int32)
            np.add.at(step, w.start[hit], 1)
            np.add.at(step, w.end[hit], -1)
            whole = np.cumsum(step[:-1]) > 0
            cls[whole] = 4
            norm[whole] = part[whole]
        new = np.ones(len(part), bool)
        new[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == 2)
        new[cuts[cuts < len(part)]] = True
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(part))
        real = cls[begin] != 0
        begin, end = begin[real], end[real]
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        keys = mix(_run_hashes(norm, begin, end) + np.where(cls[begin] == 4, _WHOLE, np.uint64(0)))
        distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > CACHE_RUNS:
            self._clear()
        want = distinct.tolist()
        index = [self.known.get(k, -1) for k in want]
        missing = [i for i, x in enumerate(index) if x < 0]
        if missing:
            runs = [norm[begin[first[i]]:end[first[i]]].tobytes().decode("utf-8", "replace") for i in missing]
            kept_whole = [cls[begin[first[i]]] == 4 for i in missing]
            plain = iter(self._encode_runs([r for r, k in zip(runs, kept_whole) if not k]))
            special = iter(self.library.encode_batch([r for r, k in zip(runs, kept_whole) if k], add_special_tokens=False))
            self._add([want[i] for i in missing], [next(special).ids if k else next(plain) for k in kept_whole])
            index = [self.known[k] for k in want]
        at_run = np.array(index, np.int64)[place]
        n = self.lengths[at_run]
        ends = np.cumsum(n)
        take = np.arange(int(ends[-1])) + np.repeat(self.begins[at_run] - (ends - n), n)
        runs_before = np.searchsorted(begin, cuts)
        return self.flat[take], np.concatenate([[0], ends])[runs_before]


def _run_hashes(norm: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes by the place of each byte in its run."""
    place = np.arange(len(norm))
    place[begin[0]:] -= np.repeat(begin, np.diff(np.append(begin, len(norm))))
    total = np.zeros(len(norm) + 1, np.uint64)
    value = _BYTE[norm] * _POW[place & (len(_POW) - 1)]
    if len(norm) > len(_POW):
        value *= (place >> 12).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    np.cumsum(value, out=total[1:])
    return total[end] - total[begin]


_loaded: dict[str, RunTokenizer] = {}


def tokenizer(path: str) -> RunTokenizer:
    """The worker's tokenizer for a vocabulary file."""
    if path not in _loaded:
        _loaded[path] = RunTokenizer(path)
    return _loaded[path]


def text_ids(t: RunTokenizer, buf: np.ndarray, at: np.ndarray):
    """Ids of every text, one array each; long texts are handled in pieces cut at white space."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE, "right")) - 1)
        if at[hi] - at[lo] <= SLICE:
            ids, first = t.encode(buf, at[lo:hi + 1])
            for i in range(hi - lo):
                yield ids[first[i]:first[i + 1]]
        else:
            parts, a, stop = [], int(at[lo]), int(at[hi])
            while a < stop:
                b = min(stop, a + SLICE)
                while b < stop:
                    spaces = np.flatnonzero(_CLASS[buf[a:b]] == 0)
                    if len(spaces):
                        b = a + int(spaces[-1]) + 1
                        break
                    b = min(stop, b + SLICE)
                parts.append(t.encode(buf, np.array([a, b]))[0])
                a = b
            yield np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        lo = hi
