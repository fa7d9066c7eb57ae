"""Quality rules: fixed limits on text statistics, and an isolation forest over them.

The forest's random cuts lie anywhere in the range of all labelled rows, and every tree holds all
rows labelled good, so texts unlike good ones fall into empty parts after few splits. Its
threshold comes from the labels too: at most a stated share of good rows may be refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.ordered import BUCKETS, join_one
from fleetlens.llm.tables import arrow_map, small_batches
from fleetlens.llm.words import find_words, mix, slices, text_bytes
from fleetlens.session import durable

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
TREES, TREE_ROWS = 100, 1024  # trees of more rows are cut as deep as those of TREE_ROWS and filled by counting
GOOD_LOSS = 0.002   # share of good labelled rows the forest may refuse
LEAST_GOOD = 32     # usable good rows without which there is no forest
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATES = ["word_length", "symbols", "repeats", "capitals"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])


def statistics(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The five counts of each text, and its capitals A-Z."""
    counts, upper = [], []
    for lo, hi in slices(at):
        part, cuts = buf[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        w = find_words(part, cuts)
        n_words = np.diff(w.first)
        lead = np.concatenate([[0], np.cumsum(_LEAD[part], dtype=np.int64)])
        word_chars = np.concatenate([[0], np.cumsum(lead[w.end] - lead[w.start])])
        doc = np.repeat(np.arange(hi - lo), n_words)
        repeat = np.zeros(len(w.hash), bool)
        if len(w.hash) > 2:
            own = np.flatnonzero(doc[2:] == doc[:-2])  # windows inside one text
            key = mix(w.hash[own] * _A + w.hash[own + 1] * _B + w.hash[own + 2] * _C + (doc[own] + 1).astype(np.uint64) * _D)
            _, place, n = np.unique(key, return_inverse=True, return_counts=True)
            twice = own[n[place] > 1]
            for k in range(3):
                repeat[twice + k] = True
        repeats = np.concatenate([[0], np.cumsum(repeat)])
        dup = []
        for a, b in zip(cuts, cuts[1:]):
            kept = [x for x in part[a:b].tobytes().split(b"\n") if x.strip(b" \t\n\v\f\r")]
            dup.append(len(kept) - len(set(kept)))
        counts.append(np.stack([n_words, np.diff(word_chars[w.first]), _per_text(_SYMBOL[part], cuts), np.array(dup),
                                np.diff(repeats[w.first])], axis=1))
        upper.append(_per_text(_UPPER[part], cuts))
    return np.concatenate(counts), np.concatenate(upper)


def features(counts: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Rates per word and character, so that long and short texts compare."""
    n, chars = np.maximum(1, counts[:, 0]).astype(np.float64), np.maximum(1, counts[:, 1]).astype(np.float64)
    return np.stack([counts[:, 1] / n, np.log1p(counts[:, 2] / n), counts[:, 4] / n, upper / chars], axis=1)


def _path_norm(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), n == 2)


def _depth(rows: int) -> int:
    return max(1, int(np.ceil(np.log2(max(2, rows)))))


class IsolationForest:
    """Random axis-parallel splits; flat arrays of nodes, one row per tree. Each tree holds all ``rows``."""

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, seed: int = 5):
        rng = np.random.default_rng(seed)
        self._clear(trees, _depth(len(rows)), len(rows))
        for t in range(trees):
            stack = [(1, rows[rng.choice(len(rows), len(rows), replace=False)], low, high, 0)]
            while stack:
                k, part, low_k, high_k, depth = stack.pop()
                wide = np.flatnonzero(high_k > low_k)
                if depth == self.depth or len(part) < 2 or not len(wide):
                    self.length[t, k] = depth + _path_norm(len(part))
                    continue
                f = int(rng.choice(wide))
                c = rng.uniform(low_k[f], high_k[f])
                self.feature[t, k], self.cut[t, k] = f, c
                left = part[:, f] < c
                below, above = high_k.copy(), low_k.copy()
                below[f] = above[f] = c
                stack += [(2 * k, part[left], low_k, below, depth + 1), (2 * k + 1, part[~left], above, high_k, depth + 1)]

    def _clear(self, trees: int, depth: int, rows: int) -> None:
        self.depth, self.norm = depth, max(float(_path_norm(rows)), 1e-9)
        nodes = 2 << depth
        self.feature = np.full((trees, nodes), -1, np.int8)
        self.cut, self.length = np.zeros((trees, nodes)), np.zeros((trees, nodes))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; higher is stranger."""
        out = np.zeros(len(rows))
        for lo in range(0, len(rows), 4096):
            x = rows[lo:lo + 4096]
            at, who = np.ones(len(x), np.int64), np.arange(len(x))
            total = np.zeros(len(x))
            for t in range(len(self.feature)):
                at[:] = 1
                for _ in range(self.depth):
                    f = self.feature[t, at]
                    down = 2 * at + (x[who, np.maximum(f, 0)] >= self.cut[t, at])
                    at = np.where(f < 0, at, down)
                total += self.length[t, at]
            out[lo:lo + 4096] = 2.0 ** (-total / len(self.feature) / self.norm)
        return out


class CountedForest(IsolationForest):
    """A forest whose cuts do not depend on the rows: many tasks count theirs in its parts, and the sums settle it."""

    def __init__(self, low: np.ndarray, high: np.ndarray, trees: int = TREES, seed: int = 5):
        rng = np.random.default_rng(seed)
        wide = np.flatnonzero(high > low)
        self._clear(trees, _depth(TREE_ROWS) if len(wide) else 0, 0)
        nodes, tree = self.cut.shape[1], np.arange(trees)[:, None]
        lows, highs = np.tile(low, (trees, nodes, 1)), np.tile(high, (trees, nodes, 1))
        for d in range(self.depth):
            k = np.arange(1 << d, 2 << d)
            f = rng.choice(wide, (trees, len(k)))
            c = rng.uniform(lows[tree, k, f], highs[tree, k, f])
            self.feature[:, k], self.cut[:, k] = f, c
            for part in (2 * k, 2 * k + 1):
                lows[:, part], highs[:, part] = lows[:, k], highs[:, k]
            highs[tree, 2 * k, f] = lows[tree, 2 * k + 1, f] = c

    def counted(self, rows: np.ndarray) -> np.ndarray:
        """How many of the rows end in each part of each tree; before it is settled."""
        out = np.zeros(self.cut.shape, np.int64)
        for lo in range(0, len(rows), 4096):
            x = rows[lo:lo + 4096]
            who = np.arange(len(x))
            for t in range(len(out)):
                at = np.ones(len(x), np.int64)
                for _ in range(self.depth):
                    at = 2 * at + (x[who, self.feature[t, at]] >= self.cut[t, at])
                out[t] += np.bincount(at, minlength=out.shape[1])
        return out

    def settle(self, counts: np.ndarray) -> None:
        """Path lengths from the rows in each part; nothing is split that holds fewer than two."""
        counts = counts.copy()
        for d in range(self.depth, -1, -1):
            k = np.arange(1 << d, 2 << d)
            if d < self.depth:
                counts[:, k] = counts[:, 2 * k] + counts[:, 2 * k + 1]
            self.length[:, k] = d + _path_norm(counts[:, k])
            self.feature[:, k] = np.where(counts[:, k] < 2, -1, self.feature[:, k])
        self.norm = max(float(_path_norm(counts[0, 1])), 1e-9)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])


def measured(documents: DataFrame) -> DataFrame:
    """``doc_id, counts``, written: the five counts of every text and its capitals."""
    n = len(COUNTS) + 1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, upper = statistics(*text_bytes(batch.column(1)))
        flat = pa.array(np.concatenate([counts, upper[:, None]], axis=1).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * n), flat)
        return pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "counts"])
    rows = documents.select("doc_id", "text")
    return durable(arrow_map(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, counts array<long>"))


def matrix(counts: pa.Array) -> np.ndarray:
    return counts.flatten().to_numpy().reshape(-1, len(COUNTS) + 1)


def value_at(rows: DataFrame, name: str, place: int) -> float:
    """The value at ``place``, from 0, of a written column of numbers in rising order.

    Each histogram has at most ``BUCKETS`` rows and divides the bucket of the one before.
    """
    value = F.col(name)
    low, high = rows.agg(F.min(value), F.max(value)).first()
    while low < high:
        bucket = F.least(F.floor((value - low) / (high - low) * BUCKETS), F.lit(BUCKETS - 1))
        sizes = rows.filter(value.between(low, high)).groupBy(bucket.alias("bucket")).agg(F.count("*"), F.min(value), F.max(value))
        for _, n, low, high in sorted(map(tuple, sizes.collect())):
            if place < n:
                break
            place -= n
    return low


def fill(forest: CountedForest, rows: DataFrame) -> CountedForest:
    """The forest with all ``rows`` counted in it; the driver gets at most one row for each part of a tree."""
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sum((forest.counted(np.stack(b.columns, axis=1)) for b in batches if b.num_rows), np.zeros(forest.cut.shape, np.int64)).ravel()
        parts = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array(counts[parts])], ["part", "n"])
    sums = small_batches(rows).mapInArrow(placed, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(forest.cut.size, np.int64)
    counts[sums["part"].to_numpy()] = sums["n"].to_numpy()
    forest.settle(counts.reshape(forest.cut.shape))
    return forest


def fit(stats: DataFrame, labels: DataFrame, good_loss: float = GOOD_LOSS, seed: int = 5) -> tuple[IsolationForest, float] | None:
    """Forest and threshold from all labelled rows of ``measured`` texts; None without usable labels."""
    marks = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id")
             .agg(F.min("quality").cast("int").alias("quality")))
    marked = join_one(stats.filter(F.col("doc_id").isNotNull()), marks, ["doc_id"], ["counts"]).select("quality", "counts")

    def rated(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = matrix(batch.column(1))
        usable = ~base_failed(counts)
        x = features(counts, counts[:, -1])[usable]
        return pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(usable)), *map(pa.array, x.T.copy())], ["quality", *RATES])
    usable = durable(arrow_map(marked, rated, "quality int, " + ", ".join(f"{c} double" for c in RATES)))
    good = usable.filter("quality >= 1").select(*RATES)
    n, *ends = usable.agg(F.count_if(F.col("quality") >= 1), *map(F.min, RATES), *map(F.max, RATES)).first()
    if n < LEAST_GOOD:
        return None
    low, high = np.array(ends[:len(RATES)]), np.array(ends[len(RATES):])
    forest = IsolationForest(np.array(good.collect()), low, high, seed=seed) if n <= TREE_ROWS else fill(CountedForest(low, high, seed=seed), good)

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(forest.score(np.stack(batch.columns, axis=1)))], ["score"])
    scores = durable(arrow_map(good, scored, "score double"))
    return forest, value_at(scores, "score", min(n - 1, int(np.floor(n * (1 - good_loss)))))


def quality_rules(documents: DataFrame, labels: DataFrame, good_loss: float = GOOD_LOSS) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, strangeness, kept``.

    One row for each row of ``documents`` (doc_id, text). Words are runs of characters other than
    blank and \\x09-\\x0D. A text fails the base rules with under 50 words or when over half of its
    words lie in three-word windows that occur again. The others are kept unless the forest's
    score is above the threshold calibrated on ``labels`` (doc_id, quality 0 or 1).

    A null or empty text counts zero everywhere and fails. Repeated rows get equal results, a
    null doc_id is kept as it is, other columns are not read; labels without a doc_id or quality
    are left out and of several labels of one document the worst counts. Without 32 usable good
    labels only the base rules decide and ``strangeness`` is null. An empty table gives no rows.
    """
    stats = measured(documents)
    fitted = fit(stats, labels, good_loss)

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = matrix(batch.column(1))
        failed, score, kept = judge(counts, fitted)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(counts[:, k]) for k in range(len(COUNTS))], pa.array(failed),
             pa.nulls(len(counts), pa.float64()) if score is None else pa.array(score), pa.array(kept)],
            ["doc_id", *COUNTS, "base_failed", "strangeness", "kept"])
    return arrow_map(stats, judged,
                     "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, strangeness double, kept boolean")


def judge(counts: np.ndarray, fitted: tuple[IsolationForest, float] | None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Base failures, scores and verdicts of some texts by their counts and capitals."""
    failed = base_failed(counts)
    if fitted is None:
        return failed, None, ~failed
    score = fitted[0].score(features(counts, counts[:, -1]))
    return failed, score, ~failed & (score <= fitted[1])


def keep_good(documents: DataFrame, labels: DataFrame, good_loss: float = GOOD_LOSS) -> DataFrame:
    """The rows of ``documents`` that ``quality_rules`` keeps, with all their columns."""
    fitted = fit(measured(documents), labels, good_loss)
    place = documents.columns.index("text")

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, upper = statistics(*text_bytes(batch.column(place)))
        return batch.filter(pa.array(judge(np.concatenate([counts, upper[:, None]], axis=1), fitted)[2]))
    return arrow_map(documents, kept, documents.schema)
