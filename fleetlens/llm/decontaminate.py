"""Benchmark passages in documents by spaced-seed hashing.

A seed mask looks at six of up to nine neighbouring words and ignores the others. The three masks together hit
every aligned stretch of twelve words in which at most two differ. Seed hashes of the documents
that may occur in the benchmark (a bit table of fixed size, see ``tables.bit_table``) are kept with the
words around them, joined with the benchmark's seed hashes, and each hit is verified by counting
equal words in windows along its diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.tables import arrow_map, bit_table, in_bits, without_rows
from fleetlens.llm.words import find_words, mix, slices, text_bytes
from fleetlens.session import durable

MASKS = ((0, 1, 2, 4, 6, 7), (0, 2, 3, 6, 7, 8), (0, 1, 2, 3, 4, 5))
WINDOW, EQUAL = 12, 10   # a window of twelve words counts with ten equal ones
TOLERANT = 5             # items of 5 to 11 words may differ in one word; shorter ones must occur word for word
MARGIN = 24              # words kept around hits
_PLACE = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_PLAIN = np.arange(256, dtype=np.uint8)  # letters and digits stay, other ASCII signs part words
_PLAIN[65:91] += 32
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32


def plain_bytes(buf: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the Latin-1 capitals lower-cased and ASCII punctuation blanked."""
    out = _PLAIN[buf]
    if len(buf) > 1:
        low = buf[1:]
        out[np.flatnonzero((buf[:-1] == 0xC3) & (low >= 0x80) & (low < 0x9F) & (low != 0x97)) + 1] += 32
    return out


def seed_hashes(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    n = max(0, len(words) - mask[-1])
    h = np.zeros(n, np.uint64)
    for place in mask:
        h += words[place:place + n] * _PLACE[place]
    return mix(h + np.uint64(sum(1 << p for p in mask)))


def masks_for(n: int) -> list[tuple[int, ...]]:
    """Masks of an item of ``n`` words; of a short one each leaves out a third of the places, so one misses any word."""
    if n >= WINDOW:
        return list(MASKS)
    if n < TOLERANT:
        return [tuple(range(n))] if n else []
    return [tuple(p for p in range(n) if p % 3 != r) for r in range(3)]


def _item_words(batch: pa.RecordBatch) -> pa.RecordBatch:
    buf, at = text_bytes(batch.column(1))
    buf, at = plain_bytes(buf[at[0]:at[-1]]), at - at[0]
    w = find_words(buf, at)
    lists = pa.ListArray.from_arrays(pa.array(w.first, pa.int32()), pa.array(w.hash.view(np.int64)))
    return pa.RecordBatch.from_arrays([batch.column(0), lists], ["item_id", "words"])


def _item_seeds(batch: pa.RecordBatch) -> pa.RecordBatch:
    item, pos, seed = [], [], []
    lists = batch.column(1)
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    for i, k in enumerate(batch.column(0).to_pylist()):
        words = flat[at[i]:at[i + 1]]
        for mask in masks_for(len(words)):
            h = seed_hashes(words, mask)
            h = h if len(words) >= WINDOW else h[:1]
            item += [k] * len(h)
            pos += range(len(h))
            seed.append(h)
    return pa.RecordBatch.from_arrays(
        [pa.array(item, pa.int64()), pa.array(pos, pa.int64()),
         pa.array(np.concatenate(seed).view(np.int64) if seed else [], pa.int64())], ["item", "item_pos", "seed"])


def _regions(bits: np.ndarray, masks: list[tuple[int, ...]]):
    """Rows (doc_id, text_hash, region start, words, hit places, hit seeds)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        buf, at = text_bytes(batch.column(2))
        ids, hashes = batch.column(0), batch.column(1)
        rows, begin, words, hits, seeds = [], [], [], [], []
        for lo, hi in slices(at):
            part = plain_bytes(buf[at[lo]:at[hi]])
            cuts = at[lo:hi + 1] - at[lo]
            w = find_words(part, cuts)
            found = []
            for mask in masks:
                h = seed_hashes(w.hash, mask)
                may = np.flatnonzero(in_bits(bits, h))
                doc = np.searchsorted(w.first, may, "right") - 1
                inside = may + mask[-1] < w.first[doc + 1]  # within one text
                found.append((may[inside], doc[inside], h[may[inside]]))
            p, doc, h = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((p, doc))
            p, doc, h = p[order], doc[order], h[order]
            if not len(p):
                continue
            cut = np.flatnonzero((doc[1:] != doc[:-1]) | (p[1:] - p[:-1] > 2 * MARGIN)) + 1
            for a, b in zip([0, *cut], [*cut, len(p)]):
                d = int(doc[a])
                first, last = int(w.first[d]), int(w.first[d + 1])
                x, y = max(first, int(p[a]) - MARGIN), min(last, int(p[b - 1]) + 2 * MARGIN)
                rows.append(lo + d)
                begin.append(x - first)
                words.append(w.hash[x:y].view(np.int64))
                hits.append(p[a:b] - first)
                seeds.append(h[a:b].view(np.int64))
        if not rows:
            return None
        take = pa.array(rows)
        return pa.RecordBatch.from_arrays(
            [ids.take(take), hashes.take(take), pa.array(begin, pa.int64()), pa.array(words, pa.list_(pa.int64())),
             pa.array(hits, pa.list_(pa.int64())), pa.array(seeds, pa.list_(pa.int64()))],
            ["doc_id", "text_hash", "begin", "words", "hits", "seeds"])
    return run


def equal_windows(doc: np.ndarray, item: np.ndarray, shift: int) -> np.ndarray:
    """Places of ``doc`` in windows that agree with ``item`` when item word 0 lies at ``shift``."""
    n = len(item)
    width, need = (WINDOW, EQUAL) if n >= WINDOW else (n, n - 1 if n >= TOLERANT else n)
    lo, hi = max(0, shift), min(len(doc), shift + len(item))
    if hi - lo < width:
        return np.zeros(0, np.int64)
    same = doc[lo:hi] == item[lo - shift:hi - shift]
    total = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(total[width:] - total[:-width] >= need)
    if not len(good):
        return good
    inside = np.zeros(hi - lo + 1, np.int64)
    np.add.at(inside, good, 1)
    np.add.at(inside, good + width, -1)
    return np.flatnonzero((np.cumsum(inside[:-1]) > 0) & same) + lo


def _verified(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """The best diagonal of each region and item."""
    keep, best = [], []
    lists = {c: (batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()) for c in ("words", "item_words", "shifts")}

    def of(c: str, k: int) -> np.ndarray:
        offsets, values = lists[c]
        return values[offsets[k]:offsets[k + 1]]
    begin = batch.column("begin").to_numpy()
    for k in range(batch.num_rows):
        doc, item, top = of("words", k), of("item_words", k), None
        for shift in of("shifts", k):
            at = equal_windows(doc, item, int(shift - begin[k]))
            if len(at):
                found = (len(at), -int(at[0] + begin[k]), int(at[-1] + begin[k]) + 1)
                top = max(top, found) if top else found
        if top:
            keep.append(k)
            best.append(top)
    if not keep:
        return None
    rest = batch.select(["doc_id", "text_hash", "item_id"]).take(pa.array(keep))
    equal, back, end = (pa.array(x, pa.int64()) for x in zip(*best))
    return pa.RecordBatch.from_arrays([*rest.columns, pc.negate(back), end, equal],
                                      ["doc_id", "text_hash", "item_id", "first_word", "end_word", "n_equal"])


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, text_hash, item_id, n_equal, first_word, end_word`` for each document and item that overlap.

    Words are runs of letters and digits (A-Z and Latin-1 capitals lower-cased, other ASCII signs
    part words, other characters belong to words). A document overlaps with an item (item_id,
    text) if some aligned window of 12 words has 10 equal ones; an item of 5 to 11 words must occur
    with at most one other word in its place, a shorter one word for word; a null one or one without
    words never matches. ``n_equal`` counts equal words in such windows on the best diagonal; the
    word places are zero-based.

    Null, empty and one-word texts overlap with nothing. Rows that repeat a document count once,
    a null doc_id or item_id is kept, other columns are not read. Empty tables give no rows.
    """
    items = durable(arrow_map(benchmark.select(F.col("item_id").cast("long"), "text"), _item_words, "item_id long, words array<long>")
                    .withColumn("item", F.monotonically_increasing_id()))
    sizes = [r[0] for r in items.select(F.least(F.size("words"), F.lit(WINDOW)).alias("n")).distinct().collect()]
    masks = [m for n in sorted({*sizes, WINDOW}, reverse=True) for m in masks_for(n)]
    seeds = durable(arrow_map(items.select("item", "words"), _item_seeds, "item long, item_pos long, seed long"))
    bits = bit_table(seeds, "seed")
    docs = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    regions = durable(arrow_map(docs, _regions(bits, masks),
                                "doc_id long, text_hash long, begin long, words array<long>, hits array<long>, seeds array<long>")
                      .withColumn("region", F.monotonically_increasing_id()))
    hits = regions.select("region", F.explode(F.arrays_zip("hits", "seeds")).alias("h")).select(
        "region", F.col("h.hits").alias("pos"), F.col("h.seeds").alias("seed"))
    # a region holds its words once for each item, not for each diagonal; it has no more diagonals than words
    diagonals = hits.join(seeds, "seed").groupBy("region", "item").agg(
        F.collect_set(F.col("pos") - F.col("item_pos")).alias("shifts"))
    pairs = (diagonals.join(items.select("item", "item_id", F.col("words").alias("item_words")), "item")
             .join(regions.select("region", "doc_id", "text_hash", "begin", "words"), "region")
             .select("doc_id", "text_hash", "begin", "words", "item_id", "item_words", "shifts"))
    found = arrow_map(pairs, _verified,
                      "doc_id long, text_hash long, item_id long, first_word long, end_word long, n_equal long")
    best = F.max(F.struct("n_equal", (-F.col("first_word")).alias("back"), "end_word"))
    return found.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("b")).select(
        "doc_id", "text_hash", "item_id", F.col("b.n_equal").alias("n_equal"),
        (-F.col("b.back")).alias("first_word"), F.col("b.end_word").alias("end_word"))


def without_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without the rows that overlap with a benchmark item; all columns stay, whatever they are called.

    Null and empty texts overlap with nothing and stay; of rows that repeat an id, or have none, each is
    judged by its own text; an empty table of either kind changes nothing.
    """
    return without_rows(documents, contaminated(documents, benchmark))
