"""Ranked lexical search: best-first intervals of documents over posting lists with range maxima.

A first pass writes one index row per document: its length and the query terms in it. With the
corpus statistics of that index, every task turns its rows into shards of bounded size. A shard
has one posting list per term, in the order of document length, each with a sparse table that
names the posting of highest impact in any range of the list. An interval of documents can score
at most the sum of its terms' range maxima. The search of an item takes the intervals with the
highest bounds first, splits each at the document where its strongest term has the highest impact,
scores that document, and drops what cannot reach the item's worst kept result; short intervals are
scored whole. A task keeps its best results from shard to shard, so bounds only become stricter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fleetlens.functions.ordered import first_k_in_group
from fleetlens.llm.tables import arrow_map, small_batches
from fleetlens.llm.words import find_words, slices, text_bytes
from fleetlens.session import durable

ITEM_TERMS = 200_000        # terms of the items that are searched at once; more items go in blocks
SHARD_POSTINGS = 1 << 19
SHARD_DOCS = 1 << 16
LEAF = 64                   # intervals of up to so many documents are scored whole
PICKS = 20_000              # intervals that one round takes up, over all items of a block

TERM_BYTE = np.zeros(256, bool)  # digits, letters and every byte of a character beyond ASCII
TERM_BYTE[48:58] = TERM_BYTE[65:91] = TERM_BYTE[97:123] = TERM_BYTE[128:] = True


def _counted(texts: pa.Array, vocabulary: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: terms of each text, then (text, term, occurrences) for terms of the vocabulary.

    Without a vocabulary terms are hashes, else places in the sorted ``vocabulary``.
    """
    buf, at = text_bytes(texts)
    if vocabulary is not None:
        maybe = np.zeros(1 << 16, bool)
        maybe[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
    for lo, hi in slices(at):
        w = find_words(buf, at[lo:hi + 1], lower=True, chars=TERM_BYTE)
        n = np.diff(w.first)
        text = np.repeat(np.arange(hi - lo), n)
        if vocabulary is None:
            terms, term = np.unique(w.hash, return_inverse=True)
        else:
            at_all = np.flatnonzero(maybe[(w.hash & np.uint64(0xFFFF)).astype(np.int64)])
            place = np.minimum(np.searchsorted(vocabulary, w.hash[at_all]), len(vocabulary) - 1)
            hit = vocabulary[place] == w.hash[at_all]
            text, term, terms = text[at_all[hit]], place[hit], np.arange(len(vocabulary))
        keys, tf = np.unique(text.astype(np.int64) * max(1, len(terms)) + term, return_counts=True)
        yield n, keys // max(1, len(terms)), terms[keys % max(1, len(terms))], tf


def _lists(text: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    offsets = np.searchsorted(text, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def item_terms(items: DataFrame) -> DataFrame:
    """``item, item_id, terms``: each row of ``items`` (item_id, text) with the hashes of its distinct terms."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lists: list[np.ndarray] = []
        for n, text, term, _ in _counted(b.column("text"), None):
            lists += np.split(term, np.searchsorted(text, np.arange(1, len(n))))
        flat = np.concatenate(lists).view(np.int64) if lists else np.zeros(0, np.int64)
        offsets = np.cumsum([0] + [len(x) for x in lists])
        return pa.RecordBatch.from_arrays(
            [b.column("item"), b.column("item_id"),
             pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))], ["item", "item_id", "terms"])
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id"), F.col("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    return durable(arrow_map(rows, run, f"item bigint, item_id {kind}, terms array<bigint>"))


def index_documents(documents: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every document with a term; only terms of ``vocabulary`` are listed."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        parts = list(_counted(b.column("text"), vocabulary))
        ids, at, out = b.column("doc_id"), 0, []
        for n, text, term, tf in parts:
            out.append(pa.RecordBatch.from_arrays(
                [ids.slice(at, len(n)), pa.array(n, pa.int64()), _lists(text, term, len(n), pa.int32()),
                 _lists(text, tf, len(n), pa.int32())], ["doc_id", "n", "terms", "tfs"]))
            at += len(n)
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    rows = documents.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, run, f"doc_id {kind}, n bigint, terms array<int>, tfs array<int>").filter("n > 0")


@dataclass
class Queries:
    """A block of items: their terms (places in the vocabulary), and the corpus statistics for scoring."""

    item: np.ndarray     # number of each item
    first: np.ndarray    # where each item's terms begin in ``term``, one entry more
    term: np.ndarray
    weight: np.ndarray   # of each term of the vocabulary
    n_docs: int
    n_terms: int
    k: int


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def ragged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges first[i]:last[i], and the i of each."""
    size = last - first
    which = np.repeat(np.arange(len(first)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + first[which], which


class Shard:
    """Posting lists of some documents, numbered by length, with a sparse table over all impacts."""

    def __init__(self, q: Queries, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray):
        self.order = np.argsort(n, kind="stable")
        self.size = len(n)
        place = np.empty(len(n), np.int64)
        place[self.order] = np.arange(len(n))
        m = 100 - 50 + (50 * n * q.n_docs) // q.n_terms
        impact = q.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        keys = term * np.int64(self.size) + place[doc]
        keep = np.flatnonzero(impact > 0)
        keep = keep[np.argsort(keys[keep])]
        self.keys, self.impact = keys[keep], impact[keep]
        self.doc = place[doc[keep]]
        bounds = np.searchsorted(self.keys, np.arange(len(q.weight) + 1) * np.int64(self.size))
        longest = int(np.diff(bounds).max(initial=1))
        levels = [np.arange(len(keep), dtype=np.int32)]
        step = 1
        while 2 * step <= longest:
            a, b = levels[-1].copy(), levels[-1][step:]
            head = a[:len(b)]
            a[:len(b)] = np.where(self.impact[head] >= self.impact[b], head, b)
            levels.append(a)
            step *= 2
        self.best = np.stack(levels)

    def top(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Posting of highest impact in each range a:b of one list, not empty."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        x, y = self.best[level, a], self.best[level, b - (np.int64(1) << level)]
        return np.where(self.impact[x] >= self.impact[y], x, y)

    def ranges(self, q_first: np.ndarray, q_term: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """Ranges of postings of every (interval, term) that has some, and the interval of each."""
        flat, which = ragged(q_first[item], q_first[item + 1])
        base = q_term[flat] * np.int64(self.size)
        a, b = np.searchsorted(self.keys, base + lo[which]), np.searchsorted(self.keys, base + hi[which])
        some = np.flatnonzero(b > a)
        return a[some], b[some], which[some]

    def bounds(self, q_first, q_term, item, lo, hi) -> tuple[np.ndarray, np.ndarray]:
        """What no document of an interval exceeds, and the document where its strongest term peaks."""
        a, b, which = self.ranges(q_first, q_term, item, lo, hi)
        if not len(a):
            return np.zeros(len(item), np.int64), lo.copy()
        best = self.top(a, b)
        value = self.impact[best]
        bound = np.bincount(which, weights=value, minlength=len(item)).astype(np.int64)  # far below 2 ** 53
        starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        peak = np.flatnonzero(value == np.repeat(np.maximum.reduceat(value, starts), np.diff(np.r_[starts, len(which)])))
        peak = peak[np.r_[True, which[peak][1:] != which[peak][:-1]]]
        split = lo.copy()
        split[which[peak]] = self.doc[best[peak]]
        return bound, split

    def scores(self, q_first, q_term, item, lo, hi) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(interval, document, score) of every document of the intervals that has a term."""
        a, b, which = self.ranges(q_first, q_term, item, lo, hi)
        posting, part = ragged(a, b)
        row = which[part]
        offset = np.cumsum(np.r_[0, hi - lo])
        slot = offset[row] + self.doc[posting] - lo[row]
        total = np.bincount(slot, weights=self.impact[posting], minlength=offset[-1]).astype(np.int64)
        slot = np.flatnonzero(total)
        row = np.searchsorted(offset, slot, "right") - 1
        return row, slot - offset[row] + lo[row], total[slot]


class Kept:
    """The best results of every item so far: score, whether the id is null, id."""

    def __init__(self, items: int, k: int):
        self.k, self.worst = k, np.ones(items, np.int64)  # a score must be above 0
        self.item, self.score, self.void, self.doc = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, item, score, void, doc) -> None:
        item, score, void, doc = (np.concatenate(x) for x in (
            (self.item, item), (self.score, score), (self.void, void), (self.doc, doc)))
        order = np.lexsort((doc, void, -score, item))
        group = item[order]
        first = np.searchsorted(group, group)
        order = order[np.arange(len(order)) - first < self.k]
        self.item, self.score, self.void, self.doc = (x[order] for x in (item, score, void, doc))
        group = self.item
        full = np.flatnonzero(np.arange(len(group)) - np.searchsorted(group, group) == self.k - 1)
        self.worst[group[full]] = self.score[full]


def search(shard: Shard, q: Queries, kept: Kept, void: np.ndarray, doc: np.ndarray) -> None:
    """Put the best documents of a shard among the kept results of all items.

    ``void`` and ``doc`` are the null flags and ids of the shard's documents in their own order.
    """
    void, doc = void[shard.order], doc[shard.order]
    present = np.diff(np.searchsorted(shard.keys, np.arange(len(q.weight) + 1) * np.int64(shard.size))) > 0
    has = present[q.term]  # terms without a posting here are left out
    first, term = np.r_[0, np.cumsum(has)][q.first], q.term[has]
    item = np.flatnonzero(np.diff(first))
    lo, hi = np.zeros(len(item), np.int64), np.full(len(item), shard.size, np.int64)
    bound, split = shard.bounds(first, term, item, lo, hi)
    take = 8
    while True:
        left = np.flatnonzero(bound >= kept.worst[item])  # an equal score may still win by its id
        item, lo, hi, bound, split = (x[left] for x in (item, lo, hi, bound, split))
        if not len(item):
            return
        order = np.lexsort((-bound, item))
        group = item[order]
        starts = np.searchsorted(group, group)
        active = int((np.arange(len(group)) == starts).sum())
        now = np.arange(len(order)) - starts < max(1, min(take, PICKS // active))
        picked, rest = order[now], order[~now]
        whole = hi[picked] - lo[picked] <= LEAF
        leaf, cut = picked[whole], picked[~whole]
        # short intervals and the documents where others are split
        e_item, e_lo, e_hi = (np.concatenate(x) for x in (
            (item[leaf], item[cut]), (lo[leaf], split[cut]), (hi[leaf], split[cut] + 1)))
        row, place, score = shard.scores(first, term, e_item, e_lo, e_hi)
        good = score >= kept.worst[e_item[row]]
        kept.add(e_item[row[good]], score[good], void[place[good]], doc[place[good]])
        c_item = np.concatenate((item[cut], item[cut]))
        c_lo, c_hi = np.concatenate((lo[cut], split[cut] + 1)), np.concatenate((split[cut], hi[cut]))
        some = c_hi > c_lo
        c_item, c_lo, c_hi = c_item[some], c_lo[some], c_hi[some]
        c_bound, c_split = shard.bounds(first, term, c_item, c_lo, c_hi)
        item, lo, hi, bound, split = (np.concatenate((x[rest], y)) for x, y in (
            (item, c_item), (lo, c_lo), (hi, c_hi), (bound, c_bound), (split, c_split)))
        take *= 2


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(void, doc_id, n, doc, term, tf) of index rows, cut to shards of bounded size."""
    waiting: list[tuple[np.ndarray, ...]] = []
    size = docs = 0

    def joined():
        base = np.cumsum([0] + [len(x[0]) for x in waiting])
        void, ids, n, doc, term, tf = zip(*waiting)
        return (*(np.concatenate(x) for x in (void, ids, n)),
                np.concatenate([d + b for d, b in zip(doc, base)]), np.concatenate(term), np.concatenate(tf))
    for b in batches:
        lists, ids = b.column("terms"), b.column("doc_id")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        term, tf = (b.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
        n = b.column("n").to_numpy()
        void = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
        doc_id = ids.cast(pa.int64()).fill_null(0).to_numpy()
        lo = 0
        while lo < b.num_rows:
            hi = int(np.searchsorted(offsets, offsets[lo] + SHARD_POSTINGS - size, "right")) - 1
            hi = min(max(hi, lo if waiting else lo + 1), lo + SHARD_DOCS - docs, b.num_rows)
            if hi > lo:
                part = slice(offsets[lo], offsets[hi])
                waiting.append((void[lo:hi], doc_id[lo:hi], n[lo:hi],
                                np.repeat(np.arange(hi - lo), np.diff(offsets[lo:hi + 1])), term[part], tf[part]))
                size, docs = size + int(offsets[hi] - offsets[lo]), docs + hi - lo
                lo = hi
            if lo < b.num_rows:
                yield joined()
                waiting, size, docs = [], 0, 0
    if waiting:
        yield joined()


def search_index(index: DataFrame, q: Queries) -> DataFrame:
    """``item, doc_id, score``: the best ``k`` documents of every item in each partition of ``index``."""
    shared = index.sparkSession.sparkContext.broadcast(q)  # at most ITEM_TERMS terms
    kind = index.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        kept = Kept(len(queries.first) - 1, queries.k)
        for void, ids, n, doc, term, tf in _shards(b for b in batches if b.num_rows):
            shard = Shard(queries, n, doc, term, tf)
            if len(shard.keys):
                search(shard, queries, kept, void, ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array(queries.item[kept.item]), pa.array(kept.doc, mask=kept.void.astype(bool)), pa.array(kept.score)], ["item", "doc_id", "score"])
    found = small_batches(index).mapInArrow(run, StructType([
        StructField(c, LongType()) for c in ("item", "doc_id", "score")]))
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def ranked_search(documents: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring documents of every item.

    ``documents`` has an integer doc_id and a text, ``items`` an item_id and a text. Terms are runs of
    ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased; they are compared by
    64-bit hashes. The rank counts from 1 by falling score, then rising doc_id, null ids last. Only scores
    above 0 count, so items without a common term, empty or null texts and empty tables give no rows. Rows
    that repeat an id are documents (or items) of their own; other columns are ignored.
    """
    wanted = item_terms(items)
    total = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, math.ceil(2 * total / ITEM_TERMS)) if total > ITEM_TERMS else 1
    none = items.sparkSession.createDataFrame([], StructType([
        StructField("item", LongType()), documents.schema["doc_id"], StructField("score", LongType())]))
    found = none
    for block in range(blocks):
        part = wanted.filter((F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) & (F.size("terms") > 0))
        found = found.unionByName(_search_block(documents, part.select("item", "terms").toArrow(), k, none))
    best = first_k_in_group(found, ["item"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k)
    return best.join(F.broadcast(wanted.select("item", "item_id")) if blocks == 1 else wanted.select("item", "item_id"), "item").select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _search_block(documents: DataFrame, part: pa.Table, k: int, none: DataFrame) -> DataFrame:
    """``item, doc_id, score`` of the best documents in each partition; ``part`` is at most a block of items."""
    if not part.num_rows:
        return none
    part = part.combine_chunks()
    lists = part["terms"].chunk(0)
    terms = lists.flatten().to_numpy().view(np.uint64)
    first = lists.offsets.to_numpy().astype(np.int64)
    vocabulary, place = np.unique(terms, return_inverse=True)
    index = durable(index_documents(documents, vocabulary))
    n_docs, n_terms = index.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return none
    df = index.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # one row a term of the block
    weight = np.zeros(len(vocabulary), np.int64)
    weight[df["term"].to_numpy()] = [term_weight(n_docs, x) for x in df["count"].to_pylist()]
    return search_index(index, Queries(part["item"].to_numpy(), first - first[0], place, weight, n_docs, n_terms, k))
