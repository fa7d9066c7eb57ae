"""Near-duplicate documents by an inverted join over MinHash coordinates.

1. Every text becomes a set of word shingles, a set key and a signature of ``COORDINATES``
   minima. Texts with equal sets form one class, and only classes go on.
2. A class is posted under its (coordinate, value) pairs. Pairs of classes that agree on at
   least ``matches`` coordinates must meet under one of the ``COORDINATES - matches + 1`` rarest
   pairs of each (prefix filter), so values that only one class has are never posted, and values
   that very many classes have are skipped unless a class has nothing rarer.
3. Classes that meet under a posting form clusters. A cluster is settled on full shingle sets in
   one task, or, beyond ``cluster_limit`` set entries, in several blocks.

In a task a class is compared with all others through an inverted index of shingles; classes
that already are in the largest component are not compared with each other, so a group of n
copies costs n steps and not n * n.

The signature threshold is so low that a pair at the similarity limit is missed with a
probability below 2e-5; every link that is reported is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.tables import arrow_map, components, single_rows, small_batches, without_rows
from fleetlens.llm.words import find_words, mix, slices, text_bytes
from fleetlens.session import durable

COORDINATES = 32
CLUSTER_LIMIT = 4_000_000  # shingles compared in one task
_rng = np.random.default_rng(7)
_MULT = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEY = np.uint64(0xD6E8FEB86659FD93)


def matches_needed(percent: int, coordinates: int = COORDINATES, miss: float = 2e-5) -> int:
    """Largest count that a pair at ``percent`` similarity falls short of with a chance below ``miss``."""
    from math import comb
    p, below = percent / 100, 0.0
    for k in range(coordinates + 1):
        below += comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if below >= miss:
            return max(1, k)
    return coordinates


def shingle_sets(buf: np.ndarray, at: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: ``size`` words, or the whole of a shorter text."""
    for lo, hi in slices(at):
        w = find_words(buf, at[lo:hi + 1], lower=True)
        n = max(0, len(w.hash) - size + 1)
        full = np.zeros(n, np.uint64)
        for k in range(size):
            full += w.hash[k:k + n] * _PLACE[k]
        full = mix(full)
        for i in range(hi - lo):
            a, b = w.first[i], w.first[i + 1]
            if b - a >= size:
                yield np.unique(full[a:b - size + 1])
            elif b > a:
                h = (w.hash[a:b] * _PLACE[:b - a]).sum(dtype=np.uint64, keepdims=True)
                yield mix(h ^ _PLACE[-1 - (b - a)])
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 2048):
        low = np.minimum(low, (shingles[i:i + 2048, None] * _MULT).min(axis=0))
    return low


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone."""
    total, odd = shingles.sum(dtype=np.uint64), mix(shingles ^ _KEY).sum(dtype=np.uint64)
    return int(total.view(np.int64)), int(odd.view(np.int64))


def _signed(size: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, at = text_bytes(batch.column("text"))
        n, keys, sigs = [], [], []
        for s in shingle_sets(buf, at, size):
            n.append(len(s))
            keys.append(set_key(s))
            sigs.append(signature(s) >> np.uint64(16) if len(s) else np.zeros(COORDINATES, np.uint64))
        # 48 bits of each minimum: chance agreement does not matter, links are confirmed later
        flat = pa.array(np.concatenate(sigs).astype(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * COORDINATES, pa.int32()), flat)
        k = np.array(keys, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), lists],
            ["doc_id", "text_hash", "n_shingles", "k1", "k2", "sig"])
    return run


def _sets(size: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        buf, at = text_bytes(batch.column("text"))
        k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
        keep, sets = [], []
        for i, s in enumerate(shingle_sets(buf, at, size)):
            if set_key(s) == (k1[i], k2[i]):  # another row with the same doc_id may have another text
                keep.append(i)
                sets.append(s)
        if not keep:
            return None
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        flat = pa.array(np.concatenate(sets).view(np.int64))
        rest = batch.select(["cluster", "chunk", "cid"]).take(pa.array(keep))
        return pa.RecordBatch.from_arrays(
            [*rest.columns, pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), flat).cast(pa.list_(pa.int64()))],
            ["cluster", "chunk", "cid", "shingles"])
    return run


class Overlaps:
    """Inverted index of shingle sets; the overlap of one set with all others in one count."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.values, self.begin = np.unique(flat[order], return_index=True)
        self.begin = np.append(self.begin, len(flat))

    def linked(self, s: np.ndarray, percent: int) -> np.ndarray:
        """Positions of the sets linked with ``s``."""
        at = np.searchsorted(self.values, s)
        at = at[(at < len(self.values))]
        at = at[np.isin(self.values[at], s, assume_unique=True)]
        begin, n = self.begin[at], self.begin[at + 1] - self.begin[at]
        if not n.sum():
            return np.zeros(0, np.int64)
        take = np.arange(n.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        both = np.bincount(self.owner[take], minlength=len(self.sizes))
        return np.flatnonzero((both > 0) & (100 * both >= percent * (self.sizes + len(s) - both)))


class Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def join(self, i: int, others: np.ndarray) -> None:
        roots = np.unique(self.roots()[np.append(others, i)])
        self.up[roots] = roots[0]


def settle(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component (smallest position) of every set, linking at ``percent`` similarity.

    Each step compares one set with all. It ends when all sets that have not been compared are
    in one component: any two of them need no link, and every other pair has been compared.
    """
    forest, index = Forest(len(sets)), Overlaps(sets)
    waiting = np.ones(len(sets), bool)
    while True:
        roots = forest.roots()
        left = np.flatnonzero(waiting)
        if not len(left):
            return roots
        kinds, counts = np.unique(roots[left], return_counts=True)
        if len(kinds) == 1:
            return roots
        main = kinds[np.argmax(counts)]
        i = int(left[roots[left] != main][0])
        waiting[i] = False
        forest.join(i, index.linked(sets[i], percent))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows with equal keys, of sorted batches."""
    held: list[pa.Table] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        k = np.stack([t.column(x).to_numpy() for x in keys])
        cuts = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
        edges = [0, *cuts.tolist(), t.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            key = tuple(k[:, lo])
            if last is not None and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.concat_tables(held)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for c in column.chunks:
        at, flat = c.offsets.to_numpy(), c.values.to_numpy().view(np.uint64)
        out += [flat[a:b] for a, b in zip(at, at[1:])]
    return out


def _settled(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["cluster", "chunk"]):
            cid, at = np.unique(t.column("cid").to_numpy(), return_index=True)
            if len(cid) < 2:
                continue
            all_sets = _lists(t.column("shingles"))
            roots = settle([all_sets[i] for i in at], percent)
            moved = np.flatnonzero(roots != np.arange(len(cid)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(cid[moved]), pa.array(cid[roots[moved]])], ["a", "b"])
    return run


def _crossed(percent: int):
    """Links between the rows marked as left over and all other rows of a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["cluster", "chunk", "part"]):
            over = t.column("over").to_numpy()
            sets, cid = _lists(t.column("shingles")), t.column("cid").to_numpy()
            forest, index = Forest(len(cid)), Overlaps(sets)
            for i in np.flatnonzero(over):
                forest.join(int(i), index.linked(sets[i], percent))
            roots = forest.roots()
            moved = np.flatnonzero((roots != np.arange(len(cid))) & (cid != cid[roots]))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(cid[moved]), pa.array(cid[roots[moved]])], ["a", "b"])
    return run


def _by_group(df: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    return small_batches(df).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def class_components(classes: DataFrame, documents: DataFrame, repeated: DataFrame, size: int, percent: int,
                     cluster_limit: int) -> DataFrame:
    """``cid, root`` of every class that is linked with another one.

    The text of a class is that of the document (id, hash of text) that stands for it; ``repeated``, a
    written table, lists the (doc_id, text_hash) that several rows share.
    """
    need = matches_needed(percent)
    tokens = classes.select("cid", F.posexplode("sig").alias("place", "value")).select(
        "cid", (F.shiftleft(F.col("place").cast("long"), 48).bitwiseOR(F.col("value"))).alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    # values that only one class has come first in the order by rarity and need no posting
    prefix = (tokens.join(common, "token").groupBy("cid")
              .agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("own"))
              .filter(F.size("own") >= need)
              .select("cid", F.explode(F.slice("own", 1, F.size("own") - need + 1)).alias("p"))
              .select("cid", F.col("p.token").alias("token")))
    prefix = durable(prefix)
    hubs = prefix.groupBy("token").agg(F.min("cid").alias("hub"))
    meets = components(prefix.join(hubs, "token").filter("cid <> hub")
                       .select(F.col("cid").alias("a"), F.col("hub").alias("b")))
    member = durable(meets.withColumnsRenamed({"node": "cid", "component": "cluster"})
                     .join(classes.select("cid", "rep", "k1", "k2", "n_shingles"), "cid"))
    weight = member.groupBy("cluster").agg(
        F.ceil(F.sum("n_shingles") / cluster_limit).cast("int").alias("chunks"))
    large = durable(weight.filter("chunks > 1"))  # their weight bounds their number
    placed = member.join(weight, "cluster").withColumn(
        "chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")).drop("chunks")
    rows = documents.select(F.col("doc_id").cast("long").alias("t_id"), F.xxhash64("text").alias("t_hash"), "text")
    placed = placed.select("cluster", "chunk", "cid", "k1", "k2", F.col("rep.doc_id").alias("r_id"), F.col("rep.text_hash").alias("r_hash"))
    columns = ["cluster", "chunk", "cid", "k1", "k2", "text"]
    meets = rows.join(placed, F.col("t_id").eqNullSafe(F.col("r_id")) & (F.col("t_hash") == F.col("r_hash")))
    texts = meets.select(columns)
    if not repeated.isEmpty():  # of rows that share id and text one is enough, taken on the map side
        many = F.col("r_id").eqNullSafe(F.col("doc_id")) & (F.col("r_hash") == F.col("text_hash"))
        one = meets.join(repeated, many, "left_semi").groupBy(*columns[:-1]).agg(F.min("text").alias("text"))
        texts = meets.join(repeated, many, "left_anti").select(columns).union(one.select(columns))
    sets = arrow_map(texts, _sets(size), "cluster long, chunk int, cid long, shingles array<long>")
    if large.isEmpty():
        links = durable(_by_group(sets, ["cluster", "chunk"], _settled(percent), "a long, b long"))
        return links.select(F.col("a").alias("cid"), F.col("b").alias("root"))
    sets = durable(sets)
    links = durable(_by_group(sets, ["cluster", "chunk"], _settled(percent), "a long, b long"))
    inside = sets.join(large, "cluster").dropDuplicates(["cid"])
    roots = inside.select("cluster", "cid", F.size("shingles").alias("n")).join(
        components(links).withColumnsRenamed({"node": "cid", "component": "root"}), "cid", "left"
    ).withColumn("root", F.coalesce("root", "cid"))
    main = (roots.groupBy("cluster", "root").count().groupBy("cluster")
            .agg(F.max_by("root", "count").alias("main")))
    over = durable(roots.join(main, "cluster").filter("root <> main").select("cluster", "cid", "n"))
    parts = over.groupBy("cluster").agg(F.ceil(F.sum("n") / cluster_limit).cast("int").alias("parts"))
    # every left-over class meets every class of its cluster once: (part of the left-over) x (chunk)
    left = (over.join(parts, "cluster").join(large, "cluster")
            .withColumn("part", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("parts")).cast("int"))
            .select("cid", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
            .join(inside.select("cid", "cluster", "shingles"), "cid").withColumn("over", F.lit(True)))
    right = (inside.join(parts, "cluster")
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("over", F.lit(False)))
    cols = ["cluster", "chunk", "part", "over", "cid", "shingles"]
    more = _by_group(left.select(cols).union(right.select(cols)), ["cluster", "chunk", "part"],
                     _crossed(percent), "a long, b long")
    return components(links.union(more)).withColumnsRenamed({"node": "cid", "component": "root"})


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80,
                    cluster_limit: int = CLUSTER_LIMIT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``documents`` (doc_id, text).

    Words are runs of characters other than blank and \\x09-\\x0D with A-Z lower-cased. The set of
    a text is its distinct shingles of ``size`` words, or the whole sequence when it has fewer.
    Texts are linked when ``100 * intersection >= percent * union``; ``component_id`` is the
    smallest doc_id reachable over links, and ``kept`` tells whether that is the row's own.

    A null or empty text, or one without words, has ``n_shingles`` 0 and is linked with nothing.
    Rows with a null doc_id take part with a null id, which is never the smallest of a mixed
    group. Repeated rows stay repeated and are kept or not together, since they share their
    doc_id. Other columns are not read. An empty table gives an empty result.
    """
    return _named(documents, size, percent, cluster_limit).drop("text_hash", "root")


def drop_near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80,
                         cluster_limit: int = CLUSTER_LIMIT) -> DataFrame:
    """``documents`` with exactly one row of each component of ``near_duplicates``; all columns stay.

    The smallest doc_id stays (a null one only if the component has no other), of its texts the
    one with the smallest hash, and of repeated rows one. Rows without words are linked with nothing, so all stay.
    """
    rows = durable(_named(documents, size, percent, cluster_limit).filter("n_shingles > 0")
                   .groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    mate = rows.groupBy("root").agg(F.min(order).alias("first")).select(F.col("root").alias("of"), "first")
    marked = durable(rows.join(mate, F.col("root") == F.col("of")).select(
        "doc_id", "text_hash", "n", (order == F.col("first")).alias("chosen")))
    return single_rows(without_rows(documents, marked.filter("NOT chosen")), marked.filter("chosen AND n > 1"))


def _named(documents: DataFrame, size: int, percent: int, cluster_limit: int) -> DataFrame:
    docs = durable(arrow_map(documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text"), _signed(size),
                             "doc_id long, text_hash long, n_shingles long, k1 long, k2 long, sig array<long>"))
    classes = durable(
        docs.filter("n_shingles > 0").groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("doc_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("rep"),
             F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
        .withColumn("cid", F.monotonically_increasing_id()))
    repeated = durable(docs.groupBy("doc_id", "text_hash").count().filter("count > 1").select("doc_id", "text_hash"))
    found = class_components(classes, documents, repeated, size, percent, cluster_limit)
    named = classes.select("cid", "k1", "k2", "doc_id").join(found, "cid", "left").withColumn(
        "root", F.coalesce("root", "cid"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    names = named.join(smallest, "root").select("k1", "k2", "component_id", "root")
    own = docs.select("doc_id", "text_hash", "n_shingles", "k1", "k2")
    cols = ["doc_id", "text_hash", "n_shingles", "component_id", "root"]
    some = own.filter("n_shingles > 0").join(names, ["k1", "k2"]).select(cols)
    none = own.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("root", F.lit(None).cast("long")).select(cols)
    return some.union(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
