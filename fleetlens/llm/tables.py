"""Small helpers of the training-data operators: batches, graph components, fixed-size filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetlens.session import durable


BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; the session hands rows to Python in batches of ``BATCH_BYTES`` at most.

    A batch is held on both sides at once, so its size bounds the memory of a task. A row
    larger than that is a batch of its own. A lower setting of the session stays.
    """
    conf = df.sparkSession.conf
    now = str(conf.get(_BATCH)).removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def arrow_map(df: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch | None],
              schema: str | StructType) -> DataFrame:
    """``df`` through ``run``, one Arrow batch at a time."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := run(b)) is not None:
                yield out
    return small_batches(df).mapInArrow(each, schema)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


SMALL_ROWS = 500_000  # rows of two numbers that may be broadcast, about 10 MB


def without_rows(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """``documents`` without the rows whose (doc_id, hash of text) is listed in ``gone`` (doc_id, text_hash).

    The list is written once and counted; only a short one is broadcast, a long one meets the
    documents in a shuffled join. Null ids are equal to each other; rows with a null text are
    listed by the hash of null; all columns stay, whatever they are called.
    """
    a, b = free_names(documents, "_doc", "_hash")
    gone = durable(gone.select(F.col("doc_id").alias(a), F.col("text_hash").alias(b)).distinct())
    same = F.col("doc_id").eqNullSafe(F.col(a)) & (F.xxhash64("text") == F.col(b))
    return documents.join(F.broadcast(gone) if gone.count() <= SMALL_ROWS else gone, same, "left_anti")


def single_rows(documents: DataFrame, repeated: DataFrame) -> DataFrame:
    """``documents`` with one of the rows of each (doc_id, hash of text) in ``repeated`` (doc_id, text_hash), a written table.

    Of rows that differ in other columns the one with the smallest hash of them stays.
    """
    if repeated.isEmpty():
        return documents
    a, b, row = free_names(documents, "_doc", "_hash", "_row")
    keys = repeated.select(F.col("doc_id").alias(a), F.col("text_hash").alias(b))
    keys = F.broadcast(keys) if keys.count() <= SMALL_ROWS else keys
    same = F.col("doc_id").eqNullSafe(F.col(a)) & (F.xxhash64("text") == F.col(b))
    hashed = [c for c, kind in documents.dtypes if "map<" not in kind and "variant" not in kind]
    one = (documents.join(keys, same).groupBy(a, b)  # a minimum on the map side first
           .agg(F.min_by(F.struct(*documents.columns), F.xxhash64(*hashed)).alias(row)).select(f"{row}.*"))
    return documents.join(keys, same, "left_anti").unionByName(one)


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``edges`` (a, b: long, not null).

    Alternating large-star and small-star steps: every step keeps at most as many edges as
    there were, and a node with very many edges is only ever grouped by a map-side minimum.
    """
    def canonical(e: DataFrame) -> DataFrame:
        return (e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .filter("a <> b").distinct())

    def both(e: DataFrame) -> DataFrame:
        return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    nodes = durable(both(edges.select("a", "b")).select(F.col("a").alias("node")).distinct())
    edges = durable(canonical(edges))
    before = None
    while True:
        wide = both(edges)
        least = wide.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        edges = wide.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = canonical(edges)  # large star
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(least, "a")
        edges = durable(canonical(small.select(F.col("b").alias("a"), F.col("m").alias("b"))
                                  .union(least.select("a", F.col("m").alias("b")))))
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            break
        before = now
    # stable edges form stars around the smallest node
    return nodes.join(edges.withColumnsRenamed({"a": "node", "b": "m"}), "node", "left").select(
        "node", F.coalesce("m", "node").alias("component"))


MAX_BITS = 1 << 27   # 16 MB, however many values there are
PROBES = (0, 19, 37)  # three parts of a 64-bit hash


def bit_table(hashes: DataFrame, column: str, max_bits: int = MAX_BITS) -> np.ndarray:
    """A table of bits with three bits set for every hash (long), a Bloom filter.

    It only saves work: a value that is not found cannot be among ``hashes``, one that is found
    may be. Its size is bounded, so the driver holds at most ``max_bits`` bits; very many values
    merely let more through.
    """
    n = hashes.count()
    size = min(max_bits, 1 << max(16, (64 * n).bit_length()))
    slot = F.explode(F.array(*[F.shiftrightunsigned(F.col(column), p).bitwiseAND(F.lit(size - 1)) for p in PROBES]))
    words = (hashes.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63L AS int))")).alias("bits")).toArrow())
    bits = np.zeros(size // 64, np.uint64)
    bits[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bits


def in_bits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for p in PROBES:
        slot = (hashes >> np.uint64(p)) & np.uint64(len(bits) * 64 - 1)
        found &= ((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)
    return found
