"""Packing of token sequences as vector bin packing.

An example asks for three things at once: tokens, a segment and loss-bearing tokens. The open
sequence has a rest of each. Among a pool of waiting examples the one with the largest dot
product of demand and rest that fits is placed next; if none fits, the one with the largest
product is cut so that the sequence becomes full. Each partition packs its own examples in a
stream with a pool of fixed size; what is left at its end goes into sequences whose lengths
are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fleetlens.llm.tables import small_batches
from fleetlens.llm.tokens import text_ids, tokenizer
from fleetlens.llm.words import text_bytes

POOL = 256  # examples that wait at a time in a partition
END_ID = 1
SCHEMA = ("doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


class Packer:
    """Places examples; ``out`` collects finished pieces (example, start, length, sequence, offset)."""

    def __init__(self, tokens: int, segments: int, loss: int, first_sequence: int):
        self.limit = np.array([tokens, segments, loss], np.float64)
        self.examples: list[object] = [None] * POOL
        self.left = np.zeros(POOL, np.int64)    # tokens not placed yet; 0: the slot is free
        self.size = np.zeros(POOL, np.int64)
        self.prompt = np.zeros(POOL, np.int64)  # tokens at the front without loss
        self.free = list(range(POOL - 1, -1, -1))
        self.sequence = first_sequence
        self.rest = self.limit.copy()
        self.open: list[tuple[object, int, int]] = []
        self.out: list[tuple[object, int, int, int, int]] = []

    def add(self, example: object, size: int, prompt: int = 0) -> None:
        if not self.free:
            self._step()
            while not self.free:
                self._step()
        i = self.free.pop()
        self.examples[i], self.left[i], self.size[i], self.prompt[i] = example, size, size, min(prompt, size)

    def _loss(self, start, length):
        return np.maximum(0, length - np.maximum(0, self.prompt - start))

    def _step(self) -> None:
        """One piece of one example."""
        start = self.size - self.left
        loss = self._loss(start, self.left)
        score = (self.left * (self.rest[0] / self.limit[0] ** 2) + self.rest[1] / self.limit[1] ** 2
                 + loss * (self.rest[2] / self.limit[2] ** 2))
        fits = (self.left > 0) & (self.left <= self.rest[0]) & (loss <= self.rest[2])
        if self.rest[1] == 1:  # the last segment should fill the sequence
            fits &= (self.left == self.rest[0]) | (loss == self.rest[2])
        whole = fits.any()
        i = int(np.argmax(np.where(fits if whole else self.left > 0, score, -1.0)))
        length = int(self.left[i])
        if not whole:
            length = int(min(length, self.rest[0]))
            quiet = max(0, int(self.prompt[i] - start[i]))
            length = int(min(length, quiet + self.rest[2]))
        if length:
            self.open.append((self.examples[i], int(start[i]), length))
            self.rest -= (length, 1, max(0, length - max(0, int(self.prompt[i] - start[i]))))
            self.left[i] -= length
            if not self.left[i]:
                self.examples[i] = None
                self.free.append(i)
        if not length or self.rest[0] <= 0 or self.rest[1] <= 0:
            self._close(self.open)

    def _close(self, pieces: list[tuple[object, int, int]]) -> None:
        at = 0
        for example, start, length in pieces:
            self.out.append((example, start, length, self.sequence, at))
            at += length
        self.sequence += 1
        self.open, self.rest = [], self.limit.copy()

    def finish(self) -> None:
        while len(self.free) < POOL:
            self._step()
        pieces = self.open[::-1]
        total = sum(p[2] for p in pieces)
        while total:  # largest power of two first
            want = 1 << (total.bit_length() - 1)
            total -= want
            some = []
            while want:
                example, start, length = pieces.pop()
                take = min(want, length)
                some.append((example, start, take))
                want -= take
                if take < length:
                    pieces.append((example, start + take, length - take))
            self._close(some)


def _packed(path: str, tokens: int, segments: int, loss: int, with_ids: bool):
    def rows(done: list[tuple]) -> pa.RecordBatch:
        ids = [e[1][s:s + n].astype("<u4").tobytes() for e, s, n, _, _ in done]
        return pa.RecordBatch.from_arrays([
            pa.array([e[0] for e, *_ in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()),
            pa.array([x[2] for x in done], pa.int64()), pa.array(ids if with_ids else [None] * len(done), pa.binary()),
            pa.array([zlib.crc32(b) for b in ids], pa.int64()), pa.array([len(e[1]) for e, *_ in done], pa.int64()),
            pa.array([x[3] for x in done], pa.int64()), pa.array([x[4] for x in done], pa.int64())],
            ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(tokens, segments, loss, TaskContext.get().partitionId() << 33)
        t = tokenizer(path)
        for b in batches:
            doc = b.column(0).to_pylist()
            quiet = b.column(2).fill_null(0).to_pylist()
            buf, at = text_bytes(b.column(1))
            for i, ids in enumerate(text_ids(t, buf, at)):
                ids = np.append(ids, np.uint32(END_ID))
                packer.add((doc[i], ids), len(ids), min(quiet[i], len(ids)))
                if len(packer.out) >= 2000:
                    yield rows(packer.out)
                    packer.out = []
        packer.finish()
        if packer.out:
            yield rows(packer.out)
    return run


def pack(documents: DataFrame, tokenizer_path: str, tokens: int = 2048, segments: int = 256,
         loss_tokens: int = 2048, prompt_column: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of all examples: ``doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset``.

    An example is a row of ``documents`` (doc_id, text): its ids, then id 1. The first
    ``prompt_column`` ids of a row carry no loss (none by default). A sequence has at most
    ``tokens`` ids, ``segments`` pieces and ``loss_tokens`` loss-bearing ids; pieces lie without gaps
    from offset 0, and every id is in exactly one piece. ``ids`` are little-endian unsigned 32-bit
    numbers (null without ``with_ids``). Sequence ids are unique, not consecutive.

    A null or empty text is the example of id 1 alone. Rows with a null doc_id and repeated rows
    are examples of their own; other columns are not read. An empty table gives an empty result.
    """
    from pyspark.sql import functions as F
    prompt = F.lit(0).cast("long") if prompt_column is None else F.greatest(F.lit(0), F.col(prompt_column)).cast("long")
    return small_batches(documents.select("doc_id", "text", prompt.alias("_prompt"))).mapInArrow(
        _packed(tokenizer_path, tokens, segments, loss_tokens, with_ids), SCHEMA)
