"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into chunks that overlap by the filter width less one, so every place of the text
is seen once by every filter. Filters run over bytes, the strongest response of each in a chunk
is kept, and chunk responses (with the chunk's best agreement with itself at a short lag) are
combined over the whole text by maximum and mean and fed to a small dense layer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.tables import arrow_map
from fleetlens.llm.words import slices, text_bytes

WIDTH, FILTERS, HIDDEN = 6, 16, 16
CHUNK = 250         # filter places in a chunk
LAGS = range(2, 42)
PAD = 256           # symbol after a text's end
FIT_ROWS = 3000     # labelled rows used at most, those with the smallest hashes
FIT_BYTES = 24_000_000  # bytes of their texts together; texts are learned from whole
PIECE = 4096        # chunks run through the filters at once
EPOCHS, RATE, BATCH = 12, 0.01, 64
SEGMENT = 1 << 16
PARTS = ("table", "bias", "w1", "b1", "w2", "b2")


def symbols(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte symbols of all texts, each followed by padding, and the place each text begins at."""
    sizes = np.maximum(1, np.diff(at))
    begin = np.concatenate([[0], np.cumsum(sizes + WIDTH - 1)])
    x = np.full(int(begin[-1]), PAD, np.uint16)
    n = np.diff(at)
    if n.sum():
        place = np.arange(int(n.sum())) + np.repeat(begin[:-1] - (np.cumsum(n) - n), n)
        x[place] = buf[at[0]:at[-1]]
    return x, begin


def chunk_starts(begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place and number of places of every chunk, and its text."""
    places = np.diff(begin) - WIDTH + 1
    chunks = -(-places // CHUNK)
    text = np.repeat(np.arange(len(places)), chunks)
    k = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    return begin[text] + k * CHUNK, np.minimum(CHUNK, places[text] - k * CHUNK), text


def responses(table: np.ndarray, x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Strongest response of each filter in each chunk; chunks ascend."""
    out = np.empty((len(start), FILTERS), np.float32)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + SEGMENT)))
        a, b = int(start[lo]), int(start[hi - 1] + size[hi - 1])
        total = table[0][x[a:b]]
        for k in range(1, WIDTH):
            total += table[k][x[a + k:b + k]]
        # places between two texts belong to no chunk
        edges = np.stack([start[lo:hi], start[lo:hi] + size[lo:hi]], axis=1).ravel() - a
        out[lo:hi] = np.maximum.reduceat(total, edges[:-1], axis=0)[::2]
        lo = hi
    return out


def self_match(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Largest share of places in each chunk that agree with the place one lag further on."""
    best = np.zeros(len(start), np.int32)
    if not len(start):
        return best.astype(np.float32)
    real = x != PAD
    edges = np.stack([start, start + size], axis=1).ravel()
    same = np.zeros(len(x) + 1, np.uint8)  # one more, so that an edge may lie at the end
    for lag in LAGS:
        if len(x) <= lag:
            break
        np.logical_and(x[:-lag] == x[lag:], real[:-lag], out=same[:len(x) - lag].view(bool))
        same[len(x) - lag:] = 0
        best = np.maximum(best, np.add.reduceat(same, edges, dtype=np.int32)[::2])
    return (best / size).astype(np.float32)


class ByteNetwork:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        inputs = 2 * FILTERS + 2
        self.table = rng.normal(0, 0.3, (WIDTH, PAD + 1, FILTERS)).astype(np.float32)
        self.table[:, PAD] = 0
        self.bias = np.zeros(FILTERS, np.float32)
        self.w1 = rng.normal(0, inputs ** -0.5, (inputs, HIDDEN)).astype(np.float32)
        self.b1 = np.zeros(HIDDEN, np.float32)
        self.w2 = rng.normal(0, HIDDEN ** -0.5, HIDDEN).astype(np.float32)
        self.b2 = np.zeros(1, np.float32)

    def pooled(self, raw: np.ndarray, match: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of the dense layer for texts whose chunks begin at ``first`` (ascending, no empty text)."""
        active = np.concatenate([np.maximum(raw + self.bias, 0), match[:, None]], axis=1)
        n = np.diff(np.append(first, len(raw)))[:, None]
        return np.concatenate([np.maximum.reduceat(active, first), np.add.reduceat(active, first) / n], axis=1), active

    def logits(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.w1 + self.b1)
        return h @ self.w2 + self.b2[0], h

    def score(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(at) < 2:
            return np.zeros(0)
        x, begin = symbols(buf, at)
        start, size, text = chunk_starts(begin)
        z, _ = self.pooled(responses(self.table, x, start, size), self_match(x, start, size), np.searchsorted(text, np.arange(len(at) - 1)))
        return 1 / (1 + np.exp(-self.logits(z)[0].astype(np.float64)))

    def fit(self, chunks: np.ndarray, match: np.ndarray, text: np.ndarray, good: np.ndarray, epochs: int = EPOCHS, seed: int = 2) -> None:
        """``chunks``: rows of CHUNK + WIDTH - 1 symbols, ordered by ``text``; ``good``: 0 or 1 per text."""
        rng = np.random.default_rng(seed)
        first = np.searchsorted(text, np.arange(len(good) + 1))
        moments = {p: [np.zeros_like(getattr(self, p)), np.zeros_like(getattr(self, p))] for p in PARTS}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(good))
            for lo in range(0, len(order), BATCH):
                docs = order[lo:lo + BATCH]
                rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
                counts = first[docs + 1] - first[docs]
                begin = np.cumsum(counts) - counts
                raw = np.empty((len(rows), FILTERS), np.float32)
                where = np.empty((len(rows), FILTERS), np.int64)
                for some in range(0, len(rows), PIECE):
                    x = chunks[rows[some:some + PIECE]]
                    total = self.table[0][x[:, :CHUNK]]
                    for k in range(1, WIDTH):
                        total += self.table[k][x[:, k:k + CHUNK]]
                    total[x[:, :CHUNK] == PAD] = -1e9
                    where[some:some + PIECE] = total.argmax(axis=1)
                    raw[some:some + PIECE] = np.take_along_axis(total, where[some:some + PIECE, None], axis=1)[:, 0]
                z, active = self.pooled(raw, match[rows], begin)
                logit, h = self.logits(z)
                error = (1 / (1 + np.exp(-logit)) - good[docs]) / len(docs)
                grad = {"w2": h.T @ error, "b2": np.array([error.sum()])}
                dh = error[:, None] * self.w2 * (1 - h * h)
                grad["w1"], grad["b1"] = z.T @ dh, dh.sum(axis=0)
                dz = dh @ self.w1.T
                part = np.repeat(np.arange(len(docs)), counts)
                half = FILTERS + 1
                d = dz[part, half:] / counts[part][:, None] + dz[part, :half] * (active == z[part, :half])
                d = d[:, :FILTERS] * (raw + self.bias > 0)
                grad["bias"] = d.sum(axis=0)
                table = np.zeros_like(self.table)
                filters = np.arange(FILTERS)
                for k in range(WIDTH):
                    flat = chunks[rows[:, None], where + k].astype(np.int64) * FILTERS + filters
                    table[k] = np.bincount(flat.ravel(), d.ravel(), (PAD + 1) * FILTERS).reshape(PAD + 1, FILTERS)
                table[:, PAD] = 0
                grad["table"] = table
                step += 1
                for p in PARTS:  # Adam
                    g, (m, v) = grad[p].astype(np.float32), moments[p]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    rate = RATE * (1 - 0.999 ** step) ** 0.5 / (1 - 0.9 ** step)
                    setattr(self, p, getattr(self, p) - rate * m / (np.sqrt(v) + 1e-7))


def held_out(doc_id: Column) -> Column:
    """Rows never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _chunked(batch: pa.RecordBatch) -> pa.RecordBatch:
    """All chunks of each text, as bytes (two each symbol), with their self-match."""
    x, begin = symbols(*text_bytes(batch.column(2)))
    start, size, text = chunk_starts(begin)
    match = self_match(x, start, size).astype(np.float64)
    first = np.searchsorted(text, np.arange(batch.num_rows + 1))
    x = np.append(x, np.full(CHUNK + WIDTH, PAD, np.uint16))
    rows = []
    for i in range(batch.num_rows):
        own = slice(first[i], first[i + 1])
        part = x[start[own][:, None] + np.arange(CHUNK + WIDTH - 1)]
        part[size[own][:, None] + WIDTH - 1 <= np.arange(CHUNK + WIDTH - 1)] = PAD
        rows.append(part.astype("<u2").tobytes())
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(rows, pa.binary()),
         pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(match))], ["doc_id", "good", "chunks", "match"])


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ByteNetwork | None:
    """A network learned from at most ``fit_rows`` labelled rows outside the held-out fold.

    Rows come in the order of the hashes of their ids until their texts have ``FIT_BYTES`` together; each
    text is used whole. Rows that repeat id and text count once.
    """
    sample = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.min("quality").alias("_good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    # the sample has at most fit_rows rows of two numbers
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(
        F.col("doc_id").cast("long"), F.col("_good").cast("int").alias("good"), F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64("text").alias("hash"))
    sizes = rows.groupBy("doc_id", "hash").agg(F.max(F.octet_length("text")).alias("size")).orderBy(
        F.xxhash64("doc_id"), "doc_id", "hash").limit(fit_rows).collect()
    total = np.cumsum([r["size"] for r in sizes])
    chosen = [(r.doc_id, r.hash) for i, r in enumerate(sizes) if i == 0 or total[i] <= FIT_BYTES]
    if not chosen:
        return None
    chosen = documents.sparkSession.createDataFrame(chosen, "doc_id long, hash long")
    texts = rows.join(F.broadcast(chosen), ["doc_id", "hash"]).groupBy("doc_id", "hash").agg(
        F.first("good").alias("good"), F.min("text").alias("text")).select("doc_id", "good", "text")
    got = arrow_map(texts, _chunked, "doc_id long, good int, chunks binary, match array<double>").collect()
    got = sorted(got, key=lambda r: (r.doc_id, r.good, bytes(r.chunks)))
    good = np.array([min(1, max(0, r.good)) for r in got], np.float32)
    if not len(good) or good.min() == good.max():
        return None
    parts = [np.frombuffer(r.chunks, "<u2").reshape(-1, CHUNK + WIDTH - 1) for r in got]
    network = ByteNetwork()
    network.fit(np.concatenate(parts), np.concatenate([np.array(r.match, np.float32) for r in got]),
                np.repeat(np.arange(len(got)), [len(p) for p in parts]), good)
    return network


def quality_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``documents`` (doc_id, text).

    ``score`` (0 to 1) is the network's probability of label 1 for the whole text, ``predicted`` is 1 from
    ``threshold`` on. The network is learned from ``labels`` (doc_id, quality 0 or 1) of rows whose
    crc32 of the id modulo 5 is not 0; only the text is an input.

    A null or empty text is scored as one place of padding. Repeated rows get equal scores, a null doc_id
    stays null and is not held out, other columns are not read. Labels without doc_id or quality
    are left out, of several the worst counts; when labels of only one kind or none are left,
    every score is 0.5. An empty table gives no rows.
    """
    network = fit(documents, labels, fit_rows)

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, at = text_bytes(batch.column(2))
        if network is None:
            s = np.full(batch.num_rows, 0.5)
        else:  # texts by about a megabyte; a larger one alone
            s = np.concatenate([network.score(buf, at[lo:hi + 1]) for lo, hi in slices(at, 1 << 20)])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                          ["doc_id", "held_out", "score", "predicted"])
    return arrow_map(documents.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text"), scored,
                     "doc_id long, held_out boolean, score double, predicted int")
