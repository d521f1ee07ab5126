"""Quality classifier: a byte-level convolutional network in numpy.

A text is laid out in chunks of 512 bytes whose windows reach 7 bytes into the next
chunk, so together they cover every byte and every window.  Each byte is embedded,
learned filters run over all windows of 8 bytes (every second byte), each filter is
max-pooled inside the chunk, and a dense layer turns the pooled values into the chunk's
logit.  The logits, weighted by the bytes they cover, average to one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.kernels import column, ranges, text_slices
from barloom.llm.scratch import on_workers

CHUNK, WINDOW, STRIDE, EMBED, FILTERS = 512, 8, 2, 4, 32
PER_CHUNK = CHUNK // STRIDE

#: Bytes of text handled at once.
SLICE = 1 << 19
#: Labelled rows of the training sample unless the caller says otherwise.
MAX_ROWS = 4000


@dataclass
class Network:
    """embed (256, EMBED), kernel (WINDOW * EMBED, FILTERS), bias, dense (FILTERS,), offset."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: float

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each laid-out chunk (n, CHUNK + WINDOW)."""
        out = np.empty((len(chunks), FILTERS), np.float32)
        for lo in range(0, len(chunks), 64):
            out[lo : lo + 64] = (_windows(self.embed[chunks[lo : lo + 64]]) @ self.kernel).reshape(-1, PER_CHUNK, FILTERS).max(1)
        return out

    def logits(self, chunks: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(chunks) + self.bias, 0) @ self.dense + self.offset


def _windows(embedded: np.ndarray) -> np.ndarray:
    """(n * PER_CHUNK, WINDOW * EMBED) from (n, CHUNK + WINDOW, EMBED)."""
    n = len(embedded)
    flat = np.ascontiguousarray(embedded.reshape(n, -1))
    s = flat.strides
    return np.lib.stride_tricks.as_strided(flat, (n, PER_CHUNK, WINDOW * EMBED), (s[0], STRIDE * EMBED * s[1], s[1])).reshape(n * PER_CHUNK, -1)


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zero-padded chunks with their overlap, the text of each, and the bytes it covers (1 at least)."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // CHUNK))
    owner = np.repeat(np.arange(len(size)), count)
    begin = ranges(np.zeros(len(size), np.int64), count) * CHUNK
    left = size[owner] - begin
    own = np.clip(left, 0, CHUNK + WINDOW)
    out = np.zeros((len(owner), CHUNK + WINDOW), np.uint8)
    at = ranges(offsets[:-1][owner] + begin, own)
    out.reshape(-1)[ranges(np.arange(len(owner)) * (CHUNK + WINDOW), own)] = data[at]
    return out, owner, np.clip(left, 1, CHUNK)


def sample(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", max_rows: int = MAX_ROWS) -> list:
    """All chunks of at most ``max_rows`` labelled rows, chosen by a hash of the key.

    Only ids are shuffled and only the chosen ids are broadcast; texts stay where they
    are, and the chosen ones come to the driver whole.  Rows with a null label or key are
    left out; a key labelled twice counts with its smaller label.
    """
    on_workers(df.sparkSession)
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("y"))
    chosen = marked.groupBy("k").agg(F.min("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(max_rows)
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches):
            chunks, owner, size = layout(data, offsets)
            for lo in range(0, len(chunks), 4096):
                own = pa.array(owner[lo : lo + 4096])
                part = chunks[lo : lo + 4096]
                yield pa.RecordBatch.from_pydict({"k": column(rows, "k").take(own), "y": column(rows, "y").take(own), "chunk": pa.array([x.tobytes() for x in part], pa.binary())})

    return rows.mapInArrow(cut, "k long, y int, chunk binary").collect()


def fit(rows: list, epochs: int = 16, batch: int = 128, rate: float = 4e-3, seed: int = 7) -> Network:
    """Train on the rows of ``sample`` with Adam.  Without rows every score is 0.5."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), rng.normal(0, (WINDOW * EMBED) ** -0.5, (WINDOW * EMBED, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), 0.0)
    net.embed[0] = 0
    if not rows:
        return net
    rows = sorted(rows, key=lambda r: (r.k, bytes(r.chunk)))
    x = np.frombuffer(b"".join(bytes(r.chunk) for r in rows), np.uint8).reshape(len(rows), CHUNK + WINDOW)
    y = np.array([r.y > 0 for r in rows], np.float32)
    keys, n_own = np.unique([r.k for r in rows], return_inverse=True, return_counts=True)[1:]
    weight = (1 / n_own[keys]).astype(np.float32)
    weight /= weight.mean()
    base = np.clip((weight * y).mean(), 0.02, 0.98)
    net.offset = float(np.log(base / (1 - base)))
    if 0 < y.sum() < len(y):
        net.dense[:] = rng.normal(0, FILTERS**-0.5, FILTERS)
    else:
        return net
    params = [net.embed, net.kernel, net.bias, net.dense, np.array([net.offset], np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, total = 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            pick = order[lo : lo + batch]
            grads = _gradients(net, x[pick], y[pick], weight[pick], params[4][0])
            step += 1
            lr = rate * (1 - step / (total + 1))
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
            net.embed[0] = 0
    net.offset = float(params[4][0])
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray, offset: float) -> list[np.ndarray]:
    n = len(x)
    windows = _windows(net.embed[x])
    z = (windows @ net.kernel).reshape(n, PER_CHUNK, FILTERS)
    top = z.argmax(1)
    pooled = np.maximum(np.take_along_axis(z, top[:, None], 1)[:, 0] + net.bias, 0)
    p = 1 / (1 + np.exp(-np.clip(pooled @ net.dense + offset, -30, 30)))
    d = ((p - y) * weight / n).astype(np.float32)
    g_pooled = np.where(pooled > 0, d[:, None] * net.dense, 0)
    hit = windows.reshape(n, PER_CHUNK, -1)[np.arange(n)[:, None], top]
    g_kernel = np.einsum("nf,nfk->kf", g_pooled, hit)
    g_windows = (g_pooled[:, :, None] * net.kernel.T).reshape(n, FILTERS, WINDOW, EMBED)
    bytes_at = x[np.arange(n)[:, None, None], (top * STRIDE)[:, :, None] + np.arange(WINDOW)]
    g_embed = np.stack([np.bincount(bytes_at.ravel(), g_windows[..., e].ravel(), 256) for e in range(EMBED)], 1).astype(np.float32)
    decay = 1e-4
    return [g_embed + decay * net.embed, g_kernel + decay * net.kernel, g_pooled.sum(0), pooled.T @ d + decay * net.dense, np.array([d.sum()], np.float32)]


def score(df: DataFrame, net: Network, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of label 1 (double) for each whole text.

    Null and empty texts are scored as one empty chunk.  A column already called ``out``
    is replaced; all other columns and repeated rows are kept.
    """
    on_workers(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != out]
    shipped = df.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shipped.value
        for rows, data, offsets in text_slices(batches, text, SLICE):
            chunks, owner, size = layout(data, offsets)
            n = len(offsets) - 1
            logit = np.bincount(owner, net.logits(chunks) * size, n) / np.bincount(owner, size, n)
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(column(rows, f.name) for f in kept), pa.array(p)], [*(f.name for f in kept), out])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.DoubleType())]))
