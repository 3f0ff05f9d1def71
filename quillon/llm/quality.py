"""Document quality by a byte-level convolutional network in numpy (operator 1).

Each byte has a learned vector of ``WIDTH`` numbers. ``FILTERS`` learned filters see windows of 8 bytes that begin at
every fourth byte; their rectified answers are averaged over chunks of 512 bytes that overlap by half and cover the
whole document. The largest average of each filter over all chunks goes into one logistic unit. One more filter sees the
products of a window and the one ``LAGS`` bytes before it, which tells repeats: bytes have a second learned vector for it, the
products of two bytes' vectors are weighed by learned weights and summed over the window, and the lag with the largest sum counts.

The network is fitted on a bounded sample of labelled rows (``training.SAMPLE_ROWS``) outside the held-out fifth, and
calibrated on a part of that sample that it was not fitted on. Text alone is scored: labels, lang, source and doc_id
are no inputs. Null texts count as empty; empty texts are one empty chunk and get a score too. Null ids are scored like others and
count as not held out. With no labelled row the score is 0.5; with one class only it is that class's smoothed share.
Repeated rows get equal scores, and extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import words as W
from quillon.llm.training import SAMPLE_ROWS, calibrate, held_out, labelled_sample, sigmoid

WIDTH, FILTERS, STRIDE, HALF = 8, 16, 4, 64  # HALF: windows in half a chunk
LAGS = range(2, 17)
EPOCHS, BATCH, SEED = 5, 32, 11


@dataclass
class Net:
    bytes: np.ndarray  # 256 x WIDTH
    filters: np.ndarray  # (2 * STRIDE * WIDTH) x FILTERS
    bias: np.ndarray
    twin: np.ndarray  # 256 x WIDTH, the bytes' vectors for products
    weigh: np.ndarray  # WIDTH weights of products and an offset
    out: np.ndarray  # FILTERS, the filter of products and an offset
    slope: float = 1.0
    offset: float = 0.0


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes on a grid of STRIDE with zeros after each document; the first window of each half chunk and of each gap;
    and the number of half chunks of each document."""
    size = np.diff(offsets)
    windows = np.maximum(1, -(-size // STRIDE))
    begin = np.concatenate([[0], np.cumsum(windows + 1)])
    grid = np.zeros(int(begin[-1]) * STRIDE + STRIDE, np.uint8)
    for i in range(len(size)):
        at = begin[i] * STRIDE
        grid[at : at + size[i]] = data[offsets[i] : offsets[i + 1]]
    halves = -(-windows // HALF)
    per = halves + 1  # and the gap
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    within = np.arange(per.sum()) - np.repeat(first, per)
    starts = np.repeat(begin[:-1], per) + np.minimum(within * HALF, np.repeat(windows, per))
    return grid, starts, halves


def products(net: Net, grid: np.ndarray, starts: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the largest sum of products with the window a lag before in the same document, and that lag."""
    pair = ((net.twin * net.weigh[:-1]) @ net.twin.T).ravel()  # what two bytes are worth together
    n = len(grid) // STRIDE - 1
    first = starts[np.concatenate([[0], np.cumsum(halves + 1)])[:-1]]
    place = STRIDE * (np.arange(n) - np.repeat(first, np.diff(np.append(first, n))))
    here = grid.astype(np.intp)
    wide, at, worth, one = here * 256, np.empty(len(grid), np.intp), np.zeros(len(grid), np.float32), np.ones(STRIDE, np.float32)
    best, lags = np.full(n, -np.inf, np.float32), np.zeros(n, np.int32)
    head = np.flatnonzero(place < LAGS[-1])  # windows at the beginning of a document
    for lag in LAGS:
        np.add(wide[lag:], here[:-lag], out=at[lag:])
        np.take(pair, at[lag:], out=worth[lag:], mode="clip")
        quarter = worth.reshape(-1, STRIDE) @ one
        found = quarter[:-1] + quarter[1:]
        found[head[place[head] < lag]] = -np.inf
        np.copyto(lags, lag, where=found > best)
        np.maximum(best, found, out=best)
    return best, lags


def forward(net: Net, grid: np.ndarray, starts: np.ndarray, halves: np.ndarray):
    rows = net.bytes[grid].reshape(-1, STRIDE * WIDTH)
    part = STRIDE * WIDTH
    act = rows[:-1] @ net.filters[:part]
    act += rows[1:] @ net.filters[part:]
    act += net.bias
    np.maximum(act, 0, out=act)
    best, lags = products(net, grid, starts, halves)
    act = np.column_stack([act, np.maximum(best + net.weigh[-1], 0)])
    per = halves + 1
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    sums = np.add.reduceat(act, starts, axis=0)
    length = np.diff(np.append(starts, len(act))).astype(np.float32)
    gap = first + halves
    sums[gap], length[gap] = 0, 0
    # chunk i: halves i and i + 1; after a document's last half comes its gap, which adds nothing
    joined, span = sums.copy(), length.copy()
    joined[:-1] += sums[1:]
    span[:-1] += length[1:]
    tail = np.zeros(len(sums), bool)  # the last half alone is covered by the chunk before it, if there is one
    tail[(gap - 1)[halves > 1]] = True
    tail[gap] = True
    mean = joined / np.maximum(span, 1)[:, None]
    mean[tail] = -1
    pooled = np.maximum.reduceat(mean, first, axis=0)
    return rows, act, lags, mean, span, first, pooled


def twin_gradient(net: Net, grid: np.ndarray, lags: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the products' vectors, and of their weights and offset, from that of the windows' answers."""
    at = np.flatnonzero(grad)
    here = (STRIDE * at[:, None] + np.arange(2 * STRIDE)).ravel()
    before = here - np.repeat(lags[at], 2 * STRIDE)
    worth = np.bincount(grid[here].astype(np.int64) * 256 + grid[before], np.repeat(grad[at], 2 * STRIDE), 65536).reshape(256, 256)
    scaled = net.twin * net.weigh[:-1]
    weigh = ((worth @ net.twin) * net.twin).sum(axis=0)
    return (worth @ scaled + worth.T @ scaled).astype(np.float32), np.append(weigh, grad.sum()).astype(np.float32)


def logits(net: Net, pooled: np.ndarray) -> np.ndarray:
    return pooled @ net.out[:-1] + net.out[-1]


def fit(texts: pa.Array, label: np.ndarray) -> Net:
    """Adam on the log loss, then calibration on the fifth of the rows that was left out."""
    rng = np.random.default_rng(SEED)
    part = STRIDE * WIDTH
    net = Net(
        rng.normal(0, 0.5, (256, WIDTH)).astype(np.float32),
        rng.normal(0, 0.25, (2 * part, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.35, (256, WIDTH)).astype(np.float32),
        np.append(np.ones(WIDTH), -5.0).astype(np.float32),
        np.append(rng.normal(0, 0.5, FILTERS + 1), 0).astype(np.float32),
    )
    n = len(label)
    if not n or label.min() == label.max():
        net.slope, share = 0.0, (label.sum() + 1) / (n + 2)
        net.offset = float(np.log(share / (1 - share)))
        return net
    data, offsets = W.flat(texts)
    check = np.arange(n) % 5 == 4
    if len(np.unique(label[check])) < 2 or len(np.unique(label[~check])) < 2:
        check[:] = False
    use = np.flatnonzero(~check)
    weights = {1: 0.5 * n / label.sum(), 0: 0.5 * n / (n - label.sum())}
    params = [net.bytes, net.filters, net.bias, net.twin, net.weigh, net.out]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    epochs = max(EPOCHS, min(60, 400 * BATCH // max(len(use), 1)))

    def pick(rows: np.ndarray):
        sizes = np.diff(offsets)[rows]
        return np.concatenate([data[offsets[i] : offsets[i + 1]] for i in rows]), np.concatenate([[0], np.cumsum(sizes)])

    for epoch in range(epochs):
        order = rng.permutation(use)
        for low in range(0, len(order), BATCH):
            batch = order[low : low + BATCH]
            grid, starts, halves = layout(*pick(batch))
            rows, act, lags, mean, span, first, pooled = forward(net, grid, starts, halves)
            y = label[batch]
            err = (sigmoid(logits(net, pooled)) - y) * np.where(y == 1, weights[1], weights[0]) / len(batch)
            err = err.astype(np.float32)
            g_out = np.append(pooled.T @ err, err.sum()).astype(np.float32) + 1e-4 * net.out
            g_pool = err[:, None] * net.out[:-1]
            # to the chunk with the largest mean, then to its windows
            g_mean = np.zeros_like(mean)
            per = halves + 1
            doc = np.repeat(np.arange(len(batch)), per)
            top = mean == pooled[doc]
            top &= mean >= 0
            order_top = np.cumsum(top, axis=0)
            before = np.concatenate([np.zeros((1, FILTERS + 1), order_top.dtype), order_top[:-1]])[first]
            top &= (order_top - before[doc]) == 1
            g_mean[top] = g_pool[doc][top]
            g_half = g_mean / np.maximum(span, 1)[:, None]
            g_sum = g_half.copy()
            g_sum[1:] += g_half[:-1]
            g_sum[first + halves] = 0
            g_act = np.repeat(g_sum, np.diff(np.append(starts, len(act))), axis=0)
            g_act[act <= 0] = 0
            g_twin, g_weigh = twin_gradient(net, grid, lags, g_act[:, FILTERS])
            g_act = np.ascontiguousarray(g_act[:, :FILTERS])
            g_filters = np.concatenate([rows[:-1].T @ g_act, rows[1:].T @ g_act])
            g_rows = np.zeros_like(rows)
            g_rows[:-1] += g_act @ net.filters[:part].T
            g_rows[1:] += g_act @ net.filters[part:].T
            g_cells = g_rows.reshape(-1, WIDTH)
            g_bytes = np.stack([np.bincount(grid, g_cells[:, k], 256) for k in range(WIDTH)], 1).astype(np.float32)
            t += 1
            rate = 0.01 * (1 - 0.9 * epoch / epochs)
            for p, g, a, b in zip(params, [g_bytes, g_filters, g_act.sum(0), g_twin, g_weigh, g_out], m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    rows = np.flatnonzero(check) if check.any() else use
    net.slope, net.offset = calibrate(_raw(net, *pick(rows)), label[rows])
    net.slope = max(net.slope, 0.0)
    W.release()
    return net


def _raw(net: Net, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Logits in parts, to bound memory: a part has some 256 KB, a longer text is a part of its own."""
    out, at, n = [np.zeros(0)], 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 262_144, "right")) - 1)
        part = forward(net, *layout(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]))
        out.append(logits(net, part[-1]).astype(np.float64))
        at = to
    return np.concatenate(out)


def score(net: Net, texts: pa.Array) -> np.ndarray:
    return sigmoid(net.slope * _raw(net, *W.flat(texts)) + net.offset)


def scores(docs: DataFrame, net: Net) -> DataFrame:
    """``docs`` (with a column text and any others) and the column score, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text", 8_000_000):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(net, batch.column("text")), pa.float64())], [*batch.schema.names, "score"])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("score", DoubleType()))


def classify(docs: DataFrame, labels: DataFrame, train: DataFrame | None = None, threshold: float = 0.3, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; fitted on labelled rows of ``train`` (default: ``docs``)."""
    net = fit(*labelled_sample(docs if train is None else train, labels, rows=rows))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # only the id and the score leave the network
    scored = scores(text, net).select("doc_id", "score")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def sift(docs: DataFrame, labels: DataFrame, train: DataFrame | None = None, threshold: float = 0.3, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``threshold``; judged where they lie, without a join."""
    net = fit(*labelled_sample(docs if train is None else train, labels, rows=rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text", 8_000_000):
                yield batch.filter(pa.array(score(net, batch.column("text")) >= threshold))

    return docs.mapInArrow(run, docs.schema)
