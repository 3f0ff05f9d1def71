"""Quality rules over whole texts (operator 5).

Base rules count words, symbols, repeated lines and repeated 8-word windows. The verdict on what passes them is a
logistic regression over hashed word n-grams (1 and 2 words) and character n-grams (4 bytes), fitted on a bounded
sample of labelled rows outside the held-out fifth, calibrated on rows it was not fitted on, and scored in Arrow
batches; a row is kept at a probability of ``KEEP`` or more.

Words are ``[^\\x20\\x09-\\x0D]+``, with case. Null and empty texts have no words and fail the base rules. Repeated
rows and ties are judged alike; null ids are kept in the result; extra columns are ignored. Without labelled rows of
both classes every row that passes the base rules is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import words as W
from quillon.llm.training import SAMPLE_ROWS, calibrate, labelled_sample, sigmoid

BITS, GRAM, WINDOW, KEEP = 17, 4, 8, 0.3
LEAST_WORDS, REPEAT_PERCENT = 20, 30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


@dataclass
class Model:
    weights: np.ndarray | None = None  # one row each for words, pairs of words and characters
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0


def _sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:last[i]]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[np.maximum(last, first)] - total[first]


def grams(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, first: np.ndarray):
    """For each kind of n-gram: buckets in text order, and where each row's begin and end."""
    shift = np.uint64(64 - BITS)
    pairs = W.mix(h[:-1] * W.M1 + h[1:]) >> shift if len(h) > 1 else np.zeros(0, np.uint64)
    if len(data) >= GRAM:
        c = data[: len(data) - GRAM + 1].astype(np.uint32)
        for j in range(1, GRAM):
            c |= data[j : len(data) - GRAM + 1 + j].astype(np.uint32) << np.uint32(8 * j)
        c *= np.uint32(2654435761)
        c >>= np.uint32(32 - BITS)
    else:
        c = np.zeros(0, np.uint32)
    cut = lambda a, b, k, n: (np.minimum(a, n), np.minimum(np.maximum(a, b - k + 1), n))
    return [
        (h >> shift, *cut(first[:-1], first[1:], 1, len(h))),
        (pairs, *cut(first[:-1], first[1:], 2, len(pairs))),
        (c, *cut(offsets[:-1], offsets[1:], GRAM, len(c))),
    ]


def raw(model: Model, kinds) -> np.ndarray:
    total = model.bias
    for w, (bucket, a, b) in zip(model.weights, kinds, strict=True):
        total = total + _sums(w[bucket], a, b) / np.maximum(b - a, 1)
    return total


def _sparse(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, share) of every n-gram of some texts."""
    with np.errstate(over="ignore"):
        data, offsets = W.flat(texts)
        h, _, _, first = W.words(data, offsets, lower=False)
        kinds = grams(data, offsets, h, first)
    rows, cols, vals = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
    for kind, (bucket, a, b) in enumerate(kinds):
        for i in np.flatnonzero(b > a):
            u, c = np.unique(bucket[a[i] : b[i]], return_counts=True)
            rows.append(np.full(len(u), i, np.int32))
            cols.append(u.astype(np.int32) + np.int32(kind << BITS))
            vals.append((c / (b[i] - a[i])).astype(np.float32))
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)


def fit(texts: pa.Array, label: np.ndarray, steps: int = 120) -> Model:
    """Adam on the log loss of n-gram shares, then calibration on the fifth of the rows that was left out."""
    n = len(label)
    check = np.arange(n) % 5 == 4
    if n and (len(np.unique(label[check])) < 2 or len(np.unique(label[~check])) < 2):
        check[:] = False
    if len(np.unique(label[~check])) < 2:
        return Model()
    # sparse rows in blocks, so that steps need little memory besides them
    blocks, seen = [], np.zeros(3 << BITS, bool)
    for low in range(0, n, 250):
        block = _sparse(texts.slice(low, 250))
        seen[block[1]] = True
        blocks.append((slice(low, min(low + 250, n)), *block))
    used, place = np.flatnonzero(seen), np.cumsum(seen, dtype=np.int32) - 1
    blocks = [(at, rows, place[cols], vals) for at, rows, cols, vals in blocks]
    w, bias = np.zeros(len(used), np.float32), 0.0
    weight = np.where(label == 1, 0.5 * n / label.sum(), 0.5 * n / (n - label.sum())) * ~check / n
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    z = np.zeros(n)
    for t in range(1, steps + 2):
        g, gb = 1e-7 * w.astype(np.float64), 0.0
        for at, rows, cols, vals in blocks:
            z[at] = np.bincount(rows, vals * w[cols], at.stop - at.start) + bias
            err = ((sigmoid(z[at]) - label[at]) * weight[at]).astype(np.float32)
            g += np.bincount(cols, vals * err[rows], len(used))
            gb += float(err.sum())
        if t > steps:  # the last round only computes the answers
            break
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        mb += 0.1 * (gb - mb)
        vb += 0.01 * (gb * gb - vb)
        w -= (0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)).astype(np.float32)
        bias -= 0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    fold = check if check.any() else ~check
    slope, offset = calibrate(z[fold], label[fold])
    del blocks
    W.release()
    table = np.zeros(3 << BITS, np.float32)
    table[used] = w
    return Model(table.reshape(3, -1), float(bias), max(slope, 0.0), offset)


def measures(texts: pa.Array, model: Model) -> dict[str, np.ndarray]:
    """The base counts and the probability of each text."""
    with np.errstate(over="ignore"):
        data, offsets = W.flat(texts)
        h, _, _, first = W.words(data, offsets, lower=False)
        n = len(offsets) - 1
        a, b = offsets[:-1], offsets[1:]
        n_words = np.diff(first)
        lead = _sums((_LEAD & ~_GAP)[data].view(np.int8), a, b)
        symbols = _sums(_SYMBOL[data].view(np.int8), a, b)
        repeats, copies = np.zeros(n, np.int64), np.zeros(n, np.int64)
        run, at = W.shingles(h, first, WINDOW)
        # windows found twice or more in a row: sorted values that equal a neighbour; the row is mixed in
        own = run ^ W.mix(np.repeat(np.arange(n, dtype=np.uint64), np.diff(at)))
        ordered = np.sort(own)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            found = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
            hit = np.flatnonzero(twice[found] == own)
            row = np.searchsorted(at, hit, "right") - 1
            begin = hit - at[row] + first[row]
            cover = np.zeros(len(h) + 1, np.int64)
            np.add.at(cover, begin, 1)
            np.add.at(cover, np.minimum(begin + WINDOW, first[row + 1]), -1)
            repeats = _sums((np.cumsum(cover)[:-1] > 0).astype(np.int8), first[:-1], first[1:])
        probability = np.ones(n) if model.weights is None else sigmoid(model.slope * raw(model, grams(data, offsets, h, first)) + model.offset)
    raw_bytes = data.tobytes()
    newline = _sums((data == 10).view(np.int8), a, b)
    for i in np.flatnonzero(newline > 0):
        lines = [x for x in raw_bytes[a[i] : b[i]].split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        copies[i] = len(lines) - len(set(lines))
    return {"n_words": n_words, "word_chars": lead, "n_symbols": symbols, "n_dup_lines": copies, "n_repeat_words": repeats, "probability": probability}


def judge(docs: DataFrame, labels: DataFrame, train: DataFrame | None = None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability) of every row."""
    model = fit(*labelled_sample(docs if train is None else train, labels, rows=rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text"):
                got = measures(batch.column("text"), model)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in got.values())], ["doc_id", *got])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = text.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, probability double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return got.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("probability") >= KEEP)).alias("kept"), "probability",
    )


def sift(docs: DataFrame, labels: DataFrame, train: DataFrame | None = None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are kept; judged where they lie, without a join."""
    model = fit(*labelled_sample(docs if train is None else train, labels, rows=rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text"):
                got = measures(batch.column("text"), model)
                failed = (got["n_words"] < LEAST_WORDS) | (100 * got["n_repeat_words"] > REPEAT_PERCENT * got["n_words"])
                yield batch.filter(pa.array(~failed & (got["probability"] >= KEEP)))

    return docs.mapInArrow(run, docs.schema)
