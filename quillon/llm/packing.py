"""Packing tokenised documents into fixed sequences with controlled source mixture (operator 7).

Each source is a queue of its documents (in the order of a hash), cut into packets of at most ``LENGTH`` tokens. Deficit
round-robin serves the queues: in every round, a mixture window of ``WINDOW`` sequences, source s earns its share of
the window's tokens, and a packet is served once its last token is earned; credit left over is carried into the next
window. A source begins with credit for a part of a packet, by a hash of its name, so that sources too small for a
packet in every window take turns. As credit only depends on what was served before, the round of a packet is the
number of tokens up to its end in its queue, less the first credit, divided by what the source earns each round, and
the whole order follows from prefix sums. These are taken in levels (places in a bucket of a queue, buckets in a block, blocks;
places in a group of rounds, groups in a block, blocks), so no queue, however large, is one task, and deficits carry across partitions as they do across
windows. Inside a round packets are mixed by a hash. Once a queue is empty the others fill its place. The served stream is cut every ``LENGTH`` tokens; what is left in the
end is cut at powers of two, so there is no padding.

Null texts are empty documents of one token, the end mark. Null sources are one source. Rows that repeat an id, and
null ids, are documents of their own. An empty table has no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import words as W
from quillon.llm.shared import small_batches, table

LENGTH, WINDOW, END_ID = 2048, 64, 1
#: Documents in a bucket of a queue (about), and rounds in a group: bounds on what one task sums up.
BUCKET_DOCS, GROUP_ROUNDS = 250, 4
_CODES, _STOP, _NEW = 0x110000, 4, 255
#: Byte-level vocabularies write a byte as this sign: printable ones as themselves, the others from 256 on.
_SHOWN = np.array([33 <= b < 127 or 161 <= b < 173 or b > 173 for b in range(256)])
_SIGNS = np.where(_SHOWN, np.arange(256), 255 + np.cumsum(~_SHOWN)).astype(np.uint32)
_ONE, _E = np.array([ord(c) for c in "stmd"]), np.array([ord(c) for c in "rv"])


class Encoder:
    """Ids of many texts by a byte-level BPE tokenizer, with each distinct piece of text tokenised once.

    The tokenizer never joins across pieces: letters, numbers or other signs, each with one space before; contractions;
    white space. Which of these a code point is, is asked of the tokenizer when the code point is first met. Pieces are
    known by 64-bit hashes, held sorted; when there are more than ``known``, the half that was not met for longest goes.
    """

    def __init__(self, path: str, known: int = 1_000_000):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.limit = Tokenizer.from_file(path), known
        self.split, self.model = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model
        self.kind = np.full(_CODES, _NEW, np.uint8)
        self.value = W.mix(np.arange(1, _CODES + 1, dtype=np.uint64))
        self.clock = 0
        self.key, self.start = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size, self.met = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 20, np.uint16), 0

    def _kinds(self, code: np.ndarray) -> np.ndarray:
        kind = self.kind[code]
        if (kind == _NEW).any():
            for c in np.unique(code[kind == _NEW]).tolist():
                # a letter goes on from a letter, a number from a number, another sign from another sign
                self.kind[c] = next((k for k, before in ((1, "a"), (2, "1"), (0, "!")) if len(self.split(before + chr(c))) == 1), 3)
            kind = self.kind[code]
        return kind

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        # the model is asked for each piece; it has a sign for each byte, and pieces are not cut again
        raw = [p.encode() for p in pieces]
        signs = _SIGNS[np.frombuffer(b"".join(raw), np.uint8)].tobytes().decode("utf-32-le")
        cut = np.cumsum([0, *map(len, raw)]).tolist()
        ids = [[t.id for t in self.model.tokenize(signs[a:b])] for a, b in pairwise(cut)]
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        if len(self.key) + len(keys) > self.limit:
            self._forget()
        need = int(size.sum())
        if self.used + need > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(need, self.used // 2), np.uint16)])
        self.pool[self.used : self.used + need] = np.fromiter(chain.from_iterable(ids), np.uint16, need)
        at = np.searchsorted(self.key, keys)
        self.key = np.insert(self.key, at, keys)
        self.start = np.insert(self.start, at, self.used + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.met = np.insert(self.met, at, np.full(len(keys), self.clock, np.int32))
        self.used += need

    def _forget(self) -> None:
        # what the slice at hand has met must stay; of the rest the older half goes
        keep = self.met >= self.clock
        if not keep.all():
            keep |= self.met > np.median(self.met[~keep])
        size = self.size[keep].astype(np.int64)
        to = np.cumsum(size) - size
        pool = self.pool[np.repeat(self.start[keep] - to, size) + np.arange(size.sum())]
        self.key, self.size, self.met, self.start = self.key[keep], self.size[keep], self.met[keep], to
        self.pool, self.used = pool, len(pool)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        # strings of special tokens are the tokenizer's own matter, and zero marks ends below
        special = ["<|" in t or "\0" in t for t in texts]
        whole = [i for i, s in enumerate(special) if s]
        for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False) if whole else [], strict=True):
            out[i] = np.array(e.ids, np.uint16)
        rest = [i for i, s in enumerate(special) if not s]
        for i, ids in zip(rest, self._pieces([texts[i] for i in rest]) if rest else [], strict=True):
            out[i] = ids
        return out

    def _pieces(self, texts: list[str]) -> list[np.ndarray]:
        self.clock += 1
        joined = "\n".join([*texts, ""])
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        stop = np.cumsum([len(t) + 1 for t in texts]) - 1
        kind = self._kinds(code)
        kind[stop] = _STOP
        begin = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1])
        of, end = kind[begin], np.append(begin[1:], len(code))
        mark = np.zeros(len(code) + 3, bool)
        space = of == 3
        mark[begin[space]] = True
        follow = np.append(of[1:], _STOP)
        # the last sign of white space belongs to what follows, or is a piece of its own
        long = space & (end - begin > 1) & (follow != _STOP)
        mark[end[long] - 1] = True
        sign = of < 3
        joins = np.zeros(len(begin), bool)
        joins[1:] = (of[:-1] == 3) & (code[begin[1:] - 1] == 32)
        mark[begin[sign & ~joins]] = True
        # an apostrophe alone with s, t, m, d, re, ve or ll behind it
        quote = begin[(of == 0) & ~joins & (end - begin == 1) & (follow == 1) & (code[begin] == 39)]
        if len(quote):
            one = code[quote + 1]
            two = np.where(kind[quote + 2] == 1, code[quote + 2], 0)  # a text's end follows a letter at least
            size = np.where(np.isin(one, _ONE), 2, np.where((np.isin(one, _E) & (two == 101)) | ((one == 108) & (two == 108)), 3, 0))
            quote, size = quote[size > 0], size[size > 0]
            mark[quote + 1] = False
            mark[quote + size] = True  # more letters, or what would begin there anyway unless it is white space's second part
        mark = mark[: len(code)]
        mark[stop] = True
        at = np.flatnonzero(mark)
        size = np.diff(np.append(at, len(code)))
        with np.errstate(over="ignore"):
            place = np.arange(len(code)) - np.repeat(at, size)
            value = self.value[code]
            value *= W.powers(int(size.max()) + 1)[place]
            h = W.mix(np.add.reduceat(value, at) + size.astype(np.uint64))
        real = kind[at] != _STOP
        at, size, h = at[real], size[real], h[real]
        if not len(h):
            return [np.zeros(0, np.uint16) for _ in texts]
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        entry = np.searchsorted(self.key, distinct)
        known = np.zeros(len(distinct), bool)
        inside = entry < len(self.key)
        known[inside] = self.key[entry[inside]] == distinct[inside]
        self.met[entry[known]] = self.clock
        if not known.all():
            new = ~known
            self._learn(distinct[new], [joined[at[j] : at[j] + size[j]] for j in first[new].tolist()])
            entry = np.searchsorted(self.key, distinct)
        entry = entry[back]
        n = self.size[entry].astype(np.int64)
        to = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(self.start[entry] - to[:-1], n) + np.arange(to[-1])]
        edge = to[np.searchsorted(at, np.concatenate([[0], stop]))]
        return [ids[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(row, doc_id, source, n, ids) of each document; ids are its ids and the end mark, as 32-bit numbers, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pack = encoder(tokenizer), zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for batch in W.slices(whole, "text", 1_000_000):
                ids = [np.append(x, END_ID).astype(np.uint32) for x in enc.encode([t or "" for t in batch.column("text").to_pylist()])]
                # all low halves, then all high ones: shorter when compressed
                halves = [pack.compress(x.view(np.uint16).reshape(-1, 2).T.tobytes()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("doc_id"), batch.column("source"), pa.array([len(x) for x in ids], pa.int64()), pa.array(halves, pa.binary())],
                    ["row", "doc_id", "source", "n", "ids"],
                )

    docs = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.col("text").cast("string").alias("text"),
    )
    return docs.mapInArrow(run, "row long, doc_id long, source string, n long, ids binary")


def unpack(ids: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), np.uint16).reshape(2, -1).T.copy().view(np.uint32).ravel()


def ahead(rows: DataFrame, by: list[str], order: str, value: str, block: int = 4096) -> DataFrame:
    """``rows`` (one for each ``by`` and whole number ``order``) with ``ahead``, the sum of ``value`` over the rows before.

    Sums are taken over blocks of ``order`` first, so a task orders the rows of a block, or the blocks of a group.
    """
    rows = rows.withColumn("block", F.floor(F.col(order) / block))
    blocks = rows.groupBy(*by, "block").agg(F.sum(value).alias("size"))
    blocks = blocks.select(*by, "block", (F.sum("size").over(Window.partitionBy(*by).orderBy("block")) - F.col("size")).alias("before"))
    inside = Window.partitionBy(*by, "block").orderBy(order)
    rows = rows.withColumn("within", F.sum(value).over(inside) - F.col(value)).join(blocks, [*by, "block"])
    return rows.withColumn("ahead", F.col("before") + F.col("within")).drop("block", "before", "within")


def plan(sizes: DataFrame, shares: dict[str, float] | None = None, length: int = LENGTH) -> DataFrame:
    """(row, start, length, sequence_id, offset) of each piece, from (row, doc_id, source, n); see the module's text."""
    totals = sizes.agg(F.sum("n").alias("n"), F.count("*").alias("docs")).first()
    total, docs = int(totals["n"] or 0), int(totals["docs"])
    bits = max(0, math.ceil(math.log2(max(docs / BUCKET_DOCS, 1))))
    queue = sizes.withColumn("key", F.xxhash64("doc_id", "row")).withColumn("bucket", F.pmod(F.col("key"), F.lit(1 << bits)).cast("long"))
    # tokens before each bucket of its source's queue
    buckets = table(ahead(queue.groupBy("source", "bucket").agg(F.sum("n").alias("size")), ["source"], "bucket", "size"), "buckets")
    sources = buckets.groupBy("source").agg(F.sum("size").alias("source_size"))
    if shares:
        given = F.create_map(*[x for s, w in shares.items() for x in (F.lit(s), F.lit(float(w)))])
        sources = sources.withColumn("weight", F.coalesce(given[F.col("source")], F.lit(float(min(shares.values())))))
    else:
        sources = sources.withColumn("weight", F.col("source_size").cast("double"))
    sources = table(sources, "sources")
    weights = float(sources.agg(F.sum("weight")).first()[0] or 1.0)
    phase = F.pmod(F.xxhash64(F.lit("phase"), "source"), F.lit(1 << 20)) / (1 << 20)
    sources = sources.select(
        "source",
        (F.col("weight") / weights * WINDOW * length).alias("earned"),
        # the credit that a source begins with: a part of a packet
        (phase * F.least(F.lit(length), F.col("source_size"))).alias("credit"),
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "row")
    placed = queue.withColumn("within", F.sum("n").over(inside) - F.col("n")).join(buckets.join(sources, "source").drop("size"), ["source", "bucket"])
    packets = placed.select(
        "row", "source", "earned", "credit", (F.col("ahead") + F.col("within")).alias("before"), "n",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(length).cast("long"))).alias("start"),
    )
    size = F.least(F.lit(length), F.col("n") - F.col("start"))
    served = F.col("before") + F.col("start")
    # the first round in which a packet's last token is earned
    packets = packets.select(
        "row", "source", "start", size.alias("size"), served.alias("served"),
        F.greatest(F.ceil((served + size - F.col("credit")) / F.col("earned")) - 1, F.lit(0)).cast("long").alias("round"),
    ).withColumn("rounds", F.floor(F.col("round") / GROUP_ROUNDS))
    packets = table(packets, "packets")
    # one row for GROUP_ROUNDS * WINDOW sequences
    groups = ahead(packets.groupBy("rounds").agg(F.sum("size").alias("tokens")), [], "rounds", "tokens")
    order = Window.partitionBy("rounds").orderBy("round", F.xxhash64("source", "served", "row"), "row", "start")
    stream = packets.withColumn("within", F.sum("size").over(order) - F.col("size")).join(groups.select("rounds", "ahead"), "rounds")
    stream = stream.select("row", "start", "size", (F.col("ahead") + F.col("within")).alias("at")).withColumn("end", F.col("at") + F.col("size"))
    full = total // length * length
    tails, at, number = [], full, full // length
    for bit in reversed(range(length.bit_length())):
        if (total - full) >> bit & 1:
            tails.append((number, at, at + (1 << bit)))
            number, at = number + 1, at + (1 << bit)
    kind = "array<struct<sequence_id:long,begin:long,end:long>>"
    last = ", ".join(f"named_struct('sequence_id', {a}L, 'begin', {b}L, 'end', {c}L)" for a, b, c in tails)
    regular = (
        f"if(at < {full}, transform(sequence(cast(at div {length} as bigint), cast((least(end, {full}L) - 1) div {length} as bigint)), "
        f"s -> named_struct('sequence_id', s, 'begin', s * {length}L, 'end', (s + 1) * {length}L)), cast(array() as {kind}))"
    )
    cuts = f"concat({regular}, filter(cast(array({last}) as {kind}), t -> t.begin < end and t.end > at))"
    return stream.withColumn("cut", F.explode(F.expr(cuts))).select(
        "row",
        (F.col("start") + F.greatest(F.col("cut.begin") - F.col("at"), F.lit(0))).alias("start"),
        (F.least("end", "cut.end") - F.greatest("at", "cut.begin")).alias("length"),
        F.col("cut.sequence_id").alias("sequence_id"),
        (F.greatest("at", "cut.begin") - F.col("cut.begin")).alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, shares: dict[str, float] | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of each piece.

    ``shares`` are the sources' target shares of every mixture window (default: their shares of all tokens).
    """
    with small_batches(docs.sparkSession, 1000):
        held = table(tokens(docs, tokenizer), "tokens")
    pieces = plan(held.select("row", "doc_id", "source", "n"), shares, length)
    # a document's own pieces, as many as its tokens at most
    by_row = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7 + with_ids)]
            for doc_id, raw, pieces in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "pieces")), strict=True):
                ids = unpack(raw)
                for p in pieces:
                    own = ids[p["start"] : p["start"] + p["length"]]
                    row = (doc_id, p["start"], p["length"], zlib.crc32(own.astype("<u4").tobytes()), len(ids), p["sequence_id"], p["offset"], own.astype(np.int32))
                    for column, value in zip(out, row, strict=False):
                        column.append(value)
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)

    return held.select("row", "doc_id", "ids").join(by_row, "row").select("doc_id", "ids", "pieces").mapInArrow(run, kind)
