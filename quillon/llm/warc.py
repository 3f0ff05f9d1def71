"""WARC records in seekable Zstandard bundles (operator 4).

Each page becomes one record. Payloads (the html in UTF-8; null: empty) of at least ``least`` bytes that are equal
share one response, the one of the largest page_id; the others are revisit records that name it. Smaller ones are all
responses. Records of a partition are grouped into frames of about ``FRAME`` bytes, each a Zstandard frame of its own;
frames follow each other in bundles of about ``BUNDLE`` bytes, and a skippable frame at the end holds the seek table
(sizes of each frame, packed and unpacked, their number and the magic 0x8F92EAB1). The index names for each record its
bundle, frame and offset within the unpacked frame, so one record is read by decompressing one frame.

Bundles go to the shared folder under a name that no other attempt of a task has; a lost attempt leaves a file that no
index names. Repeated rows are records of their own: of equal payloads under the largest page_id all rows are
responses. Null ids count below all others; if a payload has only null ids, its rows are responses. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import shared_path, small_batches, spread_join, table

FRAME, BUNDLE, LEVEL = 1 << 20, 64 << 20, 3
SEEK_MAGIC, SKIP_MAGIC = 0x8F92EAB1, 0x184D2A5E
INDEX = "page_id long, record_id string, bundle string, frame int, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None, payload_digest: str) -> str:
    """An identifier of page and payload: rows that repeat an id with other payloads have others; rows equal in both are equal records."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{payload_digest}')}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, sha: str | None = None) -> bytes:
    """One record, ``sha`` being its payload's digest if it is known; a revisit keeps the HTTP head of its response, with the length of the full payload, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block, sha = head if refers_to is not None else head + payload, sha or digest(payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, sha)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([] if page_id is None else [f"X-Page-ID: {page_id}"]),
        *([] if url is None else ["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")]),
        f"WARC-Payload-Digest: sha1:{sha}",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, sha)}",
            f"X-Refers-To-Page: {refers_to}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The headers and block of the record at ``at``, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    size = int(headers["Content-Length"])
    return headers, data[end + 4 : end + 4 + size], end + 4 + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer: a skippable frame with (packed, unpacked) sizes of all frames."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEK_MAGIC)
    return struct.pack("<II", SKIP_MAGIC, len(body)) + body


def read_seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(place, packed, unpacked) of each frame of a bundle that has ``size`` bytes."""
    file.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * count)
    raw, out, at = file.read(8 * count), [], 0
    for packed, unpacked in struct.iter_unpack("<II", raw):
        out.append((at, packed, unpacked))
        at += packed
    return out


def _open(path: str):
    system, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system, name


class _Bundle:
    """A bundle as it is written: frames one after another, then the seek table."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        system, name = _open(self.path)
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.file, self.frames, self.size = system.open_output_stream(name, compression=None), [], 0

    def add(self, frame: bytes) -> None:
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(frame)
        self.file.write(packed)
        self.frames.append((len(packed), len(frame)))
        self.size += len(packed)

    def close(self) -> None:
        self.file.write(seek_table(self.frames))
        self.file.close()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, frame, size, index = None, [], 0, []

        def flush() -> None:
            nonlocal bundle, size
            if frame:
                bundle = bundle or _Bundle(folder)
                for at, n, page_id, name in index[len(index) - len(frame) :]:
                    done.append((page_id, name, bundle.path, len(bundle.frames), at, n))
                bundle.add(b"".join(frame))
                frame.clear()
                size = 0

        def result() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            columns = list(zip(*done, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "record_id", "bundle", "frame", "offset", "length"])

        done: list[tuple] = []
        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                payload = (html or "").encode()
                sha = digest(payload)
                raw = write_record(page_id, url, payload, refers, sha)
                index.append((size, len(raw), page_id, record_id(page_id, sha)))
                frame.append(raw)
                size += len(raw)
                if size >= FRAME:
                    flush()
                    index.clear()
                    if bundle and bundle.size >= BUNDLE:
                        bundle.close()
                        bundle = None
                        yield result()
                        done.clear()
        flush()
        if bundle:
            bundle.close()
        yield result()

    return run


def equal_payloads(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` with refers_to: the largest page_id of an equal payload, null for that one itself and for single ones.

    Only ids and digests are grouped; digests of very many pages are joined where their rows lie, and pages by their ids.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keys = table(pages.where(F.octet_length(payload) >= least).select("page_id", F.sha1(payload).alias("digest")).distinct(), "digests")
    largest = keys.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").select("digest", "largest")
    refers = spread_join(keys, largest, ["digest"]).where(~F.col("page_id").eqNullSafe(F.col("largest")))
    refers = refers.select(F.col("page_id").alias("id"), F.col("digest").alias("of"), F.col("largest").alias("refers_to"))
    same = F.col("page_id").eqNullSafe(F.col("id")) & (F.sha1(payload) == F.col("of")) & (F.octet_length(payload) >= least)
    return pages.join(refers, same, "left").drop("id", "of")


def write_bundles(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write one record for each page to bundles in ``folder``; returns the index, which is itself a shared table."""
    folder = folder or shared_path(pages.sparkSession, "bundles")
    with small_batches(pages.sparkSession, 256):
        return table(equal_payloads(pages, least).select("page_id", "url", "html", "refers_to").mapInArrow(_writer(folder), INDEX), "index")


def read_frame(path: str, number: int) -> bytes:
    """One unpacked frame; nothing else of the bundle is read but its seek table."""
    system, name = _open(path)
    with system.open_input_file(name) as file:
        at, packed, _ = read_seek_table(file, file.size())[number]
        file.seek(at)
        return zstandard.ZstdDecompressor().decompress(file.read(packed))


def read_bundles(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every indexed record.

    The records of a frame are read together, each at the offset that the index gives: the bundle's seek table is read
    once, the frame is decompressed once, and a record that is not the one that the index names is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, frames, number, data = None, [], None, b""
        for batch in batches:
            rows = []
            for own, name, bundle, frame, offset, length in zip(*(batch.column(c).to_pylist() for c in ("page_id", "record_id", "bundle", "frame", "offset", "length")), strict=True):
                system, place = _open(bundle)
                if bundle != path:
                    with system.open_input_file(place) as file:
                        path, frames, number = bundle, read_seek_table(file, file.size()), None
                if frame != number:
                    at, packed, _ = frames[frame]
                    with system.open_input_file(place) as file:
                        file.seek(at)
                        number, data = frame, zstandard.ZstdDecompressor().decompress(file.read(packed))
                headers, block, end = parse_record(data, offset)
                if headers["WARC-Record-ID"] != name or end - offset != length:
                    raise ValueError(f"{bundle}: frame {frame} has another record at {offset} than {name}")
                head, _, payload = block.partition(b"\r\n\r\n")
                said = int(head.rpartition(b"Content-Length: ")[2])
                kind, sha = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (len(payload) != said or digest(payload) != sha):
                    raise ValueError(f"{bundle}: a damaged record {name}")
                refers = headers.get("X-Refers-To-Page")
                rows.append((own, said, sha, kind, None if refers is None else int(refers)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # frames are bounded in size, or hold one record
    return index.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(run, RECORD)
