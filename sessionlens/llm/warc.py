"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with a few records,
followed by the seek table of the seekable format (a skippable frame with the
compressed and the plain size of every frame).  A manifest maps every record to
its bundle, its frame and its offset within the plain frame, so a record is
read by one seek and the decompression of one frame.

Equal payloads are stored once: the record with the smallest id is the
response, the others are revisits that refer to it.

Bundles are written by the tasks themselves through pyarrow's file systems, into
a folder that all executors share; a bundle's name has its task attempt, and
the manifest lists bundles of finished attempts alone, so a lost executor or a
repeated task leaves at most files that nothing refers to.

Defined cases: a null payload is empty; a null id is written as ``null`` and a
revisit where its group has another id; rows that repeat the smallest id of a
payload are all responses; empty payloads count as equal; an empty table
gives an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

# fixed values of the formats
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "record_id string, bundle string, frame int, start int, length int"
RECORD = "record_id string, record_type string, refers_to string, target_uri string, payload binary, payload_bytes bigint, payload_digest string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_id: str, kind: str, refers_to: str | None, uri: str | None, payload: bytes, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the response's HTTP head and no body."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri or "about:blank")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:record:{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if kind == "revisit":
        head += [("WARC-Refers-To", f"<urn:record:{refers_to}>"), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """The columns of RECORD; a response whose payload does not have its digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record at this offset")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    name = lambda v: v.removeprefix("<urn:record:").removesuffix(">") if v else None
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != size or digest(payload) != said):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return (name(fields["WARC-Record-ID"]), fields["WARC-Type"], name(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"],
            payload if response else None, size, said)


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """Offset, compressed and plain size of every frame of an open bundle."""
    end = file.size()
    file.seek(end - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    file.seek(end - 9 - 8 * count)
    table, at = [], 0
    for packed, plain in struct.iter_unpack("<II", file.read(8 * count)):
        table.append((at, packed, plain))
        at += packed
    return table


def mark_revisits(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """``record_id``, ``record_type``, ``refers_to``, ``payload`` beside ``target_uri``; equal means equal SHA-256 and size."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8") if dict(pages.dtypes)[payload] == "string" else F.coalesce(F.col(payload), F.lit(b""))
    rows = pages.withColumns({"_body": body}).withColumn("_sum", F.sha2("_body", 256)) \
        .select(F.col(key).alias("_id"), F.col("target_uri"), F.col("_body"), F.col("_sum"))
    first = rows.groupBy("_sum").agg(F.min("_id").alias("_first"))
    same = F.col("_id").eqNullSafe(F.col("_first"))
    return rows.join(first, "_sum").select(
        F.coalesce(F.col("_id").cast("string"), F.lit("null")).alias("record_id"), F.when(same, "response").otherwise("revisit").alias("record_type"),
        F.when(~same, F.col("_first").cast("string")).alias("refers_to"), "target_uri", F.col("_body").alias("payload"))


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write ``records`` (see :func:`mark_revisits`) into ``folder``; the rows are the manifest.

    The files are written when the manifest is: keep it as a table.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        task = TaskContext.get()
        packer, out, name, sizes, frame, members, number, written = zstandard.ZstdCompressor(level=3), None, "", [], bytearray(), [], 0, 0
        rows: list[tuple] = []

        def flush() -> None:
            nonlocal frame, members, written
            if frame:
                packed = packer.compress(bytes(frame))
                out.write(packed)
                rows.extend((i, name, len(sizes), start, length) for i, start, length in members)
                sizes.append((len(packed), len(frame)))
                written += len(packed)
                frame, members = bytearray(), []

        def close() -> None:
            nonlocal out, sizes, number, written
            flush()
            if out is not None:
                out.write(seek_table(sizes))
                out.close()
            out, sizes, number, written = None, [], number + 1, 0

        for batch in batches:
            for record in zip(*(batch.column(n).to_pylist() for n in ("record_id", "record_type", "refers_to", "target_uri", "payload"))):
                if out is None:
                    name = f"bundle-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                data = record_bytes(*record, date)
                members.append((record[0], len(frame), len(data)))
                frame += data
                if len(frame) >= frame_bytes:
                    flush()
                if written >= bundle_bytes:
                    close()
        close()
        columns = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()))],
                                         ["record_id", "bundle", "frame", "start", "length"])

    return records.select("record_id", "record_type", "refers_to", "target_uri", "payload").mapInArrow(write, MANIFEST)


def read_records(manifest: DataFrame, folder: str, task_bytes: int = 32 << 20) -> DataFrame:
    """The records that ``manifest`` (a kept table; all or a selection) lists, each from its frame, about ``task_bytes`` of them in a task."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(folder)
        unpack, at, file, table, plain = zstandard.ZstdDecompressor(), (None, None), None, [], b""
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string())
        names = [x.split()[0] for x in RECORD.split(", ")]
        rows, held = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 7, kinds)], names)
        for batch in batches:
            for bundle, frame, start, length in zip(*(batch.column(n).to_pylist() for n in ("bundle", "frame", "start", "length"))):
                if at[0] != bundle:
                    file = system.open_input_file(f"{base}/{bundle}")
                    table = read_seek_table(file)
                if at != (bundle, frame):
                    offset, packed, size = table[frame]
                    file.seek(offset)
                    plain = unpack.decompress(file.read(packed), max_output_size=size)
                    at = (bundle, frame)
                rows.append(parse_record(plain[start:start + length]))
                held += length
                if held >= 8 << 20:
                    yield pack()
                    rows, held = [], 0
        yield pack()

    listed = manifest.agg(F.sum("length")).first()[0] or 0
    tasks = -(-listed // task_bytes) or 1  # a number, for the rows of the manifest do not show how much is read for them
    frames = manifest.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame", "start")
    return frames.mapInArrow(read, RECORD)
